"""Exact substring deduplication: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Places. Every string of ``length`` bytes holds, at a place that depends on its content alone, its least
hashed gram of ``GRAM`` bytes. These grams are the corpus' anchors, about two for each ``length`` bytes, and
equal strings have equal anchors. Anchors are grouped by their gram; anchors whose whole surroundings
(the bytes of all strings that have this anchor) are equal are counted together first, so copies collapse before anything else.

Suffix sort. In a group with different surroundings, the suffixes that start at the anchors are put in
order by mergesort, and so are the prefixes that end there, read backwards. Two suffixes are compared
by prefix polynomial hashes: a binary search finds their common extension in a logarithmic number of
steps and the next byte decides. Extensions of neighbours are verified byte by byte. Cutting both orders
where extensions get short gives classes of equal strings for each place of the anchor in the string.

Hot groups, of more than ``HOT`` different surroundings, are spread instead: each string is counted by its
digest in blocks. A block's common core that occurs once rules all its strings out, its hull that occurs
twice proves them all, and only blocks between are counted string by string.

Verification. What digests say, of copies and of the strings of hot groups, are claims that a stretch of one text equals one of another.
Claims between the same texts at the same distance are joined to long stretches, and their bytes are compared before anything is removed.
If one claim is wrong, all is done again with other digests, so a collision costs time and never a byte.

Null texts are empty. Texts below ``length`` bytes lose nothing. Repeated rows are copies of each other. Very
long texts are cut for the search of anchors only, with overlap.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import discard, keyed, stored, tidy

LENGTH, GRAM = 400, 32
#: Different surroundings of one gram up to which a group is sorted in one task.
HOT = 2_000
#: Strings of a hot group that are counted as one block.
BLOCK = 16
#: Bytes of a text that are searched at a time, and anchors that are sorted at a time.
PIECE, SORTED = 1 << 20, 2_048
#: Bits of a gram's place beside its hash: more than any value of a column has bytes. Grams that agree in the other bits go by place.
PLACE_BITS = 33
#: Bytes of a text that are compared with a repetition at a time.
CHECKED = 4_096

BASE = 0x9E3779B97F4A7C15
SIGN = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)  # what each byte counts in a hash


class Powers:
    """Powers of the base modulo 2**64 and their inverses."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            one = np.ones(1, dtype=np.uint64)
            self.up, self.down = (np.cumprod(np.concatenate([one, np.full(n - 1, x, dtype=np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()


def task(run):
    """An Arrow map that leaves no powers behind in its worker."""

    @functools.wraps(run)
    def mapped(batches):
        yield from run(batches)
        POWERS.__init__()

    return tidy(mapped)


def prefixes(raw: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i is the hash of the first i bytes, scaled by its place."""
    up, _ = POWERS.upto(len(raw) + 1)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(SIGN[raw] * up[: len(raw)])])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` entries in a row."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    to_right = np.minimum.accumulate(rows, axis=1).ravel()
    to_left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_left[:n], to_right[width - 1 : width - 1 + n])


def anchors_of(bodies: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, gram hash, before, after): the leftmost least gram of every string of ``length`` bytes. Each string
    has one anchor; strings with one anchor start from ``before`` bytes left of it on and end ``after`` bytes right of it at most."""
    parts = [(i, at, b[at : at + PIECE + length - 1]) for i, b in enumerate(bodies) for at in range(0, max(len(b) - length + 1, 0), PIECE)]
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    sizes = np.array([len(p[2]) for p in parts])
    raw = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    q = prefixes(raw)
    _, down = POWERS.upto(len(raw) + 1)
    h = mixed((q[gram:] - q[:-gram]) * down[: len(raw) - gram + 1])
    # as many bits for every batch: a string's anchor must not depend on what it came with
    place_bits = np.uint64(PLACE_BITS)
    keys = (h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(keys, length - gram + 1)
    ends = np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= length)  # strings that lie in one text
    at = (least[inside] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last = inside[new], inside[np.concatenate([new[1:], [len(at)]]) - 1]
    at = at[new]
    starts = np.cumsum(sizes) - sizes
    part = np.searchsorted(starts, at, side="right") - 1
    text = np.array([p[0] for p in parts])[part]
    place = at - starts[part] + np.array([p[1] for p in parts])[part]
    return text, place, h[at].view(np.int64), at - first, last + length - at


class Suffixes:
    """Suffixes of surroundings, compared by prefix hashes. begins, ends: where each suffix starts and ends in raw."""

    def __init__(self, raw: bytes, begins: np.ndarray, ends: np.ndarray):
        self.raw, self.begins, self.sizes = raw, begins, ends - begins
        self.bytes = np.frombuffer(raw, dtype=np.uint8)
        self.q = prefixes(self.bytes)
        _, self.down = POWERS.upto(len(raw) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search."""
        p, r = self.begins[a], self.begins[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        scale_p, scale_r = self.down[p], self.down[r]
        base_p, base_r = self.q[p], self.q[r]
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = (self.q[p + middle] - base_p) * scale_p == (self.q[r + middle] - base_r) * scale_r
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b."""
        n = self.common(a, b)
        end_a, end_b = n == self.sizes[a], n == self.sizes[b]
        last = len(self.bytes) - 1
        less = self.bytes[np.minimum(self.begins[a] + n, last)] < self.bytes[np.minimum(self.begins[b] + n, last)]
        return np.where(end_a & end_b, or_equal, end_a | (~end_b & less))

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort within groups (numbered upwards). Returns the order and each suffix's verified common extension with the one before
        it in its group (-1 for the first)."""
        n = len(group)
        order = np.arange(n)
        first = np.searchsorted(group, group, side="left")
        end = np.searchsorted(group, group, side="right")
        width, largest = 1, int((end - first).max())
        while width < largest:
            place = np.arange(n)
            block = (place - first) // width
            odd = block % 2 == 1
            other = first + np.where(odd, block - 1, block + 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            start = low.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                middle = (low[active] + high[active]) // 2
                # an element of the right run goes after equal ones of the left run
                passes = self.before(order[middle], order[active], odd[active])
                low[active] = np.where(passes, middle + 1, low[active])
                high[active] = np.where(passes, high[active], middle)
                active = active[low[active] < high[active]]
            mine = place - (first + block * width)
            to = np.where(odd, other, first + block * width) + mine + (low - start)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, width * 2
        same = np.concatenate([[False], group[1:] == group[:-1]])
        extension = np.full(n, -1, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            extension[at] = self.common(order[at - 1], order[at])
            raw, begins = self.raw, self.begins
            wrong = False
            for i in at.tolist():  # verify, for hashes can collide
                a, b, k = begins[order[i - 1]], begins[order[i]], extension[i]
                if raw[a : a + k] != raw[b : b + k]:
                    wrong = True
                    break
            if wrong:
                return self.sort_plainly(group)
        return order, extension

    def sort_plainly(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing bytes; used if a hash has collided."""
        body = [self.raw[b : b + n] for b, n in zip(self.begins.tolist(), self.sizes.tolist())]
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], body[i])))
        extension = np.full(len(group), -1, np.int64)
        for i in range(1, len(group)):
            if group[i] == group[i - 1]:
                a, b = body[order[i - 1]], body[order[i]]
                n = min(len(a), len(b))
                extension[i] = next((k for k in range(n) if a[k] != b[k]), n)
        return order, extension


def neighbours(order: np.ndarray, extension: np.ndarray) -> np.ndarray:
    """For each element, its longest common extension with any other of its group."""
    after = np.concatenate([extension[1:], [-1]])
    out = np.empty_like(extension)
    out[order] = np.maximum(extension, after)
    return out


def shared_strings(group: np.ndarray, around: list[bytes], left: np.ndarray, length: int, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(element, from, to): for elements of groups, the runs of j for which the string of ``length`` bytes that begins
    j bytes before the element's anchor occurs at another element of the group too."""
    sizes = np.array([len(a) for a in around])
    raw = b"".join(around)
    ends = np.cumsum(sizes)
    at = ends - sizes + left
    right_order, right = Suffixes(raw, at, ends).sort(group)
    left_order, before = Suffixes(raw[::-1], len(raw) - at, len(raw) - (ends - sizes)).sort(group)
    low = np.maximum(0, length - neighbours(right_order, right))
    high = np.minimum(np.minimum(left, neighbours(left_order, before)), length - gram)
    use = np.flatnonzero(low <= high)
    if not len(use):
        return []
    found = np.zeros((len(use), length - gram + 2), dtype=bool)
    for j in range(int(low[use].min()), int(high[use].max()) + 1):
        here = np.flatnonzero((low[use] <= j) & (j <= high[use]))
        if len(here) < 2:
            continue
        classes = np.empty((2, len(group)), np.int64)
        classes[0][right_order] = np.cumsum(right < length - j)
        classes[1][left_order] = np.cumsum(before < j)
        code = classes[0][use[here]] * (len(group) + 1) + classes[1][use[here]]
        order = np.argsort(code, kind="stable")
        equal = code[order][1:] == code[order][:-1]
        twice = np.zeros(len(here), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        found[here[twice], j] = True
    change = np.diff(found.astype(np.int8), axis=1, prepend=0)
    row, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return list(zip(use[row].tolist(), begin.tolist(), (end - 1).tolist()))


def sized_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most PIECE bytes of text, or one row."""
    start = 0
    while start < batch.num_rows:
        part = batch.slice(start, 256)
        bodies = [(t or "").encode() for t in part.column(column).to_pylist()]
        fit = max(1, int(np.searchsorted(np.cumsum([len(b) for b in bodies]), PIECE, side="right")))
        yield part.slice(0, fit), bodies[:fit]
        start += fit


def digester(turn: int):
    """The digest of a string at a place beside its anchor; another function each turn."""
    return lambda raw, place: xxhash.xxh3_128_digest(raw, place + (turn << 32))


def union_of(cover: Iterator[tuple[int, int]]) -> list[list[int]]:
    """The maximal stretches that [begin, stop) cover, in order."""
    union: list[list[int]] = []
    for begin, stop in sorted(cover):
        if union and begin <= union[-1][1]:
            union[-1][1] = max(union[-1][1], stop)
        else:
            union.append([begin, stop])
    return union


PLACE = "_k long, _c long, g long, x binary, pos int, before int, after int"


def places(docs: DataFrame, length: int, turn: int = 0) -> DataFrame:
    """The anchors of all texts: gram g, digest x of the surroundings that their strings cover, and how far these reach."""
    digest = digester(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in sized_slices(batch, 2):
                text, place, g, before, after = anchors_of(bodies, length)
                if not len(text):
                    continue
                x = [digest(bodies[i][p - b : p + a], b) for i, p, b, a in zip(text.tolist(), place.tolist(), before.tolist(), after.tolist())]
                rows = pa.array(text)
                columns = [part.column(0).take(rows), part.column(1).take(rows), pa.array(g), pa.array(x, pa.binary()), *(pa.array(c.astype(np.int32)) for c in (place, before, after))]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "_c", "g", "x", "pos", "before", "after"])

    return docs.select("_k", "_c", "text").mapInArrow(task(run), PLACE)


AROUND = "g long, x binary, n long, d long, _k long, _c long, pos int, before int, around binary"


def surroundings(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around anchors. wanted: (_k, _c, at array of (g, x, n, d, pos, before, after))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("g", "x", "n", "d", "pos", "before")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out: dict[str, list] = {k: [] for k in (*names, "_k", "_c", "around")}
                for k, c, text, at in zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in ("_k", "_c", "text", "at"))):
                    raw = (text or "").encode()
                    for a in at:
                        for n in names:
                            out[n].append(a[n])
                        out["_k"].append(k)
                        out["_c"].append(c)
                        out["around"].append(raw[a["pos"] - a["before"] : a["pos"] + a["after"]])
                kinds = {"g": pa.int64(), "x": pa.binary(), "n": pa.int64(), "d": pa.int64(), "_k": pa.int64(), "_c": pa.int64(), "pos": pa.int32(), "before": pa.int32(), "around": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds.items()], names=list(kinds))

    return bodies.join(wanted, ["_k", "_c"]).mapInArrow(task(run), AROUND)


SPAN = "_k long, _c long, begin int, stop int"


def sorted_groups(around: DataFrame, length: int) -> DataFrame:
    """Spans found by sorting, for groups that one task can hold. Rows come ordered by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(rows: pa.Table) -> pa.RecordBatch:
            g = rows["g"].to_numpy()
            group = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
            runs = shared_strings(group, rows["around"].to_pylist(), rows["before"].to_numpy().astype(np.int64), length)
            alone = rows["n"].to_numpy() == 1  # others are covered as copies
            runs = [r for r in runs if alone[r[0]]]
            e, low, high = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
            pos = rows["pos"].to_numpy().astype(np.int64)[e]
            at = pa.array(e)
            return pa.RecordBatch.from_arrays([rows["_k"].combine_chunks().take(at), rows["_c"].combine_chunks().take(at), pa.array((pos - high).astype(np.int32)), pa.array((pos - low + length).astype(np.int32))], names=["_k", "_c", "begin", "stop"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                rows = pa.Table.from_batches(held)
                g = rows["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left"))  # the last group may go on
                if cut:
                    yield spans(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return around.repartition("g").sortWithinPartitions("g").mapInArrow(task(run), SPAN)


def hot_groups(around: DataFrame, length: int, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """Spans of groups too large for one task, by counting digests of strings in blocks of BLOCK places; and the claims that they rest on."""
    digest = digester(turn)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows, low, high, core, hull = [], [], [], [], []
                for i, (b, raw) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    first, last = max(0, length - (len(raw) - b)), min(b, length - GRAM)
                    for j in range(first - first % BLOCK, last + 1, BLOCK):
                        lo, hi = max(j, first), min(j + BLOCK - 1, last)
                        rows.append(i)
                        low.append(lo)
                        high.append(hi)
                        # the core lies in every string of the block, so it exists where one of them does; the hull only where all do
                        core.append(digest(raw[b - j : b - (j + BLOCK - 1) + length], j))
                        hull.append(digest(raw[b - hi : b - lo + length], j + 1) if hi - lo == BLOCK - 1 else None)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(3).take(at), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(core, pa.binary()), pa.array(hull, pa.binary())], names=["g", "x", "low", "high", "core", "hull"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows, js, out = [], [], []
                for i, (b, raw, low, high) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 4, 5)))):
                    for j in range(low, high + 1):
                        rows.append(i)
                        js.append(j)
                        out.append(digest(raw[b - j : b - j + length], j))
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(3).take(at), pa.array(js, pa.int32()), pa.array(out, pa.binary())], names=["g", "x", "j", "s"])

    n_blocks = around.count() * (length // BLOCK)
    blocks = stored(around.select("g", "before", "around", "x").mapInArrow(task(digests), "g long, x binary, low int, high int, core binary, hull binary"), "hot-blocks", n_blocks)
    # counts are stored before they are joined, so that a join can be split at a string that is everywhere
    cores = stored(blocks.groupBy("g", "core").agg(F.count("*").alias("cores")).where("cores > 1").select("g", "core"), "hot-cores", n_blocks // 2)
    # hulls and strings are equal only at one place beside the anchor
    hulls = stored(blocks.where("hull is not null").groupBy("g", "low", "hull").agg(F.count("*").alias("hulls"), F.min("x").alias("one")).where("hulls > 1").drop("hulls"), "hot-hulls", n_blocks // 2)
    proven = blocks.join(hulls, ["g", "low", "hull"]).select("g", "x", "low", "high", "one")
    # of the blocks with a proven hull one is counted string by string too: others may share a part of it
    likely = blocks.join(cores, ["g", "core"], "left_semi")
    one = hulls.withColumnRenamed("one", "x")
    todo = likely.join(hulls, ["g", "low", "hull"], "left_anti").unionByName(likely.join(one, ["g", "low", "hull", "x"], "left_semi")).select("g", "x", "low", "high")
    single = stored(around.select("g", "before", "around", "x").join(todo, ["g", "x"]).select("g", "before", "around", "x", "low", "high").mapInArrow(task(strings), "g long, x binary, j int, s binary"), "hot-strings")
    twice = stored(single.groupBy("g", "j", "s").agg(F.count("*").alias("strings"), F.min("x").alias("one")).where("strings > 1").drop("strings"), "hot-twice", n_blocks * BLOCK // 2)
    found = single.join(twice, ["g", "j", "s"]).select("g", "x", F.col("j").alias("low"), F.col("j").alias("high"), "one")
    runs = stored(found.unionByName(proven), "hot-runs")
    discard(blocks, cores, hulls, single, twice)
    begin, stop = (F.col("pos") - F.col("high")).cast("int").alias("begin"), (F.col("pos") - F.col("low") + length).cast("int").alias("stop")
    # stored for the same reason as the counts
    at = stored(around.select("g", "x", "_k", "_c", "pos").dropDuplicates(["g", "x"]), "hot-places")
    others = at.select("g", F.col("x").alias("one"), F.col("_k").alias("_k2"), F.col("_c").alias("_c2"), F.col("pos").alias("pos2"))
    claims = runs.where("x <> one").join(at, ["g", "x"]).join(others, ["g", "one"]).select("_k", "_c", begin, stop, "_k2", "_c2", (F.col("pos2") - F.col("high")).cast("int").alias("begin2"))
    owner = around.where("n = 1").select("g", "x", "_k", "_c", "pos")
    return runs.join(owner, ["g", "x"]).select("_k", "_c", begin, stop), claims


PIECES = "_k long, _c long, _k2 long, _c2 long, block int, parts array<struct<at int, size int, skip int>>"


def untrue(bodies: DataFrame, claims: DataFrame) -> DataFrame:
    """The pieces at which claims are wrong. claims: bytes begin to stop of text (_k, _c) are those from begin2 on of text (_k2, _c2). The other
    text is read in blocks of CHECKED bytes, each once, however many stretches are compared with it; equal pieces of a task's texts
    that stand for the same place of a block are compared once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_k", "_c", "_k2", "_c2", "block", "parts")
        part = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("skip", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), part)
        for batch in batches:
            rows: list[tuple] = []
            for k, c, k2, c2, cover in zip(*(column.to_pylist() for column in batch.columns)):
                by_shift: dict[int, list[tuple[int, int]]] = {}
                for s in cover:
                    by_shift.setdefault(s["shift"], []).append((s["begin"], s["stop"]))
                by_block: dict[int, list[tuple[int, int, int]]] = {}
                for shift, stretches in by_shift.items():
                    for at, stop in union_of(stretches):
                        while at < stop:
                            block, skip = divmod(at - shift, CHECKED)
                            size = min(stop - at, CHECKED - skip)
                            by_block.setdefault(block, []).append((at, size, skip))
                            at += size
                rows += [(k, c, k2, c2, block, parts) for block, parts in by_block.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=list(names))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("_k2", "_c2", "block", "skip", "size", "piece")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        found: dict[tuple, None] = {}
        held = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=list(names))

        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(0)[i].as_py().encode()
                for a in batch.column(1)[i].as_py():
                    for p in a["parts"]:
                        piece = raw[max(p["at"], 0) : max(p["at"] + p["size"], 0)]
                        row = (a["_k2"], a["_c2"], a["block"], p["skip"], p["size"], piece)
                        if row not in found:
                            found[row] = None
                            held += len(piece) + 64
                            if held >= PIECE:
                                yield flushed()
                                found.clear()
                                held = 0
        if found:
            yield flushed()

    cover = F.collect_list(F.struct("begin", "stop", (F.col("begin") - F.col("begin2")).alias("shift"))).alias("cover")
    claimed = claims.where("_k <> _k2 or _c <> _c2 or begin <> begin2").groupBy("_k", "_c", "_k2", "_c2").agg(cover)
    pieces = stored(claimed.mapInArrow(task(cut), PIECES), "claims")
    # repeated rows have one key and one text
    once = bodies.where("text is not null").groupBy("_k", "_c").agg(F.min("text").alias("text"))

    def bytes_of(wanted: DataFrame) -> DataFrame:
        lists = wanted.groupBy("_k", "_c").agg(F.collect_list(F.struct("_k2", "_c2", "block", "parts")).alias("pieces"))
        return once.join(lists, ["_k", "_c"]).select("text", "pieces").mapInArrow(task(taken), "_k2 long, _c2 long, block int, skip int, size int, piece binary")

    blocks = pieces.select("_k2", "_c2", "block").distinct()
    whole = F.array(F.struct((F.col("block") * CHECKED).alias("at"), F.lit(CHECKED).alias("size"), F.lit(0).alias("skip")))
    theirs = bytes_of(blocks.select(F.col("_k2").alias("_k"), F.col("_c2").alias("_c"), "_k2", "_c2", "block", whole.alias("parts"))).select("_k2", "_c2", "block", F.col("piece").alias("whole"))
    same = F.col("whole").isNotNull() & (F.col("piece") == F.expr("substring(whole, skip + 1, size)"))
    return bytes_of(pieces).join(theirs, ["_k2", "_c2", "block"], "left").where(~same).select("_k2", "_c2", "block", "skip", "size")


def spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The keyed documents (_k, _c, doc_id, text), and (_k, _c, spans): overlapping [begin, stop) that cover all repeated bytes."""
    bodies = docs.select(*keyed(docs, doc_id, text), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    for turn in itertools.count():
        every, alike, claims = claimed_spans(bodies, length, turn)
        if alike and untrue(bodies, claims).isEmpty():
            return bodies, every.distinct().groupBy("_k", "_c").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def claimed_spans(bodies: DataFrame, length: int, turn: int) -> tuple[DataFrame, bool, DataFrame]:
    """(_k, _c, begin, stop) of repeated bytes as the digests of this turn have it, whether all copies reach equally far, and the claims to verify."""
    all_places = stored(places(bodies, length, turn), "anchors")
    n = all_places.count()
    # counts of grams are stored before they are joined: a join with shuffles of its own can be split at a gram that is everywhere
    shared = stored(all_places.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "shared-grams", n // 2)
    some = stored(all_places.join(shared, "g"), "shared-anchors", n)
    discard(all_places, shared)
    # copies of surroundings collapse to one row with their number before groups are looked at
    first = F.min(F.struct("_k", "_c", "pos", "before", "after")).alias("first")
    kinds = stored(some.groupBy("g", "x").agg(F.count("*").alias("n"), first), "surroundings", n)
    groups = stored(kinds.groupBy("g").agg(F.count("*").alias("d")).where("d > 1"), "mixed-grams", n // 2)
    mixed_kinds = kinds.join(groups, "g").select("first._k", "first._c", F.struct("g", "x", "n", "d", "first.pos", "first.before", "first.after").alias("a"))
    wanted = mixed_kinds.groupBy("_k", "_c").agg(F.collect_list("a").alias("at"))
    around = stored(surroundings(bodies, wanted), "around", n)
    # a join of its own, which can be split at a passage that is everywhere
    alike = (F.col("before") == F.col("first.before")) & (F.col("after") == F.col("first.after"))
    copies = some.join(kinds.where("n > 1").select("g", "x", "first"), ["g", "x"])
    copies = copies.select(
        "_k", "_c", (F.col("pos") - F.col("before")).alias("begin"), (F.col("pos") + F.col("after")).alias("stop"),
        F.col("first._k").alias("_k2"), F.col("first._c").alias("_c2"), (F.col("first.pos") - F.col("before")).alias("begin2"), alike.alias("alike"),
    )
    copies = stored(copies, "copies", n)
    discard(some, kinds, groups)
    hot, hot_claims = hot_groups(around.where(F.col("d") > HOT), length, turn)
    every = copies.select("_k", "_c", "begin", "stop").unionByName(sorted_groups(around.where(F.col("d") <= HOT), length)).unionByName(hot)
    return every, copies.where(~F.col("alike")).isEmpty(), copies.drop("alike").unionByName(hot_claims)


def deduplicate(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _k, _c, n_bytes, n_removed, n_spans, removed array of (begin, stop), kept binary) of every row."""
    bodies, found = spans(docs, length, doc_id, text)
    kind = bodies.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "_k", "_c", "n_bytes", "n_removed", "n_spans", "removed", "kept"]
        span = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes, removed, counts, unions, kept = [], [], [], [], []
                for body, cover in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                    raw = (body or "").encode()
                    union = union_of((s["begin"], s["stop"]) for s in cover or ())
                    edges = [0, *(e for u in union for e in u), len(raw)]
                    sizes.append(len(raw))
                    removed.append(sum(b - a for a, b in union))
                    counts.append(len(union))
                    unions.append([{"begin": a, "stop": b} for a, b in union])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(unions, span), pa.array(kept, pa.binary())], names=names)

    schema = T.StructType([kind, T.StructField("_k", T.LongType()), T.StructField("_c", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType())]))), T.StructField("kept", T.BinaryType())])
    return bodies.join(found, ["_k", "_c"], "left").select("_k", "_c", "doc_id", "text", "spans").mapInArrow(task(run), schema)
