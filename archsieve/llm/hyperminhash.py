"""Near-duplicates with HyperMinHash sketches.

A text's word shingles are hashed; each of ``REGISTERS`` buckets keeps, under a hash function of its own, the
least value as its number of leading zeros and the next ``MANTISSA`` bits: 16 bits a bucket. Bands of
``ROWS`` compressed registers give candidate pairs; the share of equal registers, corrected for
accidental collisions, discards pairs far below the threshold, and the rest is confirmed on the full
shingle sets. Links make components by label propagation with pointer jumping.

Groups of any size: copies with one shingle set are one vertex from the start (partial aggregation). In two rounds each bucket's
leader, the member that meets the most others in all its buckets, is compared with the members of other components; the original of many edits
leads them. That only makes components few: afterwards every pair of a bucket that is in two components is compared, large buckets in
cells of ``CELL`` times ``CELL`` members, so no candidate is left uncompared. First registers tell which members have anything left to
compare with, then these alone come with their texts and are compared in place; no pair becomes a row, only links do. Copies cost about one
comparison each; a bucket of n look-alikes that are no copies costs n * n / 2 comparisons of registers, dealt over its cells.
A pair of similarity 0.8 shares no band with a probability of 5e-8.

Empty and null texts have no shingles, link with nothing and stay. Rows without an id take part like others, but never name a component in
which any row has an id; where none has, component_id is null and one row is kept. Repeated rows share a component; rows of
one id with several texts each follow their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from archsieve.llm.common import checkpointed, gathered, keyed, stored, tidy

BANDS, ROWS, MANTISSA = 32, 4, 10
REGISTERS = BANDS * ROWS
KEPT_WORDS = 100_000
#: Standard deviations under the threshold at which an estimate discards a pair.
DEVIATIONS = 5
#: Rounds of leaders, and the bands of the first one.
ROUNDS, FIRST_BANDS = 2, 4
#: Members of a bucket that meet in one cell, and rows of smaller buckets that share a task's group.
CELL, GROUP = 1000, 4000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
P = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(7)
MULTIPLY = (_random.integers(1, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Text -> sorted distinct hashes of its word shingles."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        words = text.encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.size, len(words))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = mixed(out * P + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's least value."""
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(base), 4096):
        least = np.minimum(least, (base[None, i : i + 4096] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # place of the leading one, 0 for none
    zeros = np.uint64(32) - bits
    mantissa = ((least.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash for each band of registers; the band's number is part of it."""
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * P + rows[:, i])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of sketches, corrected for registers that agree by accident."""
    equal = (a == b).mean(axis=1)
    # registers of unrelated sets agree if zeros do (as often as they do here across buckets) and so does the mantissa
    za, zb = a >> MANTISSA, b >> MANTISSA
    accident = np.mean([(za == np.roll(zb, s, axis=1)).mean(axis=1) for s in (1, 17, 53)], axis=0) / (1 << MANTISSA)
    return ((equal - accident) / (1 - accident)).clip(0, 1)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(_k, _c, doc_id, n_shingles, digest of the set, bands, registers) of rows (_k, _c, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingles(t or "") for t in part.column(3).to_pylist()]
                found = [registers(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([None if r is None else bands(r) for r in found], pa.list_(pa.int64())), pa.array([None if r is None else r.tobytes() for r in found], pa.binary()),
                    ],
                    names=["_k", "_c", "doc_id", "n_shingles", "digest", "bands", "registers"],
                )

    schema = T.StructType([*docs.schema.fields[:3], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType())])
    return docs.select("_k", "_c", "doc_id", "text").mapInArrow(tidy(run), schema)


def side(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.col("v").alias(name), F.col(value).alias(f"{value}_{name}"))


def pair_schema(pairs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("a", pairs.schema["a"].dataType), T.StructField("b", pairs.schema["b"].dataType)])


def minimum(percent: int) -> float:
    """The least estimate that does not rule the threshold out."""
    return percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5


def likely(pairs: DataFrame, registers_of: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose corrected estimate does not rule the threshold out."""
    floor = minimum(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(estimate(x, y) >= floor))

    both = pairs.join(side(registers_of, "a", "registers"), "a").join(side(registers_of, "b", "registers"), "b")
    return both.select("a", "b", "registers_a", "registers_b").mapInArrow(tidy(run), pair_schema(pairs))


def confirmed(near: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        sets: dict[object, tuple[str, np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = []
                for a, b, x, y in zip(*(part.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))):
                    got = []
                    for v, t in ((a, x), (b, y)):
                        if v not in sets or sets[v][0] != t:
                            if len(sets) > 200:
                                sets.clear()
                            sets[v] = t, shingles(t)
                        got.append(sets[v][1])
                    both = len(np.intersect1d(*got, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(got[0]) + len(got[1]) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = near.join(side(bodies, "a", "text"), "a").join(side(bodies, "b", "text"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(tidy(run), pair_schema(near))


def near_equal(x: np.ndarray, y: np.ndarray, band: int, floor: float) -> np.ndarray:
    """Which rows of sketches may be near, and share no band before this one."""
    first = (x == y).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
    first[first] = estimate(x[first], y[first]) >= floor
    return first


def cells(buckets: DataFrame) -> DataFrame:
    """(cell, lo, hi, h, band, v, component, block): the buckets' rows dealt into cells. A bucket of up to ``CELL`` members lies in one cell, which it
    shares with others; a larger one is cut into blocks, and each two blocks meet in a cell of their own (each block alone too)."""
    sizes = stored(buckets.groupBy("h").agg(F.count("*").alias("n")), "rest-sizes")
    groups = max(1, (sizes.where(F.col("n") <= CELL).agg(F.sum("n").alias("n")).first()["n"] or 0) // GROUP)
    cut = F.ceil(F.col("n") / CELL).cast("long")
    rows = buckets.join(sizes, "h").withColumn("cut", cut).withColumn("block", F.pmod(F.xxhash64("v"), F.col("cut")))
    rows = rows.withColumn("cell", F.when(F.col("cut") == 1, F.pmod("h", F.lit(groups))).otherwise(F.col("h")))
    rows = rows.select("cell", "h", "band", "v", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)).alias("other"))
    return rows.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "h", "band", "v", "component", "block")


def meetings(table: pa.Table, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a cell sorted by h: members of two components that may be near and share no band before this one."""
    lo, hi = (table[k][0].as_py() for k in ("lo", "hi"))
    h, band, block = (table[k].to_numpy() for k in ("h", "band", "block"))
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
    sketch = np.frombuffer(b"".join(table["registers"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    ends = np.append(np.flatnonzero(np.diff(h)) + 1, len(h))
    for start, end in zip(np.append(0, ends[:-1]), ends):
        if (component[start:end] == component[start]).all():
            continue
        here = np.arange(start, end)
        for i in here:  # in a cell of two blocks the first meets the second, else each member those after it
            if lo != hi and block[i] != lo:
                continue
            others = here[block[here] == hi] if lo != hi else here[i + 1 - start :]
            others = others[component[others] != component[i]]
            if len(others):
                found = others[near_equal(np.broadcast_to(sketch[i], (len(others), REGISTERS)), sketch[others], band[i], floor)]
                if len(found):
                    yield i, found


CELL_ROW = ("cell", "lo", "hi", "h", "band", "v", "component", "block")


def open_members(rows: DataFrame, registers_of: DataFrame, percent: int) -> DataFrame:
    """The rows of ``cells`` whose registers do not rule out all members of other components in their cell: at most as many rows as came in."""
    floor = minimum(percent)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        open_ = np.zeros(table.num_rows, dtype=bool)
        for i, found in meetings(table, floor):
            open_[i] = open_[found] = True
        return table.filter(pa.array(open_)).select(CELL_ROW)

    return rows.join(registers_of, "v").select(*CELL_ROW, "registers").groupBy("cell", "lo", "hi").applyInArrow(run, rows.select(*CELL_ROW).schema)


def settled(members: DataFrame, registers_of: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the members of each cell, by full sets: enough of them that every pair of a cell that reaches the threshold ends in one
    component, so fewer than members. No pair becomes a row."""
    floor = minimum(percent)
    kind = members.schema["v"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        shingles = Shingles(size)
        v, text = table["v"].to_pylist(), table["text"]
        known: dict[object, np.ndarray] = {}
        for i, x in enumerate(v):
            if x not in known:
                known[x] = shingles(text[i].as_py())
        sets = [known[x] for x in v]
        n = np.array([len(s) for s in sets])
        root: dict[object, object] = {}

        def find(x: object) -> object:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        component = table["component"].to_pylist()
        out = []
        for i, found in meetings(table, floor):
            mine = find(component[i])
            found = found[100 * np.minimum(n[i], n[found]) >= percent * np.maximum(n[i], n[found])]
            found = [j for j in found.tolist() if find(component[j]) != mine]
            if not found:
                continue
            at = np.cumsum([0, *n[found]])
            flat = np.concatenate([sets[j] for j in found])
            place = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), at[:-1])
            for j in np.array(found)[100 * both >= percent * (n[i] + n[found] - both)].tolist():
                if (mine := find(component[i])) != (other := find(component[j])):
                    root[mine] = other
                    out.append((min(v[i], v[j]), max(v[i], v[j])))
        return pa.table({k: pa.array([p[x] for p in out], table["v"].type) for x, k in enumerate("ab")})

    whole = members.join(registers_of, "v").join(bodies, "v").select(*CELL_ROW, "registers", "text")
    return whole.groupBy("cell", "lo", "hi").applyInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(v, component): the least vertex that links (a, b) reach, for every linked vertex."""
    n = 2 * links.count()
    edges = checkpointed(gathered(links.union(links.select("b", "a")).distinct(), n))
    labels = checkpointed(gathered(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")), n))
    while True:
        heard = edges.join(labels, edges["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("heard"))
        low = labels.join(heard, "v").select("v", F.least("component", "heard").alias("low"), "component")
        jump = labels.select(F.col("v").alias("low"), F.col("component").alias("further"))
        moved = low.join(jump, "low", "left").select("v", F.least("low", "further").alias("component"), (F.least("low", "further") < F.col("component")).alias("moved"))
        new = checkpointed(gathered(moved, n))
        labels = new.select("v", "component")
        if new.where("moved").isEmpty():
            return labels


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_k, _c, doc_id, n_shingles, component_id, kept) of every row; kept marks the smallest id of a component."""
    keys = docs.select(*keyed(docs, doc_id, text), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    sketch = stored(sketches(keys, size), "sketches")
    n_rows = sketch.count()
    # a vertex is a set; the row with its smallest id stands for it
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "_k", "_c")).alias("row")
    vertices = stored(sketch.where("n_shingles > 0").groupBy(F.col("digest").alias("v")).agg(stands, F.any_value("bands").alias("bands"), F.any_value("registers").alias("registers")), "near-classes", n_rows)
    rows = vertices.select("v", F.posexplode("bands").alias("band", "h"))
    # stored before the join, which then has shuffles of its own and can be split at a bucket that holds a large part of all rows
    shared = stored(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    n_open = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    weight = F.sum("n").over(W.partitionBy("v"))
    open_rows = stored(rows.join(shared, "h").select("v", "band", "h", weight.alias("weight")), "near-buckets", n_open)
    # texts and registers of vertices that share a bucket; the hint keeps one plan at all sizes
    met = stored(open_rows.select("v").distinct(), "near-vertices", n_rows)
    known = vertices.select("v", "row._k", "row._c", "registers").join(met, "v")
    registers_of = stored(known.select("v", "registers"), "near-registers", n_rows)
    # repeated rows collapse before they move
    once = keys.groupBy("_k", "_c").agg(F.any_value(F.coalesce("text", F.lit(""))).alias("text"))
    bodies = stored(once.join(known.select("_k", "_c", "v").hint("merge"), ["_k", "_c"]).select("v", "text"), "near-texts", n_rows)
    links = labels = checked = None

    def labelled() -> DataFrame:
        return open_rows.withColumn("component", F.col("v")) if labels is None else open_rows.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))

    for turn in range(ROUNDS):
        here = labelled()
        if turn == 0:  # a few bands join most copies, so that all bands then meet far fewer components
            here = here.where(F.col("band") < FIRST_BANDS)
        first = F.max_by(F.struct("v", "component"), F.struct(F.col("weight"), F.xxhash64("v")))
        # stored before the join, for the same reason as the counts
        lead = stored(here.groupBy("h").agg(first.alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h", "lead"), "near-leaders", n_open // 2)
        pairs = here.join(lead, "h").where("component <> lead.component").select(F.least("v", "lead.v").alias("a"), F.greatest("v", "lead.v").alias("b")).distinct()
        pairs = stored(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "near-pairs", n_open)
        checked = pairs
        near = stored(likely(pairs, registers_of, percent), "near-likely", n_open)
        new = checkpointed(gathered(confirmed(near, bodies, size, percent), n_open))
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            labels = components(links)
    # whatever the leaders left: after this no pair of a bucket is in two components without having been compared
    here = stored(labelled().select("v", "h", "band", "component"), "near-rest", n_open)
    rest = stored(here.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h"), "near-rest-buckets", n_open // 2)
    members = stored(open_members(cells(here.join(rest, "h")), registers_of, percent), "near-open")
    new = checkpointed(settled(members, registers_of, bodies, size, percent))
    if not new.isEmpty():
        links = new if links is None else links.union(new)
        labels = components(links)
    heads = vertices.select("v", "row")
    if labels is not None:
        linked = labels.join(heads, "v")
        names = stored(linked.groupBy("component").agg(F.min("row").alias("first")), "near-names", n_rows)
        heads = heads.join(linked.join(names, "component").select("v", "first"), "v", "left").select("v", F.coalesce("first", "row").alias("row"))
    # stored, so that the join with the rows can be split at a set that many rows have
    heads = stored(heads.select(F.col("v").alias("digest"), F.col("row").alias("first")), "near-heads", n_rows)
    found = sketch.drop("bands", "registers").join(heads, "digest", "left")
    component = F.coalesce("first.doc_id", "doc_id")
    same_row = (F.col("_k") == F.col("first._k")) & (F.col("_c") == F.col("first._c"))
    kept = F.when(F.col("first").isNull(), True).when(F.col("first.lost"), same_row).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return found.select("_k", "_c", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
