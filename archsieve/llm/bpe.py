"""Byte-level BPE encoding and decoding by merge replay.

The words of a slice of the corpus (a task's rows, in chunks) are laid out as one flat array of
byte tokens. An inverted index lists, for each merge rank, the positions where a pair of that rank
stands. Merges are replayed once over the whole slice in rank order; a merge touches only the pairs
to its left and right. Words never influence each other, so the slice's size does not change any id:
it only sets how many words one replay serves. Each distinct word is replayed once a task.

Null and empty texts give no ids. Repeated rows give repeated results. Very long texts and very long
words are handled whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from archsieve.llm.common import tidy

#: Distinct words kept with their ids in a task before all but those of its latest rows go.
KEPT_WORDS = 300_000
#: Rows whose new words share one replay.
ROWS = 512

#: The letters, digits and white space of Latin-1, for texts that hold nothing else.
LETTER, DIGIT, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Replays the merges of a rank table over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (of one byte at least)."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(raw)
        token = self.byte[raw].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        starts = [0, *ends[:-1].tolist()]
        for s, e in zip(starts, ends.tolist()):
            before[s] = after[e - 1] = -1
        # the inverted index: rank of a pair -> positions of its left token
        rank = self.first[raw[:-1], raw[1:]]
        rank[ends[:-1] - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        index: dict[int, list[int]] = {}
        if len(at):
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                index[int(rank[part[0]])] = part.tolist()
        pair, todo = self.pair.get, sorted(index)
        while todo:
            now = heapq.heappop(todo)
            places = index.pop(now, None)
            if places is None:
                continue
            places.sort()
            hold: list[int] = []  # places in words where a merge made a pair of lower rank, which comes first
            until = -1
            for p in places:
                q = after[p]
                if q < 0 or token[p] < 0 or pair(token[p] << 32 | token[q]) != now:
                    continue
                if p < until:
                    hold.append(p)
                    continue
                r, o = after[q], before[p]
                token[p], token[q], after[p] = now, -1, r
                if r >= 0:
                    before[r] = p
                    new = pair(now << 32 | token[r])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(todo, new)
                        if new < now:
                            until = int(ends[np.searchsorted(ends, p, side="right")])
                if o >= 0:
                    new = pair(token[o] << 32 | now)
                    if new is not None:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heapq.heappush(todo, new)
                        if new < now:
                            until = int(ends[np.searchsorted(ends, p, side="right")])
            if hold:
                index.setdefault(now, []).extend(hold)
                heapq.heappush(todo, now)
        return [[t for t in token[s:e] if t >= 0] for s, e in zip(starts, ends.tolist())]


def splitter(pattern: str):
    """The matches of the tokenizer's pattern; texts of Latin-1 alone take an equal pattern of plain classes."""
    from public_tokenizers import PATTERN

    whole = regex.compile(pattern).findall
    latin = LATIN.findall if pattern == PATTERN else whole
    return lambda text: (whole if BEYOND_LATIN.search(text) else latin)(text)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        replay, split = MergeReplay(ranks), splitter(pattern)
        known: dict[str, bytes] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                words = [split(t or "") for t in part.column(1).to_pylist()]
                new = list({w for ws in words for w in ws if w not in known})
                raw = [w.encode() for w in new]
                merged = []
                for w, b in zip(new, raw):
                    if (whole := ranks.get(b)) is not None:  # a word that is a token takes no merges
                        known[w] = whole.to_bytes(4, "little")
                    else:
                        merged.append((w, b))
                for (w, _), ids in zip(merged, replay.encode([b for _, b in merged]) if merged else ()):
                    known[w] = np.array(ids, dtype="<u4").tobytes()
                out = [b"".join([known[w] for w in ws]) for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                if len(known) > KEPT_WORDS:  # what the latest rows hold comes again most likely
                    known = {w: known[w] for ws in words for w in ws}

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The encoded rows with ``decoded`` (binary): the bytes of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: b for b, rank in read_ranks(ranks_path).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = part.column(part.schema.get_field_index("ids")).to_pylist()
                out = [b"".join([token[i] for i in np.frombuffer(x or b"", dtype="<u4").tolist()]) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
