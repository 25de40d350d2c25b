"""Phrase collocations, mined level by level.

A pass counts the phrases of k words; the next one counts a phrase of k + 1 words only where both phrases of k words inside it are
frequent. All tasks get the frequent ones of a pass as a map of ``2 ** map_bits`` hashed bits, 32 MB however large the corpus is: a
bit set by chance only has a phrase counted that its own count then drops, so results are exact at any size. Texts are split once,
into slices of numbered words, and tasks count slices before anything is shuffled; phrases are counted by their words, and the
tables of all levels give every cut its score. The best phrases of a language come from groups of it that are ranked alone.

Everything is per language; a null language is ``und``, a null text is empty. Repeated rows count each time. Ties follow score,
count and phrase, so ranks are the same in each run. A language without a frequent phrase, and an empty table, give no rows. Other
columns are not read. Texts are read whole, one at a time.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.llm.common import batches_up_to, settings, stored, tidy

#: Signs that end a piece become full stops, A-Z lower case; words are what stands between those and spaces or tabs.
BREAKS = b".,;:!?\n\v\f\r"
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + BREAKS, string.ascii_lowercase.encode() + b"." * len(BREAKS))
#: Bits of the number of a place in the map of frequent phrases.
PLACES = 28
#: Words of a slice; a task holds the numbers of one slice.
SLICE = 500_000
#: Bytes of texts that go to Python in a batch; a slice is more, and goes alone.
BATCH_BYTES = 1 << 20
#: Words whose hashes a task keeps.
KNOWN = 200_000
#: Phrases that go from Python to Spark in a batch.
ROWS = 25_000
NUMBER = np.dtype("<i4")
COUNTS = "lang string, phrase string, n long"
#: Groups of a language's phrases that are ranked alone before the best of all meet: SALTS * top rows a language at most.
SALTS = 64


def folded_words(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8 with A-Z in lower case, and a full stop for each break. No byte of a longer character is one of ASCII,
    and of the blanks of ASCII, at which bytes are split, only space and tab are left."""
    return raw.translate(FOLD).replace(b".", b" . ").split()


class Numbers(dict):
    """A word -> its number. Breaks are 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word.decode())
        return number


def shift(i: int) -> int:
    """How far the hash of the i-th word of a phrase moves before all are laid over each other."""
    return 9 * i


def place(words: Column, k: int, map_bits: int) -> Column:
    """The place in the map of a phrase, an array of k words."""
    hashes = [F.shiftrightunsigned(F.xxhash64(F.col("lang"), words[i]), shift(i)) for i in range(k)]
    return reduce(Column.bitwiseXOR, hashes).bitwiseAND(F.lit((1 << map_bits) - 1))


class Hashes(dict):
    """A word of a language -> its hash, as Spark gives it."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word.encode(), seed=self.seed)
        return value


def places(words: list[str], known: Hashes, numbers: np.ndarray, k: int, size: int) -> np.ndarray:
    """The same for the k words at each place of a slice; size: places in the map."""
    one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(numbers) - k + 1, dtype=np.uint64)
    for i in range(k):
        out ^= (one >> np.uint64(shift(i)))[numbers[i : len(numbers) - k + 1 + i]]
    return (out & np.uint64(size - 1)).astype(np.int64)


def words_of(words: list[str], numbers: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice with their counts, and their sum without a word."""
    count = np.bincount(numbers, minlength=len(words))
    count[0] = 0
    there = np.flatnonzero(count)
    return pa.array([*map(words.__getitem__, there.tolist()), None], pa.string()), np.append(count[there], count.sum())


def phrases_of(words: list[str], known: Hashes, numbers: np.ndarray, k: int, frequent: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The phrases of k words in a slice that can be frequent, with their counts. frequent: the bits of those of k - 1 words."""
    if len(numbers) < k:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    here = len(numbers) - k + 1
    whole = numbers[:here] > 0
    for i in range(1, k):
        whole &= numbers[i : here + i] > 0
    at = places(words, known, numbers, k - 1, 8 * len(frequent))
    bit = (frequent[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)
    whole &= (bit[:-1] & bit[1:]).astype(bool)
    starts = np.flatnonzero(whole)
    bits, key, table = len(words).bit_length(), numbers[starts], pa.array(words, pa.string())
    if k * bits <= 63:  # the numbers of all words are in the key
        for i in range(1, k):
            key = key << bits | numbers[starts + i]
        key, count = np.unique(key, return_counts=True)
        return pc.binary_join_element_wise(*[table.take(pa.array(key >> bits * (k - 1 - i) & (1 << bits) - 1)) for i in range(k)], " "), count
    width = bits
    for i in range(1, k):
        if width + bits > 63:
            _, key = np.unique(key, return_inverse=True)
            width = len(starts).bit_length()
        key = key << bits | numbers[starts + i]
        width += bits
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    first = starts[first]
    return pc.binary_join_element_wise(*[table.take(pa.array(numbers[first + i])) for i in range(k)], " "), count


def sliced(docs: DataFrame, slice_words: int = SLICE) -> DataFrame:
    """(lang, words, numbers): slices of a task's texts of one language, as the words in them and the numbers of these, one after
    another, with 0 for breaks. Texts are read and split once; all passes read the slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (known, parts) in slices.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([known.words], pa.list_(pa.string())), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["lang", "words", "numbers"])
            slices.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if (name := lang.as_py()) not in slices:
                    slices[name] = (Numbers(), [])
                known, parts = slices[name]
                words = folded_words(text.as_buffer().to_pybytes())
                parts.append(np.append(np.fromiter(map(known.__getitem__, words), dtype=NUMBER, count=len(words)), NUMBER.type(0)))
                held += len(words) + 1
                if held >= slice_words:
                    yield from flushed()
                    held = 0
        yield from flushed()

    lang, text = F.coalesce(F.col("lang"), F.lit("und")), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(tidy(run), "lang string, words array<string>, numbers binary")


def counted(slices: DataFrame, k: int, frequent=None, slice_words: int = SLICE) -> DataFrame:
    """(lang, phrase, n) of each slice for the phrases of k words; at k = 1 a row without a phrase has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, dtype=np.uint8)
        known: dict[str, Hashes] = {}
        for batch in batches:
            for lang, words, numbers in zip(*batch.columns):
                lang, words, numbers = lang.as_py(), words.as_py(), np.frombuffer(numbers.as_buffer(), dtype=NUMBER).astype(np.int64)
                if sum(map(len, known.values())) > KNOWN:
                    known.clear()
                hashes = known.setdefault(lang, Hashes(lang))
                for begin in range(0, len(numbers), slice_words):  # the slice of one very long text is cut again
                    part = numbers[begin : begin + slice_words + k - 1]
                    found, count = words_of(words, part) if k == 1 else phrases_of(words, hashes, part, k, bits)
                    for start in range(0, len(found), ROWS):
                        n = len(part := found.slice(start, ROWS))
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), part, pa.array(count[start : start + n], pa.int64())], names=["lang", "phrase", "n"])

    return slices.mapInArrow(tidy(run), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap(phrases: DataFrame, k: int, map_bits: int = PLACES) -> bytes:
    """The map of frequent phrases: 2 ** (map_bits - 6) rows at most come to the driver, whatever the corpus."""
    at = phrases.select(place(F.split("phrase", " "), k, map_bits).alias("at"))
    taken = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (map_bits - 6), dtype=np.int64)
    out[taken["word"].to_numpy()] = taken["bits"].to_numpy()
    return out.astype("<i8").tobytes()


def levels(docs: DataFrame, least: int, words: int, slice_words: int, map_bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, k, phrase, f): the numbers of all words, and the phrases of 1 to ``words`` words that occur ``least`` times.
    Tables are stored in here, with batches of one slice."""
    with batches_up_to(docs.sparkSession, BATCH_BYTES):
        return passes(docs, least, words, slice_words, map_bits)


def one_by_one(spark: SparkSession):
    """Jobs started inside read one row of a Parquet file at a time. A slice has megabytes, and a reader's usual batch would decode all
    slices of a file at once, into arrays that double as they grow."""
    return settings(spark, spark__sql__parquet__columnarReaderBatchSize="1")


def passes(docs: DataFrame, least: int, words: int, slice_words: int, map_bits: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    slices = stored(sliced(docs, slice_words), "phrase-slices", compression="zstd")
    with one_by_one(spark):
        first = stored(counted(slices, 1, None, slice_words).where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases-1")
    totals = first.where("phrase is null").select("lang", "n")
    tables = [first.where("phrase is not null")]
    for k in range(2, words + 1):
        frequent = spark.sparkContext.broadcast(bitmap(tables[-1], k - 1, map_bits))
        with one_by_one(spark):
            tables.append(stored(counted(slices, k, frequent, slice_words).where(F.col("n") >= least), f"phrases-{k}"))
        frequent.unpersist()
    every = [t.select("lang", F.lit(k).alias("k"), "phrase", F.col("n").alias("f")) for k, t in enumerate(tables, 1)]
    return totals, reduce(DataFrame.union, every)


def mine(docs: DataFrame, least: int = 30, words: int = 4, top: int = 2000, inside_percent: int = 80, slice_words: int = SLICE, map_bits: int = PLACES, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``words`` (5 at most) words.

    a: occurrences; l and r: those of both parts of the cut with the lowest score ``2000000 * a div (l + r)``. A phrase inside a
    longer one that occurs at least ``inside_percent`` as often is left out.
    """
    if not 2 <= words <= 5:
        raise ValueError("phrases have 2 to 5 words")
    totals, every = levels(docs.select(docs[lang].alias("lang"), docs[text].alias("text")), least, words, slice_words, map_bits)
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    candidates = every.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # decimals, for the product may pass 64 bits; the quotient is 1,000,000 at most
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: part(s, m))))
    inner = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    within = F.expr(f"cast(100 as decimal(19,0)) * longer >= cast({inside_percent} as decimal(19,0)) * a")
    left = scored.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(within, F.lit(False)))
    rank = lambda *group: F.row_number().over(W.partitionBy(*group).orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
