"""Token counts with a digest cache.

A cache table holds (content digest, tokenizer digest, count). Documents are joined to it by the
digest of their normalised text; of the texts that miss, each distinct one is encoded once, appended
to the cache and joined back. A tokenizer's digest covers its file and the normalisation, so a new
version never reads old counts.

Null counts as empty. Copies share one digest and are encoded once; repeated rows give repeated
results. Texts are encoded whole. An empty table leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archsieve.llm.common import stored as written
from archsieve.llm.common import texts, tidy

CACHE = "content string, tokenizer string, n_tokens long"
#: Distinct pieces of text kept with their counts in a task before the table starts anew.
KEPT_PIECES = 200_000
#: SentencePiece's sign for a space.
MARK = "▁"


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def piece_counter(path: str):
    """texts -> numbers of tokens, as SentencePiece gives them.

    If no piece of the vocabulary has a space after another sign, no merge can cross the place before
    a run of spaces, and text falls into parts that are encoded alone: each distinct part once. Such a
    part starts with one space less, for the library puts one before every text.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = [library.id_to_piece(i) for i in range(library.vocab_size())]
    parted = not any(re.search(f"[^{MARK}]{MARK}", p) for p in vocabulary) and library.encode("a  b c", out_type=str) == [MARK + "a", MARK, MARK + "b", MARK + "c"]
    parts = re.compile(" +[^ ]*|[^ ]+").findall
    known: dict[str, int] = {" ": 1}

    def count(batch: list[str]) -> list[int]:
        if not parted:
            return [len(x) for x in library.encode(batch, num_threads=1)]
        if len(known) > KEPT_PIECES:
            known.clear()
            known[" "] = 1
        cut = [None if MARK in t or not t.strip(" ") else parts(t) for t in batch]
        new = list({p for c in cut if c for p in c[1:] if p not in known})
        known.update(zip(new, map(len, library.encode([p[1:] for p in new], num_threads=1))))
        heads = [t if c is None else c[0] if c else "" for t, c in zip(batch, cut)]
        return [len(h) + (sum([known[p] for p in c[1:]]) if c else 0) for h, c in zip(library.encode(heads, num_threads=1), cut)]

    return count


def json_counter(path: str):
    """texts -> numbers of tokens, as the tokenizers library gives them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda batch: [len(x.ids) for x in library.encode_batch(batch, add_special_tokens=False)]


def normalised(text):
    """The text whose digest is the cache's key. Null is the empty text; anything more could change counts."""
    return F.coalesce(text, F.lit(""))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``cache`` is the path of the cache table, which grows by the misses."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    body = normalised(docs[text])
    rows = docs.select(docs[doc_id].alias("doc_id"), F.sha2(body, 256).alias("content"), F.octet_length(body).cast("long").alias("n_bytes"))
    empty = spark.createDataFrame([], CACHE)
    empty.write.mode("append").parquet(cache)  # makes the table where there is none
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    # all copies of a content become one row before any text moves; what the cache has goes, the rest is encoded
    contents = docs.select(F.sha2(body, 256).alias("content"), body.alias("text")).groupBy("content").agg(F.any_value("text").alias("text"))
    misses = contents.join(stored.select("content"), "content", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (piece_counter if tokenizer.endswith(".model") else json_counter)(tokenizer)
        for batch in batches:
            for part, bodies in texts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(bodies), pa.int64())], names=["content", "n_tokens"])

    fresh = misses.select("content", "text").mapInArrow(tidy(run), "content string, n_tokens long")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that the join with the rows can be split at a content that many rows have
    counts = written(counts, "token-counts")
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
