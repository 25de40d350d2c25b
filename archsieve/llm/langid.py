"""Language identification by compression.

For each language a raw-content zstandard dictionary is built from lower-cased training texts. A text
is lower-cased and cut into blocks, each block is compressed with every dictionary, and the language with the fewest bytes
in all wins. A narrow margin over the second is marked as rejected.

Training reads a bounded sample of labelled rows: about ``SAMPLE_ROWS`` different texts a language, chosen by a hash of
the text. These are read whole: they fall into chunks of ``CHUNK`` characters, and the ``CHUNKS`` of a language with the
least hashes, from anywhere in its texts, are its dictionary. Prediction reads whole texts.
Null texts and texts without a letter are ``und`` with score 0. With no training rows, all are. Ties
go to the first language in order. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from archsieve.llm.common import texts, tidy

SAMPLE_ROWS, CHUNK, CHUNKS = 300, 500, 200
BLOCK_BYTES, LEVEL = 1_024, 3
#: A margin under this share of the second best size is narrow.
NARROW = 0.01
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]").search


def learn(train: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content."""
    usable = train.select(train[lang].alias("lang"), train[text].alias("text")).where("lang is not null and text is not null and text <> ''")
    hashed = usable.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return {}
    # a share of each language's different texts, by a hash that is the same in every run
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE_ROWS / max(n, 1)) if n > SAMPLE_ROWS else 1.0))])[F.col("lang")]
    chosen = hashed.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    chunks = chosen.select("lang", "h", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("place", "chunk"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("h", "place"), "h", "place"))
    out: dict[str, list[bytes]] = {k: [] for k in sorted(sizes)}
    for r in chunks.withColumn("rank", rank).where(F.col("rank") <= CHUNKS).orderBy("lang", "rank").collect():  # at most CHUNKS a language
        out[r["lang"]].append(r["chunk"].lower().encode())
    return {k: b"\n".join(v) for k, v in out.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): score is the best size's margin, 0 to 1."""
    names = sorted(dictionaries)
    held = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in names])  # bounded: languages x CHUNKS x CHUNK characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for content in held.value:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            for part, bodies in texts(batch):
                out = [], [], []
                for t in bodies:
                    best, score, rejected = UNKNOWN, 0.0, True
                    if names and (ASCII_LETTER(t) or any(map(str.isalpha, t))):
                        raw = t.lower().encode()
                        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
                        size = sorted((sum([len(c(b)) for b in blocks]), k) for k, c in enumerate(coders))
                        margin = 1 - size[0][0] / size[1][0] if len(size) > 1 else 1.0
                        best, score, rejected = names[size[0][1]], margin, margin < NARROW
                    for column, x in zip(out, (best, score, rejected)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
