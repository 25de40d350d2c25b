"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet
in the shared folder and hands it to the next. All stages but the last return the columns of documents.
Nulls, empty texts and repeated rows follow the operators. A stage on an empty table returns an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archsieve.llm import bpe, decontam, hyperminhash, ordinal, suffix
from archsieve.llm.common import keyed, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Repeated strings of so many bytes are cut out: short enough for a passage of 50 words.
PASSAGE_BYTES = 200


def whole(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row as one struct, so that no column of it clashes with those of an operator."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["text"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    model = ordinal.fit(docs, ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal.grade(whole(docs), model, keep=("row",)).where("selected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (word shingles of five, similarity 0.8): that with the smallest id. Rows
    that repeat id and text are one document and stay together; of a group without any id one text stays."""
    keep = hyperminhash.deduplicate(docs).where("kept").select("_k", "_c").distinct()
    rows = whole(docs)
    return rows.select("row", *keyed(rows)).join(keep, ["_k", "_c"], "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without bytes of strings that occur elsewhere too. A character that a cut goes through is dropped;
    a null text stays null."""
    found = suffix.deduplicate(docs, PASSAGE_BYTES).where("n_removed > 0").select("_k", "_c", "kept").dropDuplicates(["_k", "_c"])
    rows = whole(docs)
    rows = rows.select("row", *keyed(rows)).join(found, ["_k", "_c"], "left")
    kept = F.col("kept").cast("string")
    cut = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    row = F.col("row").withField("text", cut)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("kept").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select("_k", "_c").distinct()
    rows = whole(docs)
    return rows.select("row", *keyed(rows)).join(bad, ["_k", "_c"], "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact): the byte-level BPE ids of each text, decoded again to see that they are whole."""
    ranks = public_tokenizers.path(RANKS)
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    # UTF-8 of the ids' bytes says that decoding gave a text back
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.is_valid_utf8(F.col("decoded").cast("string")).alias("intact"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_free", benchmark_free), ("token_ids", token_ids)]
#: SQL expresses neither the fitted classifier nor BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
