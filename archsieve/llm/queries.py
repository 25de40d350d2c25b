"""The registered queries of the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archsieve.llm import bpe, chat, decontam, fim, hyperminhash, langid, lmscore, ordinal, phrases, rules, sql, suffix, tokens, warc
from archsieve.llm.common import scratch, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, dictionaries).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.grade(docs, ordinal.fit(docs, ordinal.graded(table(spark, sf_dir, "labels"))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(rules.statistics(table(spark, sf_dir, "documents")), "rule-counts")
    found = rules.learn(counts, table(spark, sf_dir, "labels"))
    failed = rules.base_failed()
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.verdict(found)).alias("kept"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and toxic = 0")
    return lmscore.score(table(spark, sf_dir, "documents"), good.select("doc_id"), across=True)


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch(spark, "warc")
    warc.write(pages, folder)
    return warc.read(spark, folder, pages.schema["page_id"].dataType).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicate(table(spark, sf_dir, "documents"))
    # a cut can go through a character: its rest is dropped from the text, never from the digest
    kept = F.col("kept").cast("string")
    left = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left.alias("text"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicate(table(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the conversations are rows of turns; the one beside them is a record of JSON, and has marks for its texts
    marks = chat.END + chat.START + "assistant ok"
    record = json.dumps({"messages": [{"role": role, "content": marks} for role in ("user", "assistant")]})
    rows = chat.from_table(table(spark, sf_dir, "conversations"), ("role", "text"), ("conv_id", "turn"))
    beside = chat.from_json(spark.range(-1, 0).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(record).alias("record")), "record", ("conv_id", "turn"))
    back = chat.read(chat.format(chat.assemble(rows.union(beside), "conv_id", "turn")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


NAMES = (
    op1_language_id, op2_token_counts, op3_quality_ordinal, op4_decontamination, op5_quality_rules, op6_lm_scoring, op7_warc_writer, op8_byte_bpe, op9_suffix_dedup, op10_hyperminhash, op11_fill_in_middle,
    op12_collocations, op13_chat_format,
)
QUERIES = {f.__name__: f for f in NAMES}
ORACLES: dict[str, str] = sql.SQL
