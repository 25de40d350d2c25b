"""The registered queries themselves: against SQL where it can express them, else against plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from archsieve.llm import bpe, queries, rules
from tests.llm import brute
from tests.oracle import expected, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = rows(queries.QUERIES[name](spark, SF)), expected(queries.ORACLES[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def found(spark, name):
    got = queries.QUERIES[name](spark, SF).collect()
    out = {r.doc_id: r for r in got}
    assert len(out) == len(got)
    return out


def test_op1(spark, documents):
    got = found(spark, "op1_language_id")
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        text = documents[i].text
        assert (r.lang_pred == "und") == (not text or not any(map(str.isalpha, text)))
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in held]) > 0.85


def test_op2(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = found(spark, "op2_token_counts")
    counts = {i: len(library.encode(r.text or "")) for i, r in documents.items()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len((r.text or "").encode()), counts[i], counts[i] > 4096) for i, r in documents.items()}


def test_op3(spark, documents):
    got = found(spark, "op3_quality_ordinal")
    assert got.keys() == documents.keys() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    good = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r.selected == (good[i] == (1, 0)) for i, r in got.items() if i in good]
    assert np.mean(right) > 0.9


def test_op5(spark, documents):
    """The counts by a plain version; what is kept by reading the learned rules as plain comparisons."""
    got = found(spark, "op5_quality_rules")
    want = {i: brute.op5(r.text) for i, r in documents.items()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()} == want
    assert not any(r.kept and r.base_failed for r in got.values()) and any(r.kept for r in got.values()) and not all(r.kept or r.base_failed for r in got.values())
    learned = rules.learn(rules.statistics(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet"))
    again = {r.doc_id: r.kept for r in rules.statistics(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", (~rules.base_failed() & rules.verdict(learned)).alias("kept")).collect()}
    assert {i: r.kept for i, r in got.items()} == again


def test_op8(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = found(spark, "op8_byte_bpe")
    for i, r in got.items():
        ids = np.array(library.encode_ordinary(documents[i].text or ""), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((documents[i].text or "").encode()).hexdigest())
