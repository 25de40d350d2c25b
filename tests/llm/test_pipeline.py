"""Pipeline stages on odd and empty tables, and the whole on the smallest data."""

import corpus_pipeline
import pytest

from tests.llm import brute


@pytest.fixture(scope="module")
def folder(labels, benchmark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    labels.write.parquet(f"{d}/labels.parquet")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty(spark, odd, none, folder, name, stage):
    out = stage(spark, odd, folder)
    assert 0 < out.count() <= odd.count()
    empty = stage(spark, none, folder)
    assert empty.count() == 0
    if name != "token_ids":
        assert out.columns == odd.columns == empty.columns and out.schema == odd.schema


def test_stages_decide_as_brute_force(spark, odd, rows, folder):
    free = corpus_pipeline.benchmark_free(spark, odd, folder).count()
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert free == sum(not found[4] for found in brute.op4([r[1] for r in rows], items))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, folder).select("doc_id").collect()} - {None}
    body = {i: t for i, t, *_ in rows if i is not None}
    assert kept == {i for i, found in zip(body, brute.op10(list(body), list(body.values()), k=5)) if found[2]}
    texts = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, odd, folder).collect()}
    want = dict(zip((r[0] for r in rows), brute.op9([r[1] for r in rows], corpus_pipeline.PASSAGE_BYTES)))
    for i, t in body.items():
        assert (texts[i] is None) == (t is None)
        assert (texts[i] or "") == (t or "") if want[i][1] == 0 else len((texts[i] or "").encode()) <= want[i][0] - want[i][1]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:3] == ["doc_id", "n_tokens", "ids"] and 50 < out.count() < 200 and out.where("not intact").count() == 0
