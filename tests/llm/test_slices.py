"""Slices of op12 are large rows: no job may read or send many of them at once."""

from archsieve.llm import phrases

READER = "spark.sql.parquet.columnarReaderBatchSize"
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_slices_are_read_and_sent_alone(spark, monkeypatch):
    before, seen, real = (spark.conf.get(READER), spark.conf.get(ARROW)), {}, phrases.stored

    def stored(df, what, **more):
        seen[what] = (spark.conf.get(READER), int(spark.conf.get(ARROW)))
        return real(df, what, **more)

    monkeypatch.setattr(phrases, "stored", stored)
    docs = spark.createDataFrame([("en", "a b c a b c. a b c")] * 3, "lang string, text string")
    got = {(r.phrase, r.a) for r in phrases.mine(docs, least=9, words=3).collect()}
    assert got == {("a b c", 9)}
    counts = [seen[f"phrases-{k}"] for k in (1, 2, 3)]
    assert all(rows == "1" and size <= 1 << 20 for rows, size in counts)
    assert (spark.conf.get(READER), spark.conf.get(ARROW)) == before
