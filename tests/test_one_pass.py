"""Baselines that were made of the findings themselves: told from one reading of the line items, as the general operators tell them."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from archsieve.functions import dates
from archsieve.operators import baselines
from archsieve.plans import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def as_large(spark):
    """Tables are joined by shuffles, as large ones are."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """How often line items are read, and by how many keys large tables are dealt out."""
    text = plan(df)
    return len(re.findall(r"FileScan parquet \[l_", text)), len(re.findall(r"Exchange hashpartitioning\((?!n_|r_|module)", text))


@pytest.fixture
def found(spark):
    rows = [("f", 1, "a"), ("f", None, "a"), ("f", 9, "a"), ("f", 2, "a"), ("f", 2, "a"), ("g", 7, "b"), ("h", 3, "b"), ("h", 8, "b"), ("k", 4, "c")]
    expires = {"f": None, "g": None, "h": "1999-12-31", "k": "2000-02-30"}
    made = [(f, line, near, expires[f]) for f, line, near in rows]
    return spark.createDataFrame(made, "fingerprint string, line int, near string, expires_at string")


TODAY = datetime.date(2000, 1, 1)
ACCEPTED = "coalesce(line <= 4, false)"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["baseline_refresh"])
def test_refresh_reads_line_items_once(as_large, name):
    # line items meet orders, suppliers and customers: two exchanges each
    assert shuffles(tables.QUERIES[name](as_large, SF)) == (1, 6)


def test_own_refresh_is_refresh(found):
    owner = F.concat(F.lit("team"), F.col("line").cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("reason", "added_at")]
    old = found.where(ACCEPTED).select("fingerprint", F.col("line").alias("position"), owner.alias("owner"), "expires_at", *none)
    columns = ("fingerprint", "line", "owner")
    want = rows(baselines.refresh(found.drop("expires_at"), old, order=("line",)).select(*columns))
    got = rows(baselines.refresh_own(found, F.expr(ACCEPTED), {"position": F.col("line"), "owner": owner}, order=("line",), near=("near",)).select(*columns))
    assert got == want and ("f", 1, "team2") in got and ("f", 9, None) in got


def test_paths_of_edges_are_not_shuffled(as_large):
    """Keys and flags are; a path behind an exchange would be a column of it."""
    edges = tables.tables.edges(as_large, SF)
    assert not [x for x in plan(edges).split("\n") if "Exchange hashpartitioning" in x and "_file" in x]


def test_own_staleness_is_staleness(as_large, found):
    today = F.lit(TODAY)
    late = dates.is_expired(F.col("expires_at"), today)
    want = rows(baselines.staleness(found.where("line <> 2"), found.where(ACCEPTED), today))
    assert rows(baselines.staleness_own(found, F.col("line") != 2, F.expr(ACCEPTED), late, near=("near",))) == want == [(5, 1, 3, 1)]
    assert shuffles(tables.QUERIES["baseline_stale"](as_large, SF)) == (1, 6)


def test_own_classification_is_classification(as_large, found):
    today = F.lit(TODAY)
    columns = ("fingerprint", "line", "disposition")
    want = rows(baselines.classify(found.drop("expires_at"), found.where(ACCEPTED), today, order=("line",)).select(*columns))
    accepted = F.expr(ACCEPTED) & ~dates.is_expired(F.col("expires_at"), today)
    got = rows(baselines.classify_own(found, accepted, order=("line",), near=("near",)).select(*columns))
    assert got == want and ("f", None, "baseline") in got and ("f", 9, "new") in got and ("h", 3, "new") in got
    assert shuffles(tables.QUERIES["baseline_classify"](as_large, SF)) == (1, 6)


def test_diff_lines_read_line_items_once_and_store_nothing(as_large):
    assert shuffles(tables.QUERIES["diff_lines"](as_large, SF)) == (1, 6)


def test_report_reads_findings_for_its_lines_and_once_for_its_counts(as_large):
    assert shuffles(tables.QUERIES["verdict_report"](as_large, SF)) == (2, 12)
