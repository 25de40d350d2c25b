"""Walks through JSON by rows, against a plain walk; limits; canonical JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from archsieve.functions import hashing
from archsieve.operators import traces


def plain_walk(value, edges, records):
    if isinstance(value, dict):
        text = lambda names: next((value[n] for n in names if isinstance(value.get(n), str)), None)
        a, b, s = text(traces.FROM), text(traces.TO), text(traces.SPECIFIER)
        if a and b:
            edges.append((a, b))
        if a and s:
            records.append((a, s, text(traces.KIND), text(traces.TARGET), text(traces.PACKAGE)))
    for inner in [value[k] for k in sorted(value)] if isinstance(value, dict) else value if isinstance(value, list) else ():
        plain_walk(inner, edges, records)


def random_value(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["x", "", 1, None, True, 2.5])
    if rng.random() < 0.4:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    keys = rng.sample([*traces.FROM, *traces.TO, *traces.SPECIFIER, *traces.KIND, *traces.TARGET, *traces.PACKAGE, "other", "a b"], rng.randint(0, 8))
    return {k: rng.choice(["p", "q", "r", "", 7]) if rng.random() < 0.7 else random_value(rng, depth - 1) for k in keys}


def files(spark, texts):
    return spark.createDataFrame([(f"f{i:03d}", t) for i, t in enumerate(texts)], "file string, value string")


def test_walk_equals_a_plain_walk(spark):
    rng = random.Random(3)
    bodies = [random_value(rng, 6) for _ in range(70)]
    lines = "\n".join(json.dumps({"from": f"a{i}", "import": "b"}) for i in range(30)) + "\n\n"
    edges, records = traces.walk(traces.values(files(spark, [*map(json.dumps, bodies), lines, "", " \n\t"])))
    want_edges, want = [], []
    for i, body in enumerate(bodies):
        found = []
        plain_walk(body, want_edges, found)
        want += [(f"f{i:03d}", *f) for f in found]
    want += [("f070", f"a{i}", "b", None, None, None) for i in range(30)]
    assert sorted(tuple(r) for r in edges.collect()) == sorted(want_edges) and len(want_edges) > 20
    assert [(r.file, r["from"], r.specifier, r.kind, r.target, r.package) for r in records.orderBy("file", "at").collect()] == want


def test_limits_and_faults(spark):
    deep = {"from": "a", "to": "b"}
    for _ in range(12):
        deep = [deep]
    rows = traces.values(files(spark, [json.dumps(deep)]))
    assert [tuple(r) for r in traces.walk(rows, deepest=13)[0].collect()] == [("a", "b")]
    with pytest.raises(traces.TraceError, match="deep"):
        traces.walk(rows, deepest=12)
    wide = traces.values(files(spark, [json.dumps([0] * 2000), json.dumps([0] * 1999)]))
    assert traces.walk(wide, most_nodes=2001)[0].count() == 0
    with pytest.raises(traces.TraceError, match="f000 has more"):
        traces.walk(wide, most_nodes=2000)
    for bad in ("{no", "{no\n{json", "[1]\nx", '{"from": "a"} x', "1, 2", "1] x", '1, "x": 2', "1}", "[1"):
        with pytest.raises(traces.TraceError, match="neither"):
            traces.values(files(spark, [bad]))
    none = files(spark, ["1"]).where("false")
    assert traces.walk(traces.values(none))[1].count() == 0


def test_first_rows_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("a.ts").alias("from"), (F.col("id") % 3).cast("string").alias("specifier"), F.col("id").cast("int").alias("at"), F.lit("l").alias("line"))
    got = traces.snapshot_lines(rows)
    assert got.count() == 3 * 48 and got.agg(F.max("at")).first()[0] == 3 * 48 - 1
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_canonical_json(spark):
    pairs = [('{"b": [1, {"y": 1, "x": null}], "a": "é"}', '{"a":"é","b":[1,{"x":null,"y":1}]}', True), ("[1, 2]", "[2, 1]", False), ('{"a": 1}', '{"a": "1"}', False), ('{"a": {}}', '{"a": []}', False), (" 5 ", "5", True)]
    for a, b, same in pairs:
        row = spark.range(1).select(hashing.json_digest(F.lit(a)).alias("a"), hashing.json_digest(F.lit(b)).alias("b"), hashing.canonical_json(F.lit(a)).alias("text")).first()
        assert (row.a == row.b) == same and json.loads(row.text) == json.loads(a)
    row = spark.range(1).select(hashing.json_digest(F.lit('{"a": 1} {')).alias("x"), hashing.canonical_json(F.lit('{"b":1,"a":[2,{"d":null,"c":"é"}]}')).alias("y")).first()
    assert row.x is None and row.y == hashing.canonical({"b": 1, "a": [2, {"d": None, "c": "é"}]})
