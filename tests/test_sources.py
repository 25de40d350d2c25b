"""Baselines, references and faulty globs, read back as they were written."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from archsieve.operators import validate
from archsieve.sources import project as sources


def test_a_baseline_comes_back(spark, tmp_path):
    names = [x.split()[0] for x in sources.ENTRY.split(", ")]
    entries = spark.createDataFrame([tuple(f"{n}{i}" if n not in ("line", "column") else i for n in names) for i in range(20)], sources.ENTRY)
    sources.write_baseline(entries, str(tmp_path / "b"))
    assert sorted(sources.baseline(spark, str(tmp_path / "b")).collect()) == sorted(entries.collect())
    sources.write_baseline(entries.limit(0), str(tmp_path / "none"))
    assert sources.baseline(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "one.json").write_text('{"version": "1",\n "entries": [{"fingerprint": "f"},\n {"fingerprint": "g"}]}')
    assert sorted(r.fingerprint for r in sources.baseline(spark, str(tmp_path / "one.json")).collect()) == ["f", "g"]
    (tmp_path / "bad.json").write_text("{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.baseline(spark, str(tmp_path / "bad.json")).collect()


def test_files_of_a_reference(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q")
    body = {"a.spec.yml": "x: 1\n", "d/b c.spec.yml": "", "é.spec.yml": "y: é\n\n", "other.ts": "z"}
    for path, text in body.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    run("add", "-A")
    run("commit", "-qm", "one")
    got = {r.path: r.content for r in sources.files_at(spark, str(tmp_path), "HEAD").collect()}
    assert got == {p: t for p, t in body.items() if p.endswith(".yml")}
    with pytest.raises(ValueError):
        list(sources.blobs(str(tmp_path), ["0" * 40]))


@pytest.mark.parametrize("glob,bad", [("a}{b", True), ("{a", True), ("[a", True), ("{a,{b,c}}", False), ("[!a]*", False), ("a/**", False), ("a}", True), ("a]", False)])
def test_bad_globs(spark, glob, bad):
    assert spark.range(1).select(validate.bad_glob(F.lit(glob)).alias("bad")).first().bad == bad


def test_one_object_replaces_a_file_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "baseline.json"
    names = [x.split()[0] for x in sources.ENTRY.split(", ")]
    entries = spark.createDataFrame([tuple((f"{n}{i:03d}é" if i % 3 or n in ("fingerprint", "rule") else None) if n not in ("line", "column") else i for n in names) for i in range(200)], sources.ENTRY).repartition(5)
    sources.write_baseline_file(entries.union(entries), str(path), {"config_hash": "c"})
    raw = json.loads(path.read_text())
    assert (raw["version"], raw["generated_from"]) == ("1", {"config_hash": "c"}) and [e["fingerprint"] for e in raw["entries"]] == [f"fingerprint{i:03d}é" for i in range(200)]
    assert "owner" not in raw["entries"][0] and sorted(map(str, sources.baseline(spark, str(path)).collect())) == sorted(map(str, entries.collect()))
    before = path.read_bytes()
    broken = entries.withColumn("message", F.when(F.col("line") == 150, F.raise_error("no").cast("string")).otherwise(F.col("message")))
    with pytest.raises(Exception, match="no"):
        sources.write_baseline_file(broken, str(path))
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["baseline.json"]
    sources.write_baseline_file(entries.where("false"), str(path))
    assert json.loads(path.read_text())["entries"] == [] and sources.baseline(spark, str(path)).count() == 0
    edges = spark.createDataFrame([("b", "c"), ("a", "b"), ("a", "b")], "a string, b string")
    sources.write_snapshot(edges, str(tmp_path / "trace.json"))
    assert sorted(tuple(r) for r in sources.trace(spark, str(tmp_path / "trace.json"))[0].collect()) == [("a", "b"), ("b", "c")]
