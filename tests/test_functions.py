"""Scalar functions: globs in both dialects, paths, names, hashes and dates."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archsieve.functions import dates, globs, hashing, names, paths

TABLE = [  # pattern, path, without and with separators
    ("src/*.ts", "src/a.ts", True, True), ("src/*.ts", "src/x/a.ts", True, False), ("src/**/*.ts", "src/a.ts", True, True), ("src/**/*.ts", "src/x/y/a.ts", True, True), ("**/a.ts", "a.ts", True, True),
    ("src/**", "src/x/y", True, True), ("a?c", "a/c", True, False), ("a?c", "abc", True, True), ("*.test.ts", "x/a.test.ts", True, False), ("src/a.ts", "src/a_ts", False, False), ("core/*", "core/api/v1", True, False),
    ("src/{api,app}/**", "src/app/x/y.ts", True, True), ("src/{api,app}/**", "src/apq/x.ts", False, False), ("src/[a]pp/*.ts", "src/app/x.ts", True, True), ("[!ab].ts", "c.ts", True, True), ("[!ab].ts", "a.ts", False, False),
    ("*.{ts,{js,jsx}}", "a.jsx", True, True), ("a,b/{c,d}.ts", "a,b/d.ts", True, True), ("a[!x]b", "a/b", True, False), ("a[^x]b", "ayb", True, True),
]


@pytest.mark.parametrize("pattern,path,loose,strict", TABLE)
def test_globs_in_both_dialects(spark, pattern, path, loose, strict):
    assert bool(re.match(globs.compile_glob(pattern), path)) == loose and bool(re.match(globs.compile_glob(pattern, True), path)) == strict
    row = spark.range(1).select(F.rlike(F.lit(path), globs.glob_column(F.lit(pattern))).alias("loose"), F.rlike(F.lit(path), globs.glob_column(F.lit(pattern), True)).alias("strict")).first()
    assert (row.loose, row.strict) == (loose, strict)


def test_glob_braces_classes_and_faults():
    match = lambda p, s: bool(re.match(globs.compile_glob(p), s))
    assert match("*.{ts,tsx}", "a.tsx") and not match("*.{ts,tsx}", "a.js") and match("[ab].ts", "a.ts") and not match("[!ab].ts", "a.ts") and match(r"\*.ts", "*.ts")
    for bad in ("{a", "a}", "[a", "a\\"):
        with pytest.raises(globs.GlobError):
            globs.compile_glob(bad)


def test_glob_columns_equal_compiled_globs(spark):
    """Random patterns with braces of any depth, classes and escaped signs, in both dialects; and the directories of their matches."""
    rng = random.Random(4)
    pieces = ["a", "b", "/", "/", "*", "**", "?", ".", "{", "}", ",", "{a,b}", "[a]", "[!b]", "[{]", "[a-c]", "\\*", "\\{", "/**/", "$", "+", "(", "^", "|", "]"]
    known = ["src/{a,b{c,d{e,f}}}/x.ts", "src/{a,{b,{c,{d,e}}}}/x.ts", "src/{[{],b}.ts", "src/\\*.ts", "{a,b}/{a,b/b}/**", "{a,b", "a}b{", "a/{b,/c", "[a", "{a,{b,c}/d}/*"]
    patterns = known + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    names = ["src/a/x.ts", "src/bde/x.ts", "src/bc/x.ts", "src/d/x.ts", "src/{.ts", "src/*.ts", "a/b", "a", "b", "a/b/b", "b/a", "a/b/c.ts", "a*", "{", "a.b", "ab", "aab/ba", "/a", "a/", "{a,b", "a{b", "a}b{", "b/d/a"]
    names += ["".join(rng.choice("aab/.{") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    table = spark.createDataFrame([(g,) for g in set(patterns)], "g string").select("g", *[globs.glob_column(F.col("g"), strict).alias(f"rx{int(strict)}") for strict in (False, True)], globs.static_directories(F.col("g")).alias("dirs")).repartition(8)
    rows = table.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in set(names)], "n string"))).select("g", "n", F.rlike("n", F.col("rx0")).alias("loose"), F.rlike("n", F.col("rx1")).alias("strict"), "dirs").collect()
    compared = 0
    for r in rows:
        for strict, got in ((False, r.loose), (True, r.strict)):
            try:
                want = bool(re.search(globs.compile_glob(r.g, strict).removesuffix("$") + r"\Z", r.n))
            except globs.GlobError:
                continue
            compared += 1
            assert got == want, (r.g, r.n, strict)
        if r.loose or r.strict:
            assert any(d == "" or r.n.startswith(d + "/") for d in r.dirs), (r.g, r.n, r.dirs)
    assert compared > 50_000
    dirs = {r.g: r.dirs for r in table.where(F.col("g").isin(known)).collect()}
    assert dirs["{a,b}/{a,b/b}/**"] == ["a/a", "a/b/b", "b/a", "b/b/b"] and dirs["src/{a,b{c,d{e,f}}}/x.ts"] == ["src"] and dirs["{a,b"] == [""]


@given(st.text(alphabet="ab/.-", min_size=1, max_size=12))
def test_a_glob_without_signs_is_the_text(text):
    assert re.match(globs.compile_glob(text, True), text)


def test_fingerprints(spark):
    assert hashing.sha256_hex("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    row = spark.createDataFrame([("r", "error", None, "f", None, "m", None, 3)], "rule string, severity string, message string, from_file string, to_file string, from_module string, to_module string, line int")
    assert row.select(hashing.violation_fingerprint().alias("f")).first().f == hashing.fingerprint_text(["r", "Error", None, "f", None, "m", None])
    assert hashing.canonical({"b": 1, "a": [2, {"d": None, "c": "é"}]}) == '{"a":[2,{"c":"é","d":null}],"b":1}'


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(names.package(lit("@a/b/c/d"))) == "@a/b" and one(names.package(lit("lodash/fp"))) == "lodash" and one(names.package(lit("./x"))) is None
    assert one(names.subpath(lit("@a/b/c/d"))) == "c/d" and one(names.depth(lit("c//d"))) == 2 and one(names.subpath(lit("lodash"))) is None
    assert one(names.is_builtin(lit("node:fs/promises"))) and not one(names.is_builtin(lit("left-pad"))) and one(names.first_segment(lit("/ /core/api"))) == "core"
    assert one(paths.collapsed(lit("a/b/../c/./d"))) == "a/c/d" and one(paths.ancestors(lit("a/b/c.ts"))) == ["", "a", "a/b"] and one(paths.ancestors(lit("c.ts"))) == [""]
    assert one(paths.relative_to(lit("C\\x\\y"), "C/x")) == "y" and one(paths.skipped(lit("a/node_modules/b/c.js"))) and not one(paths.skipped(lit("a/dist/c.js"), ("dist",)))
    assert [r.p for r in spark.createDataFrame([("a-b",), ("a/b",)], "p string").orderBy(paths.sort_key(F.col("p"))).collect()] == ["a/b", "a-b"]
    assert one(names.tidy(F.array(lit(" b"), lit("a"), lit("b"), lit(" ")))) == ["a", "b"]


def test_names_that_paths_suggest(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(paths.last_part(lit(p))) for p in (" /a/b/ ", "a", "//", "", "a / ")] == ["b", "a", None, None, "a"]
    assert one(paths.in_order(F.array(lit("b\\c"), lit("b/a")))) == ["b/a", "b/c"]
    assert [one(paths.of_policy(lit(p))) for p in ("a.mts", "a.mjs", "a.spec.yml", "a.yml", "ats")] == [True, False, True, False, False]
    assert one(paths.named_by_spec(lit("modules/modules/a/b.spec.yml"))) == "a/b" and one(paths.named_by_spec(lit("a.yml"))) == "a.yml"
    assert one(paths.below_spec(lit(" ././/a.spec.yml "))) == "a" and one(paths.below_spec(lit(".spec.yml"))) is None
    assert [one(globs.static_prefix(lit(g))) for g in ("./src/{a,b}/*.ts", "/a/[b]", "**", " ")] == ["src/{a,b}/", "a/", None, None]
    assert globs.faults(["a/**", "{a", "[b"]) and not globs.faults(["a/**"])


def test_a_digest_of_rows_knows_no_order(spark):
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "x"), (2, None)], [(2, None), (1, "x")]))
    of = lambda df: df.agg(hashing.of_rows("k", "v").alias("h")).first().h
    assert of(a) == of(b) != of(a.where("k = 1")) and of(a.where("k > 2")).startswith("sha256:")


@pytest.mark.parametrize("text,state", [(None, "no_expiry"), ("2024-02-30", "no_expiry"), ("2024-1-1", "no_expiry"), ("2024-01-09", "expired"), ("2024-01-10", "expiring"), ("2024-02-09", "expiring"), ("2024-02-10", "active")])
def test_expiry(spark, text, state):
    assert spark.range(1).select(dates.expiry(F.lit(text).cast("string"), F.lit("2024-01-10").cast("date")).alias("x")).first().x == state
