"""Operators on hand-made rows: polarity of changes, baselines, graphs, ownership, validation."""

import pytest
from pyspark.sql import functions as F

from archsieve.operators import baselines, contracts, graphs, layering, ownership, resolve, snapshots, violations

DAY = "2024-01-10"
CASES = [  # field, type, before, after, classes
    ("public_api", "array<string>", ["a"], ["a", "b"], ["widening"]), ("never_imports", "array<string>", ["a"], ["b"], ["narrowing", "widening"]), ("allow_imports_from", "array<string>", None, [], ["narrowing"]),
    ("allow_imports_from", "array<string>", ["a"], None, ["widening"]), ("allow_imports_from", "array<string>", ["a"], ["a", "b"], ["widening"]), ("allow_imported_by", "array<string>", ["a"], [], ["widening"]),
    ("allow_imported_by", "array<string>", [], ["a"], ["narrowing"]), ("visibility", "string", "public", "private", ["narrowing"]), ("visibility", "string", "internal", "public", ["widening"]),
    ("enforce_in_tests", "boolean", True, False, ["widening"]), ("enforce_in_tests", "boolean", False, True, ["narrowing"]), ("severity", "string", "warning", "error", ["narrowing"]), ("envelope", "string", "required", "optional", ["widening"]),
    ("exclude", "array<string>", [], ["x"], ["widening"]), ("spec_dirs", "array<string>", [], ["x"], ["narrowing"]), ("unresolved_edge_policy", "string", "error", "ignore", ["widening"]), ("stale_baseline", "string", "warn", "fail", ["narrowing"]),
    ("public_api", "array<string>", ["a", "b"], ["b", "a"], []),
]


@pytest.mark.parametrize("name,kind,before,after,classes", CASES)
def test_polarity(spark, name, kind, before, after, classes):
    side = lambda v: spark.createDataFrame([("m", v)], f"module string, `{name}` {kind}")
    assert sorted(r.classification for r in snapshots.diff(side(before), side(after)).collect()) == classes


def test_new_and_removed_specs_limits_and_paths(spark):
    a, b = (spark.createDataFrame(r, "module string, most long, note string") for r in ([("x", 1, "p"), ("gone", 1, "p")], [("x", None, "q"), ("new", 2, "p")]))
    got = {(r.module, r.field): r.classification for r in snapshots.diff(a, b, structural=("note",), limits=("most",)).collect()}
    assert got == {("x", "most"): "widening", ("x", "note"): "structural", ("gone", "spec"): "widening", ("new", "spec"): "structural"}
    p = lambda rows: spark.createDataFrame(rows, "module string, path string")
    cover = snapshots.path_coverage(p([("m", "1"), ("n", "1"), ("o", "1"), ("same", "1")]), p([("m", "1"), ("m", "2"), ("o", "2"), ("same", "1")]))
    assert {r.module: r.classification for r in cover.collect()} == {"m": "widening", "n": "narrowing", "o": "structural"}
    assert snapshots.summary(snapshots.diff(a, b, limits=("most",))).first().net == "widening"


def test_compensation(spark):
    spec = "module string, never_imports array<string>, public_api array<string>, visibility string"
    base = [("a", ["x"], [], "private"), ("b", [], [], "public"), ("c", ["y"], [], None), ("d", [], [], None), ("e", [], [], None), ("p", [], ["a", "b"], None), ("q", [], ["c"], None), ("r", [], ["a", "b"], None), ("s", [], ["b", "c"], None), ("t", ["k"], [], None), ("u", [], [], None), ("v", ["m"], [], "public")]
    head = [("a", [], [], "public"), ("b", ["x"], [], "private"), ("c", [], [], None), ("d", ["y"], [], None), ("e", ["y"], [], None), ("p", [], ["b", "c"], None), ("q", [], [], None), ("r", [], ["b", "c"], None), ("s", [], ["a", "b"], None), ("t", ["k", "l"], [], None), ("u", ["k", "l"], [], None), ("v", ["m"], [], "internal")]
    changes = snapshots.diff(spark.createDataFrame(base, spec), spark.createDataFrame(head, spec))
    near = spark.createDataFrame([("b", "a"), ("c", "d"), ("c", "e"), ("p", "q"), ("r", "s"), ("t", "u"), ("a", "v"), ("a", "a")], "a string, b string")
    got = sorted((r.widened, r.narrowed, r.field, r.result) for r in snapshots.compensations(changes, near).collect())
    # c: two narrowings each fit its one widening; p and q: {a, c} is not {c}; r and s widen and narrow by the same {a, c}, both ways
    assert got == [("a", "b", "never_imports", "offset"), ("a", "b", "visibility", "offset"), ("c", "d", "never_imports", "ambiguous"), ("c", "e", "never_imports", "ambiguous"), ("r", "s", "public_api", "offset"), ("s", "r", "public_api", "offset")]


def test_compensation_that_is_ambiguous(spark):
    """A narrowing that fits two widenings, and two offsets of one module and field with different signatures."""
    spec = "module string, field string, subject string, classification string, detail string, signature string"
    changes = [("n", "f", None, "narrowing", "", "s"), ("w", "f", None, "widening", "", "s"), ("v", "f", None, "widening", "", "s"), ("m", "match", "1", "widening", "", "x"), ("m", "match", "2", "widening", "", "y"), ("o", "match", "1", "narrowing", "", "x"), ("o", "match", "2", "narrowing", "", "y")]
    changes += [("g", "constraints.severity", "k1", "widening", "", "z"), ("h", "constraints.severity", "k2", "narrowing", "", "z"), ("i", "constraints.severity", "k1", "narrowing", "", "z"), ("j", "spec", None, "widening", "removed", None), ("k", "spec", None, "narrowing", "added", None)]
    near = spark.createDataFrame([("n", "w"), ("v", "n"), ("m", "o"), ("g", "h"), ("g", "i"), ("j", "k")], "a string, b string")
    got = snapshots.compensations(spark.createDataFrame(changes, spec), near)
    assert sorted((r.widened, r.narrowed, r.signature, r.result) for r in got.collect()) == [("g", "i", "z", "offset"), ("m", "o", "x", "ambiguous"), ("m", "o", "y", "ambiguous"), ("v", "n", "s", "ambiguous"), ("w", "n", "s", "ambiguous")]


def violations_of(spark, rows):
    return spark.createDataFrame([(f, "r", "error", "m", "a.ts", line) for f, line in rows], "fingerprint string, rule string, severity string, message string, from_file string, line int").withColumn("to_file", F.lit(None).cast("string"))


def test_baseline_is_a_bag(spark):
    found = violations_of(spark, [("f", 1), ("f", 2), ("f", None), ("g", 1), ("h", 1)])
    entries = spark.createDataFrame([("f", None, None), ("f", "2024-01-10", "me"), ("g", "2024-01-09", None), ("gone", "bad", None)], "fingerprint string, expires_at string, owner string").withColumn("reason", F.lit("x"))
    got = {(r.fingerprint, r.line): r.disposition for r in baselines.classify(found, entries, F.lit(DAY).cast("date")).collect()}
    assert got == {("f", None): "baseline", ("f", 1): "baseline", ("f", 2): "new", ("g", 1): "new", ("h", 1): "new"}
    assert tuple(baselines.staleness(found, entries, F.lit(DAY).cast("date")).first()) == (4, 1, 2, 1)
    audit = baselines.audit(entries, F.lit(DAY).cast("date")).first()
    assert (audit.entries, audit.gaps, audit.expired, audit.expiring, audit.no_expiry) == (4, 3, 1, 1, 2)


def test_legacy_fingerprints_serve_only_without_new_ones(spark):
    found = violations_of(spark, [("f", 1), ("g", 1)]).withColumn("old", F.lit("legacy"))
    entries = spark.createDataFrame([("f", None), ("legacy", None)], "fingerprint string, expires_at string")
    got = {r.fingerprint: r.disposition for r in baselines.classify(found, entries, F.lit(DAY).cast("date"), legacy="old").collect()}
    assert got == {"f": "baseline", "g": "baseline"}


def test_components_match_a_plain_search(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
        reach = {n: set() for n in range(30)}
        for a in reach:
            todo = [a]
            while todo:
                for x, y in edges:
                    if x == todo[0] and y not in reach[a]:
                        reach[a].add(y)
                        todo.append(y)
                todo.pop(0)
        want = {}
        for n in range(30):
            same = {m for m in reach[n] if n in reach[m]} | {n}
            if len(same) > 1:
                want[n] = min(same)
        got = graphs.components(spark.createDataFrame(sorted(edges), "a long, b long"))
        assert {r.node: r.component for r in got.collect()} == want


def test_reachable_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "a long, b long")
    got = graphs.reachable(edges, spark.createDataFrame([(1,)], "node long"))
    assert {r.node: r.depth for r in got.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_circular_scopes(spark):
    cycles = spark.createDataFrame([("a", "a -> b", 1), ("c", "c -> d", 2), ("e", "e -> f", 0)], "component string, members string, n_modules long")
    declared = spark.createDataFrame([("m", "internal", "error"), ("n", "external", "error"), ("o", "both", "warning")], "module string, scope string, severity string")
    assert sorted((r.from_module, r.from_file) for r in layering.circular(cycles, declared).collect()) == [("m", "a"), ("n", "c"), ("o", "a"), ("o", "c"), ("o", "e")]


def test_severity_is_the_strictest_of_the_responsible_module(spark):
    found = spark.createDataFrame([("boundary.never_imports", "a", "b"), ("boundary.visibility.private", "a", "b"), ("other", "a", "b")], "rule string, from_module string, to_module string").withColumn("severity", F.lit(None).cast("string"))
    rules = spark.createDataFrame([("a", "boundary.never_imports", "warning"), ("b", "boundary.never_imports", "error"), ("b", "boundary.visibility.private", "warning"), ("b", "boundary.visibility.private", "error")], "module string, rule string, severity string")
    assert {r.rule: r.severity for r in violations.with_severity(found, rules).collect()} == {"boundary.never_imports": "warning", "boundary.visibility.private": "error", "other": "error"}


def test_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/c.js",), ("lib/x.ts",)], "path string")
    wants = [("src", "./a", "first_party", "src/a.ts"), ("src", "./a.js", "first_party", "src/a.ts"), ("src/b", "..", "unresolved", None), ("src", "./b", "first_party", "src/b/index.ts"), ("src", "./zz", "unresolved", None), ("src", "node:fs", "third_party", None), ("src", "pkg/x", "third_party", None), ("src", "nopkg", "unresolved", None), ("src", "@lib/x", "first_party", "lib/x.ts"), ("src", "fs", "third_party", None)]
    got = resolve.resolve(spark.createDataFrame([w[:2] for w in wants], "directory string, specifier string"), files, spark.createDataFrame([("pkg",)], "package string"), spark.createDataFrame([("@lib/", "lib/"), ("@", "no/")], "prefix string, replacement string"))
    assert {(r.directory, r.specifier): (r.kind, r.target) for r in got.collect()} == {w[:2]: w[2:] for w in wants}


def test_contradictions_and_conflicts(spark):
    owners = spark.createDataFrame([("a", "src/x/**"), ("b", "src/x/**"), ("c", "src/**/k.ts"), ("d", "lib/**")], "module string, glob string")
    files = spark.createDataFrame([("src/x/k.ts",), ("src/y.ts",)], "path string")
    got = {(r.module_a, r.module_b, r.kind) for r in ownership.contradictions(owners, files).collect()}
    assert got == {("a", "b", "equal"), ("a", "c", "shared file"), ("b", "c", "shared file")}
    assert [r.path for r in ownership.unclaimed(files, owners).collect()] == ["src/y.ts"] and [r.module for r in ownership.orphans(files, owners).collect()] == ["d"]


def test_contract_conflicts(spark):
    schema = "module string, id string, direction string, envelope string, imports_contract array<string>"
    body = [("a", "1", "inbound", "required", ["p:x", "p:y"]), ("b", "1", "Inbound", "required", ["p:x"]), ("c", "2", "inbound", "optional", ["p:x"]), ("c", "2", "inbound", "optional", ["p:x"]), ("d", "", None, "optional", ["p:z", "p:y"]), ("e", "2", "inbound", "required", None)]
    rows = spark.createDataFrame(body, schema)
    got = {(r.reference, r.direction, r.envelope): (r.module, r.contract, r.members, r.against) for r in contracts.reference_classes(rows).collect()}
    assert got == {
        ("p:x", "inbound", "required"): ("a", "1", 2, ["inbound/optional"]), ("p:x", "inbound", "optional"): ("c", "2", 1, ["inbound/required"]), ("p:y", "inbound", "required"): ("a", "1", 1, ["/optional"]),
        ("p:y", "", "optional"): ("d", "", 1, ["inbound/required"]),
    }
    assert sorted((r.reference, r.module, r.first_module) for r in contracts.reference_members(rows).collect()) == [("p:x", "a", "a"), ("p:x", "b", "a"), ("p:x", "c", "c"), ("p:y", "a", "a"), ("p:y", "d", "d")]
    assert sorted(tuple(r) for r in contracts.shared_ids(rows).collect()) == [("1", "a", "a", 2), ("1", "b", "a", 2), ("2", "c", "c", 2), ("2", "e", "c", 2)]
    assert contracts.conflicts(rows).count() == 2 + 4 and contracts.conflicts(rows.where("false")).count() == 0


def test_contract_conflicts_of_a_star(spark):
    """Many consumers of one contract: as many rows as consumers."""
    k = F.col("id")
    star = spark.range(100_000).select(F.concat(F.lit("m"), k.cast("string")).alias("module"), F.lit("c").alias("id"), F.when(k % 2 == 0, "inbound").otherwise("outbound").alias("direction"), F.when(k % 3 == 0, "required").otherwise("optional").alias("envelope"), F.array(F.lit("p:x")).alias("imports_contract"))
    assert contracts.reference_classes(star).count() == 4 and contracts.reference_members(star).count() == 100_000
