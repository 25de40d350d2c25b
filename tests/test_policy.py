"""Aliases, policy differences of constraints and contracts, comparison of single imports, baselines' lists and reports."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from archsieve.operators import baselines, packages, parity, reports, resolve, snapshots
from archsieve.plans.engine import Project, ProjectError, policy_report
from archsieve.sources import project as sources
from tests.test_engine import write

LISTED = "module string, place int, rule string, params string, severity string, message string"
AGREED = "module string, place int, id string, contract string, files array<string>, pattern string, direction string, envelope string, imports_contract array<string>"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_aliases_of_the_nearest_configuration(spark):
    base = '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*", "lib/*"], "@app/x/*": ["x/*"], "one": ["src/one.ts"], "http/*": ["// no comment/*"]}}} // a comment'
    files = spark.createDataFrame(
        [("base.tsconfig.json", base), ("tsconfig.json", '{"extends": "./base.tsconfig", /* , */ "compilerOptions": {},}'), ("web/tsconfig.json", '{"compilerOptions": {"paths": {"~/*/end": ["./in/*/last"]}}}'), ("bare/tsconfig.json", "{}")], "path string, content string"
    )
    aliases = sources.aliases(files)
    asked = spark.createDataFrame([("src/deep", s) for s in ("@app/a", "@app/b", "@app/x/a", "one", "one/more", "src/a", "./c")] + [("web/s", "~/q/end"), ("web/s", "@app/a"), ("bare", "@app/a")], "directory string, specifier string")
    there = spark.createDataFrame([(p,) for p in ("src/a.ts", "lib/a.ts", "lib/b.ts", "x/a.ts", "src/x/a.ts", "src/one.ts", "src/deep/c.ts", "web/in/q/last.ts")], "path string")
    got = {(r.directory, r.specifier): r.target for r in resolve.resolve(asked, there, None, aliases).collect()}
    assert got == {
        ("src/deep", "@app/a"): "src/a.ts", ("src/deep", "@app/b"): "lib/b.ts", ("src/deep", "@app/x/a"): "x/a.ts", ("src/deep", "one"): "src/one.ts", ("src/deep", "one/more"): None, ("src/deep", "src/a"): "src/a.ts",
        ("src/deep", "./c"): "src/deep/c.ts", ("web/s", "~/q/end"): "web/in/q/last.ts", ("web/s", "@app/a"): None, ("bare", "@app/a"): None,
    }
    ring = spark.createDataFrame([("tsconfig.json", '{"extends": "./b.json"}'), ("b.json", '{"extends": "./tsconfig.json"}')], "path string, content string")
    with pytest.raises(ValueError, match="ring"):
        sources.aliases(ring)


def test_constraints_contracts_and_files(spark):
    base = spark.createDataFrame([("m", 0, "r", "{}", "error", "x"), ("m", 1, "r", "{}", "error", " y "), ("m", 2, "s", "{}", "warning", None), ("m", 3, "t", '{"a": 1}', "error", None)], LISTED)
    head = spark.createDataFrame([("m", 0, " r", "{}", "warning", "y"), ("m", 1, "s", "{}", "error", "new"), ("m", 2, "t", '{"a": 2}', "error", None)], LISTED)
    assert rows(snapshots.constraint_changes(base, head), "field", "subject", "classification") == sorted(
        [("constraints.severity", "r::{}", "widening"), ("constraints.severity", "s::{}", "narrowing"), ("constraints.message", "s::{}", "structural"), ("constraints", 't::{"a": 1}', "structural"), ("constraints", 't::{"a": 2}', "structural")], key=str
    )
    base = spark.createDataFrame([("m", 0, "a", "a.json", ["x", "y"], None, "both", "required", ["n:c"]), ("m", 1, "gone", "g.json", [], None, "both", "optional", [])], AGREED)
    head = spark.createDataFrame([("m", 0, "a", "b.json", ["y", "z"], "f*", "in", "optional", ["n:c", "n:c"]), ("m", 1, "new", "g.json", [], None, "both", "optional", [])], AGREED)
    assert rows(snapshots.contract_changes(base, head), "field", "subject", "classification") == sorted(
        [
            ("contracts", "gone", "widening"), ("contracts", "new", "narrowing"), ("contracts.contract", "a", "structural"), ("contracts.direction", "a", "structural"), ("contracts.envelope", "a", "widening"),
            ("contracts.match.files", "a", "narrowing"), ("contracts.match.files", "a", "widening"), ("contracts.match.pattern", "a", "widening"),
        ], key=str,
    )
    operations = spark.createDataFrame([("D", None, "m/a.spec.yml"), ("R", "b.spec.yml", "c.spec.yml"), ("C", "b.spec.yml", "d.spec.yml"), ("M", None, "e.spec.yml")], "status string, from_path string, to_path string")
    pairing = spark.createDataFrame([("b.spec.yml", "c.spec.yml", "equivalent")], "from_path string, to_path string, result string")
    assert rows(snapshots.file_changes(operations, pairing), "module", "classification") == [("a", "widening"), ("c", "structural"), ("d", "widening")]


def test_what_two_tools_say_of_an_import(spark):
    kinds = [("./a.js", "first_party", "a.ts", "first_party", "a.js"), ("lib", "first_party", "a.ts", "first_party", "x/lib.d.ts"), ("@s/p", "first_party", "a.ts", "first_party", "b.ts"), ("lib", "first_party", "a.ts", "first_party", "b.ts"),
             ("./a", "first_party", "a.ts", "first_party", "b.ts"), ("./a", "unresolved", None, "first_party", "a.ts"), ("./a", "first_party", "a.ts", "not_observed", None), ("p", "third_party", None, "first_party", "p.ts"), ("p", "third_party", None, "third_party", None)]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, s string, ok string, o string, tk string, t string")
    got = [r.c for r in df.select("i", parity.category(*[F.col(c) for c in ("s", "ok", "o", "tk", "t")]).alias("c")).orderBy("i").collect()]
    assert got == ["extension_alias", "condition_names", "paths", "exports", "focused_target_mismatch", "focused_ours_missing", "focused_theirs_missing", "focused_classification_mismatch", "focused_edge_set_diff"]
    asked = spark.createDataFrame([(f, "./x", "x.ts") for f in ("told.ts", "edge.ts", "sole.ts", "many.ts", "none.ts")], "from_file string, specifier string, ours_to string")
    edges = spark.createDataFrame([("edge.ts", "x.ts"), ("edge.ts", "y.ts"), ("sole.ts", "y.ts"), ("many.ts", "y.ts"), ("many.ts", "z.ts")], "a string, b string")
    records = spark.createDataFrame([(0, "told.ts", "./x", "first_party", "x.ts", None), (1, "told.ts", "./x", None, "node_modules/x/i.js", None)], "place int, from string, specifier string, kind string, target string, package string")
    assert rows(parity.theirs(asked, edges, records), "from_file", "source", "theirs_kind", "theirs_to") == [
        ("edge.ts", "edge", "first_party", "x.ts"), ("many.ts", "not_observed", "not_observed", None), ("none.ts", "not_observed", "not_observed", None), ("sole.ts", "sole_edge", "first_party", "y.ts"),
        ("told.ts", "record", "third_party", "node_modules/x/i.js"),
    ]


def test_lists_of_baselines_and_deep_imports(spark):
    entries = spark.createDataFrame([("r", "me", "m", "2024-01-10"), ("r", None, "m", "2023-12-01"), ("s", " ", "n", None), ("s", "me", "n", "soon")], "rule string, owner string, from_module string, expires_at string")
    day = F.lit("2024-01-01").cast("date")
    count = lambda **k: baselines.listed(entries, day, **k).count()
    assert (count(), count(rule="r"), count(owner="me"), count(expired=True), count(expires_within=9), count(expires_within=8), count(module="n", owner="me")) == (4, 2, 2, 1, 1, 0, 1)
    assert rows(baselines.groups(entries, "owner")) == [("<no owner>", 2), ("me", 2)] and rows(baselines.groups(entries, "module")) == [("m", 2), ("n", 2)]
    used = spark.createDataFrame([(f, m, False, s, True) for f, m, s in (("a", "m", "pkg/x/y"), ("b", "n", "pkg/x/y"), ("c", None, "pkg/x/y"), ("d", "o", "pkg/x"), ("e", "o", "other/x"), ("f", "n", "pkg"))], "from_file string, from_module string, from_test boolean, specifier string, runtime boolean")
    own = spark.createDataFrame([("m", 0, "pkg", 2, False), ("n", 0, "p*", None, True), ("o", 0, "other", None, False)], "module string, place int, pattern string, max_depth long, allow boolean")
    assert rows(packages.deep_imports(used, [("pkg", 1, "error")], own), "from_file", "severity") == [("c", "error"), ("e", "warning")]
    assert rows(packages.deep_imports(used, [("pkg", 1, "error")]), "from_file") == [("a",), ("b",), ("c",)]
    assert json.loads(reports.error("c", "m", ["b", "a", "b"]))["details"] == ["a", "b"]


def test_a_repository_reads_its_configuration_and_reports(spark, tmp_path):
    spec = 'version: "2.3"\nmodule: {m}\nboundaries: {{path: "src/{m}/**/*", allow_imports_from: [{a}], friend_modules: [{f}], import_hygiene: {{test_boundary: {{mode: production_only}}}}}}\n'
    root = write(tmp_path, {
        "archsieve.config.yml": "spec_dirs: [specs]\nstale_baseline: fail\n", "specs/a.spec.yml": spec.format(m="a", a="b", f=""), "specs/b.spec.yml": spec.format(m="b", a="", f="x"), "specs/old.spec.yml": spec.format(m="old", a="", f=""),
        "other/c.spec.yml": "not: a spec\n", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}', "src/a/i.ts": 'import { t } from "@/a/t.test";\nimport { b } from "@/b/i";\nimport x from "lodash/fp";\n', "src/a/t.test.ts": "export const t = 1;\n",
        "src/b/i.ts": "export const b = 1;\n", "src/old/i.ts": "", "node_modules/lodash/package.json": "{}", "node_modules/@s/p/package.json": "{}",
    })
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "base")
    project = Project(spark, root)
    assert project.settings.stale_baseline == "fail" and rows(project.specs, "module") == [("a",), ("b",), ("old",)] and rows(project.installed) == [("@s/p",), ("lodash",)]
    assert rows(project.edges, "from_file", "to_file") == [("src/a/i.ts", "src/a/t.test.ts"), ("src/a/i.ts", "src/b/i.ts")] and project.unresolved.count() == 0
    verdict = project.check(today="2024-01-01")
    assert rows(verdict.violations, "rule", "from_file") == [("hygiene.test_in_production", "src/a/i.ts")]
    lines = [r.text for r in project.report(verdict).collect()]
    assert lines[0].startswith("ERROR [hygiene.test_in_production] src/a/i.ts:1 -> src/a/t.test.ts") and lines[1].startswith("Summary: fail total=1 new=1") and lines[2] == "Edges: Resolved: 2  Type-only: 0  External: 1  Unresolved: 0"
    trace = tmp_path / "trace.json"
    trace.write_text(json.dumps([{"from": "src/a/i.ts", "import": "@/b/i", "resolved_to": "src/b/other.ts"}]))
    row = project.compare_import(str(trace), "src/a/i.ts", "@/b/i").first()
    assert (row.ours_to, row.theirs_to, row.status, row.category) == ("src/b/i.ts", "src/b/other.ts", "mismatch", "paths")
    with pytest.raises(ProjectError, match="since"):
        project.check(deny_widenings=True)
    # a narrows by what b widens; the configuration narrows; a file goes
    write(tmp_path, {"archsieve.config.yml": "spec_dirs: [specs]\nstale_baseline: fail\nunresolved_edge_policy: error\n", "specs/a.spec.yml": spec.format(m="a", a="b", f="y"), "specs/b.spec.yml": spec.format(m="b", a="", f="x").replace("[x]", "[]")})
    git("add", "-A"), git("commit", "-qm", "middle")
    plain, made_good = policy_report(spark, root, "HEAD~1", "HEAD"), policy_report(spark, root, "HEAD~1", "HEAD", compensate=True)
    assert rows(plain.changes, "module", "field", "classification") == [("a", "friend_modules", "widening"), ("b", "friend_modules", "narrowing")] and plain.exit_code() == made_good.exit_code() == 1
    write(tmp_path, {"specs/a.spec.yml": spec.format(m="a", a="b", f=""), "specs/b.spec.yml": spec.format(m="b", a="", f="y")})
    git("rm", "-q", "specs/old.spec.yml"), git("add", "-A"), git("commit", "-qm", "head")
    report = policy_report(spark, root, "HEAD~1", "HEAD", compensate=True)
    assert rows(report.compensations, "widened", "narrowed", "result") == [("b", "a", "offset")]
    assert rows(report.changes, "module", "field", "classification") == [("a", "friend_modules", "narrowing"), ("b", "friend_modules", "widening"), ("old", "spec", "widening")] and report.exit_code() == 1
    assert [r.text.split(" ")[0] for r in report.human("x", "y").collect()][0] == "Policy" and json.loads(report.json().first()[0])["summary"]["widenings"] == 2
    assert [json.loads(r.text)["type"] for r in report.events().collect()] == ["change", "change", "change", "compensation", "summary"]
    assert snapshots.offset(report.changes, report.compensations).where("classification = 'widening'").count() == 1
