"""Whole projects: what a broken tree reports and a mended one does not."""

import json
import subprocess

import pytest
import yaml
from pyspark.sql import functions as F

from archsieve.operators import layering, ownership, violations
from archsieve.plans.engine import Project, ProjectError, config_diff, policy_diff
from archsieve.sources import project as sources
from archsieve.streaming import watch

UI = """version: "2.3"
module: ui
boundaries:
  path: src/ui/**/*
  allow_imports_from: [core]
  never_imports: [db]
  forbidden_dependencies: [lodash]
constraints:
  - {rule: boundary.never_imports, severity: warning}
  - {rule: no-circular-deps, params: {scope: both}}
"""
CORE = """version: "2.3"
module: core
boundaries:
  path: src/core/**/*
  public_api: [src/core/index.ts]
  contracts:
    - {id: make, contract: contracts/make.json, envelope: required, match: {files: [src/core/make.ts]}}
    - {id: lost, contract: contracts/none.json, imports_contract: ["core:make", "core:nothing"]}
"""
DB = 'version: "2.2"\nmodule: db\nboundaries: {path: "src/db/**/*", visibility: private}\n'


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    root = write(
        tmp_path_factory.mktemp("broken"),
        {
            "modules/ui.spec.yml": UI, "modules/core.spec.yml": CORE, "modules/db.spec.yml": DB, "contracts/make.json": "{}",
            "src/ui/a.ts": 'import { x } from "../core/index";\nimport { d } from "../db/d";\nimport { in } from "../core/inner";\nimport _ from "lodash";\nimport { b } from "./b";\nimport { no } from "./gone";\n',
            "src/ui/b.ts": 'import { a } from "./a";\n// @archsieve-ignore: agreed\nimport { d } from "../db/d";\n', "src/ui/a.test.ts": 'import { d } from "../db/d";\n',
            "src/core/index.ts": 'export { x } from "./inner";\n', "src/core/inner.ts": "export const x = 1;\n", "src/core/make.ts": "export function make() {}\n", "src/db/d.ts": "export const d = 1;\n", "node_modules/lodash/index.js": 'import "../../src/db/d";',
        },
    )
    settings = sources.config("envelope: {import_patterns: [env]}\nunresolved_edge_policy: warn\nunknown: 1\n")
    return Project(spark, root, settings, spark.createDataFrame([("lodash",)], "package string"))


def test_findings(broken):
    got = sorted((r.rule, r.severity, r.from_file) for r in broken.findings().collect())
    assert got == [
        ("boundary.contract_missing", "error", "contracts/none.json"), ("boundary.contract_ref_invalid", "error", "lost"), ("boundary.envelope_missing", "warning", "src/core/make.ts"),
        ("boundary.never_imports", "warning", "src/ui/a.ts"), ("boundary.public_api", "error", "src/ui/a.ts"), ("boundary.visibility.private", "error", "src/ui/a.ts"), ("dependency.forbidden", "error", "src/ui/a.ts"),
        ("hygiene.unresolved_import", "warning", "src/ui/a.ts"), ("no-circular-deps", "error", "src/ui/a.ts"),
    ]


def test_verdict_and_baseline(spark, broken, tmp_path):
    verdict = broken.check(today="2024-01-01")
    counts = verdict.summary.first()
    assert (counts.total, counts.new_errors, counts.new_warnings, counts.status) == (9, 6, 3, "fail") and verdict.exit_code() == 1
    rows = [r.asDict() for r in verdict.violations.select("fingerprint", "rule", "severity", "from_file").collect()]
    path = tmp_path / "baseline.json"
    path.write_text(json.dumps({"version": "1", "entries": rows}))
    again = broken.check(baseline=str(path), today="2024-01-01")
    assert again.exit_code() == 0 and again.summary.first().baseline_violations == 9 and again.summary.first().stale == 0
    assert sources.baseline(spark, str(tmp_path / "none.json")).count() == 0


def test_other_verbs(spark, broken, tmp_path):
    assert broken.validate().count() == 0 and broken.ownership()["unclaimed"].count() == 0 and broken.governance().count() == 0 and broken.canonical_findings().count() == 0
    row = broken.classification().first()
    assert (row.resolved, row.external, row.unresolved) == (7, 1, 1)
    trace = tmp_path / "trace.json"
    edges = [{"from": r.from_file, "to": r.to_file} for r in broken.edges.collect()]
    trace.write_text(json.dumps({"schema_version": "1", "edges": edges[1:] + [{"from": "./x.ts", "to": "y.ts"}], "resolutions": []}))
    assert sorted((r.a, r.side) for r in broken.compare(str(trace)).collect()) == sorted([(edges[0]["from"], "ours"), ("x.ts", "theirs")])
    free = tmp_path / "free.json"
    free.write_text(json.dumps({"any": [{"source": "a.ts", "target": "b.ts"}, {"deep": {"from": "c.ts", "import": "./d"}}]}))
    a, b = sources.trace(spark, str(free))
    assert [tuple(r) for r in a.collect()] == [("a.ts", "b.ts")] and [tuple(r) for r in b.collect()] == [("c.ts", "./d")]


def test_traces_are_read_whole_or_not_at_all(spark, tmp_path):
    edges = spark.createDataFrame([(f"a{i}.ts", "b.ts") for i in range(50)], "a string, b string").coalesce(1)
    sources.write_trace(edges, str(tmp_path / "lines"))
    assert sources.trace(spark, str(tmp_path / "lines"))[0].count() == 50
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="JSON lines"):
        sources.trace(spark, str(tmp_path / "bad.json"))[0].collect()


def test_faulty_specs_stop_a_check(spark, tmp_path):
    root = write(tmp_path, {"a.spec.yml": 'version: "2.2"\nmodule: a\nsurprise: 1\n', "b.spec.yml": ": : :"})
    with pytest.raises(ProjectError, match="surprise"):
        Project(spark, root).check()
    root = write(tmp_path / "two", {"a.spec.yml": 'version: "9"\nmodule: a\nconstraints: [{rule: what}]\n', "b/a.spec.yml": 'version: "2.3"\nmodule: a\n'})
    messages = {r.message for r in Project(spark, root).validate().collect()}
    assert messages == {"unsupported version 9", "unknown rule what", "module is declared in a.spec.yml"}


def test_workspaces_and_configuration(spark):
    assert sources.workspace_patterns("packages: ['apps/*', '!apps/old']", '{"workspaces": {"packages": ["libs/**"]}}') == ["!apps/old", "apps/*", "libs/**"]
    files = spark.createDataFrame([("apps/web/package.json",), ("apps/old/package.json",), ("libs/x/web/src/a.ts",), ("other/package.json",)], "path string")
    assert {r.directory: r.module for r in sources.workspaces(files, ["apps/*", "!apps/old", "libs/**"]).collect()} == {"apps/web": "web", "libs/x/web": "x__web"}
    changed = config_diff(spark, sources.config(None), sources.config("exclude: ['**/x/**']\nstale_baseline: fail\ntelemetry: {enabled: true}\nescape_hatches: {max_new_per_diff: 3}"))
    got = sorted((r.field, r.classification) for r in changed.collect())
    assert ("escape_hatches.max_new_per_diff", "narrowing") in got and ("stale_baseline", "narrowing") in got and ("telemetry", "structural") in got and ("exclude", "widening") in got
    deep = "import_hygiene: {{deny_deep_imports: [{}]}}\nenvelope: {{enabled: {}}}"
    old = deep.format("{pattern: a, max_depth: 1}, {pattern: b, max_depth: 2, severity: error}, {pattern: c, max_depth: 1}, {pattern: d, max_depth: 1}, {pattern: same, max_depth: 1}", "true")
    new = deep.format("{pattern: a, max_depth: 0}, {pattern: b, max_depth: 1, severity: warning}, {pattern: d, max_depth: 2}, {pattern: e, max_depth: 0}, {pattern: ' same ', max_depth: 1}", "false")
    got = sorted((r.field, r.detail.split(":")[0], r.classification) for r in config_diff(spark, sources.config(old), sources.config(new)).collect())
    name = "import_hygiene.deny_deep_imports"
    assert got == [("envelope.enabled", "true -> false", "widening"), (name, "a", "narrowing"), (name, "b", "structural"), (name, "c", "widening"), (name, "d", "widening"), (name, "e", "narrowing")]
    with pytest.raises(ValueError):
        sources.config("tsconfig_filename: a/b")


def test_agreed_import_ids(spark, tmp_path):
    spec = 'version: "2.3"\nmodule: {m}\nimport_id: "{i}"\nimport_ids: [" {i}", "@s/{m}/inner", "lib", "@none/x", "@s/z"]\nboundaries: {{path: "packages/{m}/**", public_api: ["packages/{m}/src/index.ts"], enforce_canonical_imports: {e}}}\n'
    manifest = lambda m: json.dumps({"name": f"@s/{m}", "exports": {".": "./src/index.ts", "./inner": "./src/inner.ts"}})
    files = {f"{m}.spec.yml": spec.format(m=m, i=f"@s/{m}", e=str(m != "z").lower()) for m in ("a", "b", "z")} | {f"packages/{m}/package.json": manifest(m) for m in ("a", "b", "z")}
    files |= {f"packages/{m}/src/{f}.ts": "export const x = 1;\n" for m in ("a", "b", "z") for f in ("index", "inner")} | {"node_modules/lib/package.json": '{"name": "lib"}'}
    got = {(r.module, r.id): (r.importer, r.place, r.message.split(" to ")[1]) for r in Project(spark, write(tmp_path, files)).canonical_findings().collect()}
    b, a = "packages/b/src/index.ts", "packages/a/src/index.ts"
    want = {(m, i): (p, "outside", t) for m, p in (("a", b), ("b", a)) for i, t in ((f"@s/{m}/inner", f"a file that is not public: packages/{m}/src/inner.ts"), ("lib", "a package: lib"), ("@none/x", "nothing"), ("@s/z", "another module's file: packages/z/src/index.ts"))}
    assert got == want


def test_probes(spark):
    owned = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b")], "path string, module string")
    modules = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    of = lambda rows: {r.module: (r.importer, r.place) for r in ownership.probes(rows, modules).collect()}
    assert of(owned) == {"a": ("b/1", "outside"), "b": ("a/1", "outside"), "c": ("a/1", "outside")}
    assert of(owned.where("module = 'a'")) == {"a": ("a/1", "inside"), "b": ("a/1", "outside"), "c": ("a/1", "outside")}
    assert of(owned.where("false")) == dict.fromkeys("abc", ("probe.ts", "made up"))
    assert of(spark.createDataFrame([("z", None), ("a/1", "a")], "path string, module string"))["a"] == ("z", "outside")


@pytest.mark.parametrize(
    "params,fault",
    [
        ("{layers: [a, ' b ']}", None), ("[a]", "parameters"), ("{}", "layers must be a list"), ("{layers: a}", "layers must be a list"), ("{layers: []}", "layers is empty"), ("{layers: [a, 1]}", "layers must hold texts"), ("{layers: [1]}", "layers must hold texts"),
        ("{layers: [a, ' ']}", "layers holds a blank"), ("{layers: [a, ' a']}", "layers holds a name twice"), ("{layers: [a, null]}", "layers must hold texts"), ("{layers: [null]}", "layers must hold texts"),
    ],
)
def test_layer_declarations(spark, params, fault):
    text = json.dumps(yaml.safe_load(params))
    rules = spark.createDataFrame([("m", "enforce-layer", text), ("m", "enforce-layer", text), ("m", "other", "{}")], "module string, rule string, params string")
    (row,) = layering.declared(rules, "enforce-layer", "layers").collect()
    assert (row.fault or "").startswith(fault or "") and bool(row.fault) == bool(fault) and (fault or row.names == ["a", "b"])


def test_faulty_rules_stop_a_check(spark, tmp_path):
    spec = 'version: "2.3"\nmodule: {m}\nboundaries: {{path: "src/{m}/**"}}\nconstraints: [{c}]\n'
    layer, category = "{rule: enforce-layer, params: {layers: [a, b]}}", "{{rule: enforce-category, params: {{category: '{}', members: [a, b]}}}}"
    files = {"a.spec.yml": spec.format(m="a", c=f"{layer}, {category.format('k')}"), "b.spec.yml": spec.format(m="b/x", c=layer), "src/a/i.ts": 'import "../b/x/j";\n', "src/b/x/j.ts": 'import "../../a/i";\nimport "./none";\n'}
    project = Project(spark, write(tmp_path / "good", files))
    assert project.rule_faults().count() == 0 and sorted((r.rule, r.from_file) for r in project.check().violations.collect() if r.rule.startswith("enforce")) == [("enforce-category", "src/a/i.ts"), ("enforce-category", "src/b/x/j.ts"), ("enforce-layer", "src/b/x/j.ts")]
    assert [tuple(r)[:4] for r in project.verdict_edges().collect()] == [("a", "b/x", "resolved", "../b/x/j"), ("b/x", "a", "resolved", "../../a/i"), ("b/x", None, "unresolved_literal", "./none")]
    assert [r.to_file for r in project.edges_of("src/a/i.ts").collect()] == ["src/b/x/j.ts"] and [r.path for r in project.files_of("b/x").collect()] == ["src/b/x/j.ts"]
    bad = files | {"b.spec.yml": spec.format(m="b/x", c=f"{layer.replace('[a, b]', '[b, a]')}, {category.format('')}"), "c.spec.yml": spec.format(m="c", c="")}
    project = Project(spark, write(tmp_path / "bad", bad))
    assert sorted((r.rule, r.module, r.message.split()[0]) for r in project.rule_faults().collect()) == [("enforce-category", "b/x", "category"), ("enforce-layer", "b/x", "differs"), ("enforce-layer", "c", "its")]
    with pytest.raises(ProjectError, match="enforce-layer"):
        project.check()


def test_policy_difference_of_a_repository(spark, tmp_path):
    root = write(tmp_path, {"modules/ui.spec.yml": UI, "modules/db.spec.yml": DB, "src/db/d.ts": "", "src/ui/a.ts": ""})
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "-A"), git("commit", "-qm", "base")
    write(tmp_path, {"modules/ui.spec.yml": UI.replace("never_imports: [db]", "never_imports: []"), "modules/db.spec.yml": DB.replace("private", "internal"), "src/ui/new.ts": ""})
    git("add", "-A"), git("commit", "-qm", "head")
    got = sorted((r.module, r.field, r.classification) for r in policy_diff(spark, root, "HEAD~1", "HEAD").collect())
    assert got == [("db", "visibility", "widening"), ("ui", "never_imports", "widening"), ("ui", "path", "widening")]
    assert sorted(r.to_path for r in sources.spec_changes(spark, root, "HEAD~1", "HEAD").collect()) == ["modules/db.spec.yml", "modules/ui.spec.yml"]
    write(tmp_path, {"src/ui/a.ts": "x"})
    assert [r.path for r in sources.changed_files(spark, root, "HEAD").collect()] == ["src/ui/a.ts"]
    with pytest.raises(ValueError):
        sources.valid_ref(root, "--output=x")
    assert sources.name_status("M\0a\0R100\0b\0c\0D\0d\0") == [("M", None, "a"), ("R", "b", "c"), ("D", None, "d")]


def test_globs_that_are_none_are_findings(spark, tmp_path):
    text = 'version: "2.3"\nmodule: a\nboundaries: {path: "src/a/**/*", public_api: ["src/a/{x"]}\nimport_ids: ["@here/a"]\n'
    code = 'import x from "./no";\nimport("./later");\nimport z from "@here/a";\nimport w from "/no";\n'
    root = write(tmp_path, {"a.spec.yml": text, "src/a/x.ts": code, "archsieve.config.yml": 'test_patterns: ["[a"]\n'})
    project = Project(spark, root, packages_installed=spark.createDataFrame([], "package string"))
    found = {r.rule: r for r in violations.union(*project.config_findings()).collect()}
    assert set(found) == {"boundary.config.invalid_public_api_glob", "boundary.config.invalid_test_glob", "hygiene.config_error"}
    assert {r.severity for r in found.values()} == {"error"} and found["boundary.config.invalid_public_api_glob"].from_file == "a.spec.yml"
    assert not project.files.where("is_test").count()
    assert {r.specifier: r.kind for r in project.lost().collect()} == {"./no": "unresolved_literal", "./later": "unresolved_dynamic", "@here/a": "external", "/no": "unresolved_literal"}
    first = project.governance_hashes().first()
    assert first == Project(spark, root).governance_hashes().first() and first.project.startswith("sha256:") and len(set(first)) == 3
    (tmp_path / "a.spec.yml").write_text(text.replace("@here/a", "@here/b"))
    again = Project(spark, root).governance_hashes().first()
    assert again.config_hash == first.config_hash and again.spec_hash != first.spec_hash


def test_stream_of_edges(spark, broken, tmp_path):
    edges = broken.edges.where("from_module is not null and to_module is not null")
    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in"))
    watch.watch(stream, broken.boundaries, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    from archsieve.operators import boundary

    assert spark.read.parquet(str(tmp_path / "out")).count() == boundary.evaluate(edges, broken.boundaries).count() > 0
    batch = spark.createDataFrame([("a", "b", "2024-01-01 10:00:00"), ("a", "b", "2024-01-01 11:00:00"), ("a", "a", "2024-01-01 11:00:00")], "from_module string, to_module string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.n for r in watch.windowed_crossings(batch).collect()] == [2]
