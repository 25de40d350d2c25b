"""Entry points of packages: conditions in their order, wildcards, closed entries, a package's own names, where a package lies."""

import json
import re

import pytest

from archsieve.operators import entry_points, resolve
from archsieve.plans import tables
from archsieve.plans.engine import Project


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.mark.parametrize(
    "value,want",
    [
        ("./a", ["./a"]), (None, [None]), ({"browser": "./b"}, None), ({"default": "./d", "import": "./i"}, ["./d"]), ({"import": {"deno": "./x"}, "node": "./n"}, ["./n"]), ({"types": None, "default": "./d"}, [None]),
        (["./a", {"browser": "./x"}, {"node": "./b"}], ["./a", "./b"]), ([None], [None]), ([], None), (7, None), ({"import": ["./a", None]}, ["./a"]),
    ],
)
def test_targets(value, want):
    assert entry_points.targets(value, entry_points.CONDITIONS) == want


MANIFESTS = {
    "package.json": {"imports": {"#in/*": "./src/*.ts", "#dep": {"browser": "x", "node": "dep/sub"}, "#closed": None, "#deep/*/x": "./deep/*.ts"}},
    "packages/a/package.json": {"name": "@s/a", "exports": {".": "./src/index.js", "./*": "./src/*.ts", "./long/*": "./other/*.ts", "./long/*/end": "./ends/*.ts", "./long/no*": None, "./two/*": "./*/*.ts", "./ext": "../outside.ts"}},
    "packages/b/package.json": {"name": "b", "main": "lib"},
    "packages/plain/package.json": {"name": "plain"},
    "packages/a/node_modules/dep/package.json": {"name": "dep", "exports": {"./sub": "./near.js"}},
    "node_modules/dep/package.json": {"name": "dep", "exports": {".": "./i.js", "./sub": "./far.js", "./no": {"browser": "./x.js"}}},
    "node_modules/old/package.json": {"name": "old"},
    "broken/package.json": "{",
    "list/package.json": [],
}
THERE = ["src/x.ts", "deep/q.ts", "packages/a/src/index.ts", "packages/a/src/y.ts", "packages/a/other/z.ts", "packages/a/ends/z.ts", "packages/a/t/t.ts", "packages/b/lib/index.ts", "packages/b/more.tsx", "packages/plain/index.js", "packages/outside.ts"]
WANT = [
    ("src", "@s/a", "first_party", "packages/a/src/index.ts"), ("src", "@s/a/y", "first_party", "packages/a/src/y.ts"), ("src", "@s/a/long/z", "first_party", "packages/a/other/z.ts"), ("src", "@s/a/long/z/end", "first_party", "packages/a/ends/z.ts"),
    ("src", "@s/a/long/none", "unresolved", None), ("src", "@s/a/two/t", "first_party", "packages/a/t/t.ts"), ("src", "@s/a/y.ts", "unresolved", None), ("src", "@s/a/ext", "unresolved", None), ("src", "@s/a/", "unresolved", None),
    ("src", "b", "first_party", "packages/b/lib/index.ts"), ("src", "b/more", "first_party", "packages/b/more.tsx"), ("src", "plain", "first_party", "packages/plain/index.js"), ("src", "dep", "third_party", None), ("src", "dep/sub", "third_party", None),
    ("src", "dep/no", "unresolved", None), ("src", "dep/other", "unresolved", None), ("packages/a/src", "dep/sub", "third_party", None), ("packages/a/src", "dep", "unresolved", None), ("src", "old/any/file", "third_party", None),
    ("src", "#in/x", "first_party", "src/x.ts"), ("src", "#in/", "unresolved", None), ("src", "#dep", "third_party", None), ("src", "#closed", "unresolved", None), ("src", "#deep/q/x", "first_party", "deep/q.ts"), ("src", "#none", "unresolved", None),
    ("packages/a/src", "#in/x", "unresolved", None), ("src", "absent", "unresolved", None), ("src", "fs", "third_party", None), ("src", "./x", "first_party", "src/x.ts"),
]


def test_entries_resolve(spark):
    manifests = spark.createDataFrame([(p, m if isinstance(m, str) else json.dumps(m)) for p, m in MANIFESTS.items()], "path string, content string")
    table = entry_points.entries(manifests)
    assert sorted(r.root for r in table.where("kind = 'unreadable'").collect()) == ["broken", "list"]
    asked = spark.createDataFrame([w[:2] for w in WANT] + [WANT[0][:2]], "directory string, specifier string")
    got = resolve.resolve(asked, spark.createDataFrame([(p,) for p in THERE], "path string"), entries=table).collect()
    assert len(got) == len(WANT) + 1 and {(r.directory, r.specifier): (r.kind, r.target) for r in got} == {w[:2]: w[2:] for w in WANT}
    assert {(r.specifier, r.package) for r in got if r.kind == "third_party"} == {("dep", "dep"), ("dep/sub", "dep"), ("old/any/file", "old"), ("#dep", "dep"), ("fs", "fs")}


def test_project_with_workspace_packages(spark, tmp_path):
    write(tmp_path, {
        "archsieve.config.yml": "{}\n", "packages/a/package.json": json.dumps({"name": "@s/a", "exports": {"./*": {"import": "./src/*.ts"}}}), "packages/a/src/api.ts": "export const a = 1;\n", "packages/b/src/i.ts": 'import { a } from "@s/a/api";\nimport "lib/x";\nimport "lib/y";\n',
        "node_modules/lib/package.json": json.dumps({"name": "lib", "exports": {"./x": "./x.js"}}), "a.spec.yml": 'version: "2.3"\nmodule: a\nboundaries:\n  path: packages/a/**\n', "b.spec.yml": 'version: "2.3"\nmodule: b\nboundaries:\n  path: packages/b/**\n',
    })
    project = Project(spark, str(tmp_path))
    assert [(r.from_file, r.to_file) for r in project.edges.collect()] == [("packages/b/src/i.ts", "packages/a/src/api.ts")]
    assert [r.specifier for r in project.unresolved.collect()] == ["lib/y"]


def test_requests_are_made_once_and_entries_looked_up_once_a_package(spark):
    plan = tables.QUERIES["entry_points_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"FileScan parquet \[l_", plan)  # the steps of the resolution read what was written, not the line items again
    keys = re.findall(r"Generate explode\(transform\(sequence\(0, length\(key#\d+\)[^\n]*?\)\), \[([^\]]*)\]", plan)
    assert keys and any(re.sub(r"#\d+", "", k) == "root, key" for k in keys)


def test_many_directories_share_an_entry(spark):
    manifests = spark.createDataFrame([("p/package.json", json.dumps({"name": "p", "exports": {".": "./a.js", "./no": None}}))], "path string, content string")
    asked = spark.createDataFrame([(d, s) for d in ("x", "y", "z/u") for s in ("p", "p/no", "p/else", "q")] + [(None, "p"), ("x", None)], "directory string, specifier string")
    got = resolve.resolve(asked, spark.createDataFrame([("p/a.ts",)], "path string"), spark.createDataFrame([("q",)], "package string"), entries=entry_points.entries(manifests)).collect()
    told = {"p": ("first_party", "p/a.ts", None), "p/no": ("unresolved", None, None), "p/else": ("unresolved", None, None), "q": ("third_party", None, "q")}
    assert len(got) == 14 and all((r.kind, r.target, r.package) == (told[r.specifier] if r.directory and r.specifier else (None, None, None)) for r in got)
