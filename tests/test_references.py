"""References between compiler configurations: their closure, rings and lost ones, and the aliases that count because of them."""

import json

from archsieve.operators import resolve
from archsieve.sources import project as sources

FILES = {
    "tsconfig.json": {"files": [], "references": [{"path": "./packages/a"}, {"path": "./tsconfig.app.json"}, {"path": "./none"}, {}]},
    "tsconfig.app.json": {"extends": "./tsconfig.base", "references": [{"path": "packages/b/tsconfig.lib.json"}]},
    "tsconfig.base.json": {"compilerOptions": {"paths": {"@/*": ["./src/*"]}}},
    "packages/a/tsconfig.json": {"compilerOptions": {"paths": {"@/*": ["./own/*"]}}, "references": [{"path": "../b/tsconfig.lib.json"}, {"path": "../c"}]},
    "packages/b/tsconfig.lib.json": {"compilerOptions": {"paths": {"@/*": ["./lib/*"]}}, "references": [{"path": "../d"}]},
    "packages/c/tsconfig.json": {"references": [{"path": "../a"}]},
    "packages/d/tsconfig.json": {"references": []},
    "packages/d/tsconfig.other.json": {"compilerOptions": {"paths": {"@/*": ["./unseen/*"]}}},
}


def table(spark):
    return spark.createDataFrame([(p, json.dumps(c)) for p, c in FILES.items()], "path string, content string")


def test_closure_of_references(spark):
    reached, errors = sources.references(sources.compiler_configs(table(spark)))
    got = {}
    for r in reached.orderBy("depth", "place").collect():
        got.setdefault(r.path, []).append((r.refers_to.removeprefix("packages/"), r.depth))
    assert got == {
        "tsconfig.json": [("a/tsconfig.json", 1), ("tsconfig.app.json", 1), ("b/tsconfig.lib.json", 2), ("c/tsconfig.json", 2), ("d/tsconfig.json", 3)], "tsconfig.app.json": [("b/tsconfig.lib.json", 1), ("d/tsconfig.json", 2)],
        "packages/a/tsconfig.json": [("b/tsconfig.lib.json", 1), ("c/tsconfig.json", 1), ("d/tsconfig.json", 2)], "packages/b/tsconfig.lib.json": [("d/tsconfig.json", 1)],
        "packages/c/tsconfig.json": [("a/tsconfig.json", 1), ("b/tsconfig.lib.json", 2), ("d/tsconfig.json", 3)],
    }
    assert sorted((r.path, r.refers_to, r.error.split()[0]) for r in errors.collect()) == [("packages/a/tsconfig.json", "packages/a/tsconfig.json", "it"), ("packages/c/tsconfig.json", "packages/c/tsconfig.json", "it"), ("tsconfig.json", "none/tsconfig.json", "there")]
    none, wrong = sources.references(sources.compiler_configs(table(spark).where("false")))
    assert none.count() == wrong.count() == 0


def test_aliases_of_referenced_configurations(spark):
    there = [("src/x.ts",), ("packages/a/own/x.ts",), ("packages/b/lib/x.ts",), ("packages/d/unseen/x.ts",), ("packages/c/x.ts",)]
    asked = spark.createDataFrame([(d, "@/x") for d in ("src", "packages/a/k", "packages/b/k", "packages/c", "packages/d", "packages/e")], "directory string, specifier string")
    got = {r.directory: r.target for r in resolve.resolve(asked, spark.createDataFrame(there, "path string"), None, sources.aliases(table(spark))).collect()}
    assert got == {"src": "src/x.ts", "packages/a/k": "packages/a/own/x.ts", "packages/b/k": "packages/b/lib/x.ts", "packages/c": None, "packages/d": None, "packages/e": "src/x.ts"}
