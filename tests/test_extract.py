"""Extraction from source texts."""

from archsieve.operators import extract

SOURCE = '''// import "no" from "comment"
import a, { b as c } from "./a";
import type { T } from './t';
import { type U, type V } from "./uv";
import "side-effect";
/* @archsieve-ignore until:2030-01-31: legacy */
import legacy from "../legacy";
export * from "./star";
export { x, default as y } from "./named";
export type { Z } from "./z";
export const { p, q: [r] } = make(), s = 1;
export default function () { return require("./inner"); }
export async function work() { const m = await import("./lazy"); return import(`./${m}`); }
export class Klass {}
const text = "require('no')", rx = /import "no"/;
jest.mock("./mocked");
obj.require("no");
'''


def kinds(kind):
    return [r for r in extract.extract("f.ts", SOURCE) if r["kind"] == kind]


def test_imports():
    assert [(r["specifier"], r["type_only"], r["ignored"]) for r in kinds("import")] == [("./a", False, False), ("./t", True, False), ("./uv", True, False), ("side-effect", False, False), ("../legacy", False, True)]
    legacy = kinds("import")[-1]
    assert (legacy["reason"], legacy["expires"], legacy["line"], legacy["col"]) == ("legacy", "2030-01-31", 7, 0)
    assert SOURCE.encode()[legacy["begin"] : legacy["stop"]].decode() == 'import legacy from "../legacy"'


def test_other_rows():
    assert [(r["specifier"], r["name"], r["type_only"]) for r in kinds("re-export")] == [("./star", "*", False), ("./named", "x,y", False), ("./z", "Z", True)]
    assert [r["specifier"] for r in kinds("require")] == ["./inner"] and [r["specifier"] for r in kinds("dynamic")] == ["./lazy"] and len(kinds("warning")) == 1
    assert [r["specifier"] for r in kinds("mock")] == ["./mocked"]
    assert [r["name"] for r in kinds("export")] == ["x", "y", "Z", "p", "r", "s", "default", "work", "Klass"]


def test_odd_sources_never_fail():
    for text in ("", "import", "import {", "export", "export {", "`", "/*", "'", "import x from", "export const", "import(", "require(", "\x00", "}}}"):
        extract.extract("f.ts", text)


def test_table(spark):
    files = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", None)], "path string, content string")
    rows = extract.imports(files)
    assert rows.count() == len(extract.extract("a.ts", SOURCE))
    assert extract.requests(rows).where("kind = 'mock'").count() == 0 and extract.requests(rows, mocks=True).where("kind = 'mock'").count() == 1


def test_validated_calls():
    source = 'import { boundary } from "env";\nexport function one() { boundary.validate("a", x); }\nexport const two = () => { boundary.validate(`b`); };\nboundary.validate(name);'
    find = lambda f: extract.validated(source, ("env",), "boundary.validate", f)
    assert find(None) == (True, ["a", "b"]) and find("one") == (True, ["a"]) and find("two") == (True, ["b"]) and find("three") == (True, [])
    assert extract.validated('import type { boundary } from "env"; boundary.validate("a")', ("env",), "boundary.validate", None) == (False, [])
    assert extract.validated('import * as e from "env"; e.boundary.validate("a")', ("env",), "boundary.validate", None) == (True, ["a"])
    assert extract.validated('import { check } from "env"; check("a"); other("b")', ("env",), "check", None) == (True, ["a"])
