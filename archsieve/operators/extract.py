"""Imports, exports and calls of TypeScript and JavaScript sources.

One scan of a file's tokens: comments, strings, templates, regular expressions and names; then a short walk over
them. What the walk does not know it skips, so unusual syntax costs rows and never a job. One file gives many rows
of one table, kinds apart: import, re-export, require, dynamic, mock, export, warning.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\[\s\S]|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>=>|\.\.\.|[\s\S])"""
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Signs and words after which a slash starts a regular expression.
BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new"}
ROWS = "path string, kind string, specifier string, name string, type_only boolean, is_default boolean, line int, col int, begin long, stop long, ignored boolean, reason string, expires string"
FIELDS = [f.split()[0] for f in ROWS.split(", ")]


class Token:
    __slots__ = ("kind", "text", "begin", "stop")

    def __init__(self, kind: str, text: str, begin: int):
        self.kind, self.text, self.begin, self.stop = kind, text, begin, begin + len(text)


def tokens(source: str) -> tuple[list[Token], list[Token]]:
    """The tokens of a source, and its comments."""
    out, comments, at = [], [], 0
    while at < len(source):
        if source[at] == "/" and source[at : at + 2] not in ("//", "/*") and (not out or out[-1].text in BEFORE_REGEX) and (m := REGEX.match(source, at)):
            out.append(Token("regex", m[0], at))
        else:
            m = TOKENS.match(source, at)
            if m.lastgroup == "comment":
                comments.append(Token("comment", m[0], at))
            elif m.lastgroup != "space":
                out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out, comments


def literal(t: Token | None) -> str | None:
    """The text of a string or of a template without holes."""
    if t is None or t.kind not in ("string", "template") or (t.kind == "template" and "${" in t.text):
        return None
    return re.sub(r"\\(.)", r"\1", t.text[1:-1])


def directive(comment: str, keyword: str) -> tuple[str, str | None] | None:
    """(reason, expiry) of a comment that switches a finding off: ``keyword: reason`` or ``keyword until:2030-01-31: reason``."""
    text = re.sub(r"^/[/*]+|\*/$", "", comment.strip()).strip()
    if not text.startswith(keyword):
        return None
    rest = text[len(keyword) :].strip()
    if rest.startswith("until:"):
        day, _, reason = rest[len("until:") :].partition(":")
        return reason.strip(), day.strip() if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day.strip()) else None
    return rest.removeprefix(":").strip(), None


def extract(path: str, source: str, keyword: str = "@archsieve-ignore") -> list[dict]:
    """The rows of one source."""
    seen, comments = tokens(source)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    ends = [(line_of(c.stop - 1), directive(c.text, keyword)) for c in comments]
    rows: list[dict] = []

    def add(kind: str, first: Token, last: Token, specifier=None, name=None, type_only=False, is_default=False) -> None:
        line = line_of(first.begin)
        row = dict.fromkeys(FIELDS) | {"path": path, "kind": kind, "specifier": specifier, "name": name, "type_only": type_only, "is_default": is_default, "line": line, "col": first.begin - starts[line - 1], "ignored": False}
        row["begin"], row["stop"] = len(source[: first.begin].encode()), len(source[: last.stop].encode())
        if kind == "import":  # the nearest directive that ends on this line or the one before
            near = [d for (end, d), c in zip(ends, comments) if d and c.stop <= first.begin and 0 <= line - end <= 1]
            if near:
                row["ignored"], (row["reason"], row["expires"]) = True, near[-1]
        rows.append(row)

    text = lambda i: seen[i].text if 0 <= i < len(seen) else ""
    token = lambda i: seen[i] if 0 <= i < len(seen) else None

    def clause(i: int) -> tuple[int, list[tuple[str, str, bool]]]:
        """Names of {a, type b as c} from the brace at i; and the place after it."""
        found, i = [], i + 1
        while i < len(seen) and text(i) != "}":
            typed = text(i) == "type" and text(i + 1) not in (",", "}", "as")
            i += typed
            name = shown = literal(token(i)) or text(i)
            if text(i + 1) == "as":
                i += 2
                shown = literal(token(i)) or text(i)
            found.append((name, shown, typed))
            i += 1
            i += text(i) == ","
        return i + 1, found

    depth, i = 0, 0
    while i < len(seen):
        t = seen[i]
        member = text(i - 1) in (".", "?.")
        if t.text in "{([" and t.kind == "sign":
            depth += 1
        elif t.text in "})]" and t.kind == "sign":
            depth -= 1
        elif t.text == "import" and not member:
            if text(i + 1) == "(":
                spec = literal(token(i + 2))
                add("dynamic" if spec is not None else "warning", t, token(i + 2) or t, spec, None if spec is not None else "dynamic import of an expression")
            elif depth == 0 and text(i + 1) != ".":
                j, typed, names = i + 1, False, []
                if text(j) == "type" and text(j + 1) not in ("from", ",", "="):
                    typed, j = True, j + 1
                only_names = text(j) == "{"
                while j < len(seen) and literal(token(j)) is None and text(j) not in (";", "="):
                    if text(j) == "{":
                        j, more = clause(j)
                        names += more
                    else:
                        j += 1
                spec = literal(token(j))
                if spec is not None:
                    add("import", t, token(j), spec, type_only=typed or (only_names and bool(names) and all(n[2] for n in names)))
                    i = j
        elif t.text == "export" and depth == 0 and not member:
            j = i + 1
            typed = text(j) == "type" and text(j + 1) in ("{", "*")
            j += typed
            if text(j) == "*":
                shown = text(j + 2) if text(j + 1) == "as" else "*"
                j += 3 if text(j + 1) == "as" else 1
                if text(j) == "from" and (spec := literal(token(j + 1))) is not None:
                    add("re-export", t, token(j + 1), spec, shown, typed)
                    i = j + 1
            elif text(j) == "{":
                j, names = clause(j)
                spec = literal(token(j + 1)) if text(j) == "from" else None
                last = token(j + 1) if spec is not None else token(j - 1) or t
                for _, shown, own in names:
                    add("export", t, last, None, shown, typed or own, shown == "default")
                if spec is not None:
                    add("re-export", t, last, spec, ",".join(n[1] for n in names), typed or (bool(names) and all(n[2] for n in names)))
                    j += 2
                i = j - 1
            elif text(j) == "default":
                add("export", t, token(j), None, "default", False, True)
            else:
                while text(j) in ("declare", "abstract", "async"):
                    j += 1
                if text(j) in ("function", "class"):
                    j += 1
                    j += text(j) == "*"
                    add("export", t, token(j) or t, None, text(j))
                elif text(j) in ("const", "let", "var") and text(j + 1) != "enum":
                    for name in declared(seen, j + 1):
                        add("export", t, token(j), None, name)
        elif t.text == "require" and not member and text(i + 1) == "(" and (spec := literal(token(i + 2))) is not None:
            add("require", t, token(i + 2), spec)
        elif t.text == "jest" and text(i + 1) == "." and text(i + 2) == "mock" and text(i + 3) == "(" and (spec := literal(token(i + 4))) is not None:
            add("mock", t, token(i + 4), spec)
        i += 1
    return rows


def declared(seen: list[Token], i: int) -> list[str]:
    """Names that a declaration list binds, patterns included."""
    names, depth, value, annotated = [], 0, False, False
    while i < len(seen):
        t = seen[i]
        if t.text in ("{", "[", "("):
            depth += 1
        elif t.text in ("}", "]", ")"):
            depth -= 1
            if depth < 0:
                break
        elif t.text == ";" and depth == 0:
            break
        elif t.text == "=" and not value:
            value = depth == 0
            skip = depth > 0
            while skip and i + 1 < len(seen) and seen[i + 1].text not in (",", "}", "]"):
                i += 1  # a default inside a pattern
        elif t.text == ":" and depth == 0:
            annotated = True
        elif t.text == "," and depth == 0:
            value = annotated = False
        elif t.kind == "name" and not value and not annotated and (i + 1 >= len(seen) or seen[i + 1].text != ":" or depth == 0):
            names.append(t.text)
        elif value and depth == 0 and t.kind == "name" and t.text in ("export", "import", "const", "let", "var", "function", "class"):
            break
        i += 1
    return names


def imports(files: DataFrame, keyword: str = "@archsieve-ignore") -> DataFrame:
    """The rows of all files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"type_only": pa.bool_(), "is_default": pa.bool_(), "ignored": pa.bool_(), "line": pa.int32(), "col": pa.int32(), "begin": pa.int64(), "stop": pa.int64()}
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = [r for p, s in zip(*(c.to_pylist() for c in part.columns)) for r in extract(p, s or "", keyword)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kinds.get(f, pa.string())) for f in FIELDS], names=FIELDS)

    return files.select("path", "content").mapInArrow(run, ROWS)


def requests(rows: DataFrame, mocks: bool = False) -> DataFrame:
    """(from_file, specifier, kind, type_only, line, ignored): one row for each different request. Mocks only where the
    project enforces them."""
    kinds = ["import", "re-export", "require", "dynamic", *(["mock"] if mocks else [])]
    kind = F.when((F.col("kind") == "import") & F.col("type_only"), "type-only").when(F.col("kind") == "import", "runtime").otherwise(F.col("kind"))
    return rows.where(F.col("kind").isin(*kinds)).select(F.col("path").alias("from_file"), "specifier", kind.alias("kind"), "type_only", "line", "ignored").distinct()


def calls(files: DataFrame, packages: tuple[str, ...], pattern: str, inside: DataFrame | None = None) -> DataFrame:
    """(path, has_import, contract_id): calls of a validation function (``name`` or ``object.member``) that a file imports from
    one of the packages, with the literal that comes first. inside: (path, function), to look only into that exported
    function. Files without such a call have one row without a contract."""
    wanted = files.select("path", "content")
    wanted = wanted.withColumn("function", F.lit(None).cast("string")) if inside is None else wanted.join(inside, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, source, function in zip(*(c.to_pylist() for c in batch.columns)):
                has, ids = validated(source or "", packages, pattern, function)
                out += [(path, function, has, i) for i in ids or [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["path", "function", "has_import", "contract_id"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("path", pa.string()), ("function", pa.string()), ("has_import", pa.bool_()), ("contract_id", pa.string())]))

    return wanted.select("path", "content", "function").mapInArrow(run, "path string, function string, has_import boolean, contract_id string")


def validated(source: str, packages: tuple[str, ...], pattern: str, function: str | None) -> tuple[bool, list[str]]:
    """Whether a runtime import of a package is there, and the first literals of calls by the pattern."""
    seen, _ = tokens(source)
    text = lambda i: seen[i].text if 0 <= i < len(seen) else ""
    bound: set[str] = set()
    spaces: set[str] = set()
    has = False
    for i, t in enumerate(seen):
        if t.text == "import" and text(i + 1) not in ("(", ".", "type"):
            j, names = i + 1, []
            while j < len(seen) and seen[j].kind != "string" and text(j) != ";":
                if text(j) == "*" and text(j + 1) == "as":
                    spaces_here = text(j + 2)
                    names.append(("*", spaces_here))
                    j += 2
                elif text(j) == "type":
                    j += 3 if text(j + 2) == "as" else 1
                elif seen[j].kind == "name" and text(j) not in ("from", "as") and text(j + 1) != "as":
                    names.append(("", text(j)))
                j += 1
            if j < len(seen) and literal(seen[j]) in packages and names:
                has = True
                bound |= {n for _, n in names}
                spaces |= {n for star, n in names if star}
    begin, stop = (0, len(seen)) if function is None else body(seen, function)
    first, _, member = pattern.partition(".")
    ids = []
    for i in range(begin, stop):
        at = None
        if not member and text(i) == first and first in bound and text(i - 1) != "." and text(i + 1) == "(":
            at = i + 2
        elif member and text(i + 1) == "." and text(i + 2) == member and text(i + 3) == "(" and has:
            direct = text(i - 1) != "." and (text(i) in bound or text(i) == first)
            nested = text(i) == first and text(i - 1) == "." and text(i - 2) in spaces
            at = i + 4 if direct or nested else None
        if at is not None and at < len(seen) and (found := literal(seen[at])) is not None:
            ids.append(found)
    return has, ids


def body(seen: list[Token], function: str) -> tuple[int, int]:
    """The tokens of an exported function's body, or an empty range."""
    text = lambda i: seen[i].text if 0 <= i < len(seen) else ""
    exported = {function} if any(text(i) == "export" for i in range(len(seen))) else set()
    for i in range(len(seen)):
        if text(i) in ("function", "const", "let", "var") and text(i + 1) in exported:
            j, depth = i + 2, 0
            arrow = text(i) != "function"
            ready = not arrow
            while j < len(seen):
                if text(j) in ("(", "["):
                    depth += 1
                elif text(j) in (")", "]"):
                    depth -= 1
                elif text(j) == "=>":
                    ready = True
                elif text(j) == "function":
                    ready = True
                elif text(j) == "{" and depth == 0 and ready:
                    level, k = 0, j
                    while k < len(seen):
                        level += (text(k) == "{") - (text(k) == "}")
                        if level == 0:
                            return j, k + 1
                        k += 1
                    return j, len(seen)
                elif text(j) == ";" and depth == 0:
                    return i, j
                j += 1
    return 0, 0
