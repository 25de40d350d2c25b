"""Glob patterns.

Two dialects: without ``separate``, ``*`` and ``?`` also match ``/``; with it, only ``**`` crosses directories.
``compile_glob`` serves patterns that the driver reads from files and rejects what is no glob;
``glob_column`` does the same for a column of patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

META = re.compile(r"[*?\[{]")


class GlobError(ValueError):
    """A pattern that is no glob."""


def has_meta(pattern: str) -> bool:
    return bool(META.search(pattern))


def compile_glob(pattern: str, separate: bool = False) -> str:
    """The anchored regular expression of a glob."""
    one, many = ("[^/]", "[^/]*") if separate else ("[\\s\\S]", "[\\s\\S]*")
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            before, after = pattern[:i], pattern[i + run :]
            whole = run == 2 and (not before or before[-1] == "/") and (not after or after[0] == "/")
            if whole and separate:
                if after:
                    out.append("(?:[\\s\\S]*/)?")
                    i += 3
                    continue
                out.append("[\\s\\S]*" if not before else "[\\s\\S]+")
            elif whole and after:
                out.append("(?:[\\s\\S]*/)?")
                i += 3
                continue
            else:
                out.append(many)
            i += run
            continue
        if c == "?":
            out.append(one)
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                raise GlobError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            escaped = re.sub(r"([\\\[\]&^~])", r"\\\1", body)
            out.append(f"(?!/)[{'^' if negated else ''}{escaped}]" if separate else f"[{'^' if negated else ''}{escaped}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise GlobError(f"unopened brace in {pattern!r}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                raise GlobError(f"trailing backslash in {pattern!r}")
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c) if c in "\\.^$+()|]" else c)
        i += 1
    if depth:
        raise GlobError(f"unclosed brace in {pattern!r}")
    return f"^{''.join(out)}$"


def faults(patterns) -> list[str]:
    """What is wrong with the globs of a configuration, in order."""
    out = []
    for pattern in patterns:
        try:
            compile_glob(pattern)
        except GlobError as e:
            out.append(str(e))
    return out


#: What a glob is made of: an escaped sign, a run of stars, a closed class, any other sign.
TOKEN = r"\\[\s\S]|\*+|\[[!^]?[\s\S][^\]]*\]|[\s\S]"


def glob_column(pattern: Column, separate: bool = False) -> Column:
    """The regular expression of a glob column. Braces of any depth, classes and escaped signs are read if they are closed, else taken as text."""
    return F.when(pattern.rlike(r"[\[\]{}\\]"), folded_glob(pattern, separate)).otherwise(plain_glob(pattern, separate))


def plain_glob(pattern: Column, separate: bool) -> Column:
    """The same for globs of stars and question marks alone."""
    one, many = ("[^/]", "[^/]*") if separate else ("[\\s\\S]", "[\\s\\S]*")
    x = F.regexp_replace(pattern, r"([.^$+()|])", r"\\$1")
    # stars that stand for directories; a run of stars elsewhere is one star
    x = F.regexp_replace(F.regexp_replace(x, r"(?:(?<=/)|^)\*\*/", "\x01"), r"(?<=[/\x01])\*\*$", "\x02") if separate else F.regexp_replace(x, r"(?:(?<=/)|^)\*\*/", "\x01")
    x = F.when(pattern == "**", "\x03").otherwise(F.regexp_replace(x, r"\*+", "\x04")) if separate else F.regexp_replace(x, r"\*+", "\x04")
    x = F.replace(F.replace(x, F.lit("?"), F.lit(one)), F.lit("\x04"), F.lit(many))
    x = F.replace(F.replace(F.replace(x, F.lit("\x01"), F.lit("(?:[\\s\\S]*/)?")), F.lit("\x02"), F.lit("[\\s\\S]+")), F.lit("\x03"), F.lit("[\\s\\S]*"))
    return F.concat(F.lit("^"), x, F.lit("$"))


def folded_glob(pattern: Column, separate: bool) -> Column:
    """A glob's tokens, put together from left to right. The depth of braces tells what a comma is; ``flat`` takes all braces as text,
    and counts where they are not closed."""
    one, many = ("[^/]", "[^/]*") if separate else ("[\\s\\S]", "[\\s\\S]*")
    tokens = F.regexp_extract_all(pattern, F.lit(TOKEN), F.lit(0))
    quote = lambda c: F.regexp_replace(c, r"([\\.^$+()|\[\]{}*?])", r"\\$1")
    beside = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(tokens, i - 1).alias("before"), F.get(tokens, i + 1).alias("after")))
    negated = lambda t: t.rlike(r"^\[[!^]")
    body = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\[[!^]?|\]$", ""), r"([\\\[\]&^~])", r"\\$1")
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("flat"), F.lit(0).alias("depth"), F.lit(False).alias("wrong"), F.lit(False).alias("skip"))

    def step(done: Column, x: Column) -> Column:
        t, run = x["t"], F.startswith(x["t"], F.lit("*"))
        whole = (t == "**") & (x["before"].isNull() | F.endswith(x["before"], F.lit("/"))) & (x["after"].isNull() | F.startswith(x["after"], F.lit("/")))
        open_end = F.when(x["before"].isNull(), "[\\s\\S]*").otherwise("[\\s\\S]+") if separate else F.lit(many)
        stars = F.when(whole & x["after"].isNotNull(), "(?:[\\s\\S]*/)?").when(whole, open_end).otherwise(F.lit(many))
        of_class = F.concat(F.lit("(?!/)[" if separate else "["), F.when(negated(t), "^").otherwise(""), body(t), F.lit("]"))
        escaped = quote(F.substr(t, F.lit(2), F.lit(2)))
        usual = F.when(run, stars).when((F.length(t) > 1) & F.startswith(t, F.lit("[")), of_class).when((F.length(t) > 1) & F.startswith(t, F.lit("\\")), escaped).when(t == "?", one).otherwise(quote(t))
        nested = F.when(t == "{", "(?:").when(t == "}", ")").when((t == ",") & (done["depth"] > 0), "|").otherwise(usual)
        depth = done["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        add = lambda name, piece: F.when(done["skip"], done[name]).otherwise(F.concat(done[name], piece)).alias(name)
        return F.struct(add("out", nested), add("flat", usual), depth.alias("depth"), (done["wrong"] | (depth < 0)).alias("wrong"), (run & whole & x["after"].isNotNull()).alias("skip"))

    end = lambda done: F.concat(F.lit("^"), F.when(done["wrong"] | (done["depth"] > 0), done["flat"]).otherwise(done["out"]), F.lit("$"))
    return F.aggregate(beside, start, step, end)


def matches(value: Column, pattern: Column, separate: bool = False) -> Column:
    """Whether a value equals a pattern or matches it as a glob."""
    return (value == pattern) | (pattern.rlike(r"[*?\[{]") & F.rlike(value, glob_column(pattern, separate)))


def matches_any(value: Column, patterns: Column) -> Column:
    """Whether a value matches one of an array of names and globs; a null array matches nothing."""
    return F.coalesce(F.exists(patterns, lambda p: matches(value, p)), F.lit(False))


def static_directory(pattern: Column) -> Column:
    """The directories that a glob's text fixes before its first special sign."""
    fixed = F.regexp_extract(pattern, r"^[^*?\[{\\]*", 0)
    return F.regexp_replace(F.regexp_extract(fixed, "^(.*)/", 1), "/+$", "")


def static_directories(pattern: Column) -> Column:
    """An array of directories, one of which each match lies below: those of a glob's alternatives, where its first two braces hold
    plain names and come before any other special sign."""
    first = r"^([^*?\[{\\]*)\{([^{}\[\]*?\\]*)\}([\s\S]*)$"
    names = lambda p: F.transform(F.split(F.regexp_extract(p, first, 2), ","), lambda a: F.concat(F.regexp_extract(p, first, 1), a, F.regexp_extract(p, first, 3)))
    closed = F.length(F.replace(pattern, F.lit("{"), F.lit(""))) == F.length(F.replace(pattern, F.lit("}"), F.lit("")))
    apart = lambda p: F.when(closed & p.rlike(first), names(p)).otherwise(F.array(p))
    return F.array_distinct(F.transform(F.flatten(F.transform(apart(pattern), apart)), static_directory))


def literal_prefix(pattern: Column) -> Column:
    """The text before the first special sign."""
    return F.regexp_extract(pattern, r"^[^*?\[{]*", 0)


def static_prefix(pattern: Column) -> Column:
    """The text before the first star, question mark or class, without ``./`` and ``/`` in front; null where nothing is left."""
    fixed = F.trim(F.regexp_extract(F.trim(pattern), r"^[^*?\[]*", 0))
    return F.nullif(F.regexp_replace(fixed, r"^(\./)*/*", ""), F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    """Whether two globs can match one path, judged by their literal prefixes alone."""
    p, q = F.rtrim(literal_prefix(a), F.lit("/")), F.rtrim(literal_prefix(b), F.lit("/"))
    inside = lambda x, y: (x == y) | F.startswith(y, F.concat(x, F.lit("/")))
    return (p == "") | (q == "") | inside(p, q) | inside(q, p)
