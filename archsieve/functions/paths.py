"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that discovery leaves out by default.
SKIPPED = ("node_modules", ".next", ".turbo", ".nuxt", ".svelte-kit", ".astro", ".output", "dist", "build", "coverage", "generated", "target", "vendor", ".git")
#: Extensions of source files.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
#: Endings of the files that a change of policy looks at.
POLICY_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".spec.yml")


def normalised(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_to(path: Column, root: str) -> Column:
    """The path below a root, or the whole path outside it."""
    p, top = normalised(path), root.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(top)), F.substring(p, len(top) + 1, 1 << 30)).otherwise(p)


def collapsed(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts; parts above the root are dropped."""
    step = lambda done, part: F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root ("") first."""
    parts = F.split(directory(path), "/")
    deep = F.when(directory(path) == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), deep), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def sort_key(path: Column) -> Column:
    """Sorts by components, so that ``a/b`` comes before ``a-b``."""
    return F.split(path, "/")


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def skipped(path: Column, included: tuple[str, ...] = ()) -> Column:
    """Whether a directory of the path is one that discovery leaves out."""
    names = [F.lit(d) for d in SKIPPED if d not in included]
    return F.arrays_overlap(F.split(directory(path), "/"), F.array(*names))


def in_order(many: Column) -> Column:
    """An array of paths, normalised and sorted."""
    return F.array_sort(F.transform(many, normalised))


def last_part(path: Column) -> Column:
    """The last part of a directory's name; null where there is none."""
    name = F.trim(F.trim(F.trim(path), F.lit("/")))
    return F.nullif(F.element_at(F.split(name, "/"), -1), F.lit(""))


def of_policy(path: Column) -> Column:
    """Whether a change of policy looks at a file of this name."""
    return path.rlike("(" + "|".join(e.replace(".", r"\.") for e in POLICY_ENDINGS) + ")$")


def named_by_spec(path: Column) -> Column:
    """The module that the path of a spec suggests."""
    return F.regexp_replace(F.regexp_replace(path, r"\.spec\.yml$", ""), "^(modules/)+", "")


def below_spec(path: Column) -> Column:
    """The directory that the path of a spec suggests; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(path), r"\.spec\.yml$", ""), r"^(\./)*/*", ""), F.lit(""))
