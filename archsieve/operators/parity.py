"""Comparison of one import with another tool's trace: what each side says of it, and how they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archsieve.operators import resolve

UNSEEN = "not_observed"


def result_kind(target: Column, package: Column) -> Column:
    """The kind of a record that does not name it: a package is third-party, as is a target below node_modules."""
    inside = F.array_contains(F.split(F.translate(target, "\\", "/"), "/"), "node_modules")
    return F.when(package.isNotNull() | inside, resolve.THIRD).when(target.isNotNull(), resolve.FIRST).otherwise(resolve.NONE)


def looks_like_types(path: Column) -> Column:
    """Whether a target is a declaration file by its name or directory."""
    return F.coalesce(F.lower(path).rlike(r"\.d\.ts$|/types/|/@types/|index\.d\.ts"), F.lit(False))


def theirs(asked: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """What a trace says of asked imports (from_file, specifier, ours_to): columns theirs_kind, theirs_to and source. The last record
    of the import counts, else the edge to our target, else the only edge of the file, else it was not observed.
    edges: (a, b); records: (place, from, specifier, kind, target, package)."""
    named = records.select("place", F.col("from").alias("from_file"), "specifier", F.coalesce("kind", result_kind(F.col("target"), F.col("package"))).alias("kind"), "target")
    told = asked.join(named, ["from_file", "specifier"]).groupBy("from_file", "specifier").agg(F.max_by(F.struct("kind", "target"), "place").alias("told"))
    seen = asked.select("from_file", "specifier", "ours_to").join(edges.select(F.col("a").alias("from_file"), "b").distinct(), "from_file")
    seen = seen.groupBy("from_file", "specifier").agg(F.bool_or(F.coalesce(F.col("b") == F.col("ours_to"), F.lit(False))).alias("same"), F.count("*").alias("n"), F.max("b").alias("b"))
    joined = asked.join(told, ["from_file", "specifier"], "left").join(seen, ["from_file", "specifier"], "left")
    by = F.when(F.col("told").isNotNull(), "record").when(F.col("same"), "edge").when(F.col("n") == 1, "sole_edge").otherwise(UNSEEN)
    kind = F.when(by == "record", F.col("told.kind")).when(by == UNSEEN, UNSEEN).otherwise(resolve.FIRST)
    target = F.when(by == "record", F.col("told.target")).when(by == "edge", F.col("ours_to")).when(by == "sole_edge", F.col("b"))
    return joined.select(*asked.columns, kind.alias("theirs_kind"), target.alias("theirs_to"), by.alias("source"))


def tag(specifier: Column, ours_to: Column, theirs_to: Column) -> Column:
    """What two different targets of one import point at; null if nothing does."""
    relative = specifier.rlike(r"^\.{1,2}/")
    return (
        F.when(relative & specifier.rlike(r"\.(js|mjs|cjs|jsx)$"), "extension_alias")
        .when(~relative & (looks_like_types(ours_to) | looks_like_types(theirs_to)), "condition_names")
        .when(~relative & specifier.rlike("^@|/"), "paths").when(~relative, "exports")
    )


def category(specifier: Column, ours_kind: Column, ours_to: Column, theirs_kind: Column, theirs_to: Column) -> Column:
    """How the two sides of a mismatch differ."""
    first = lambda c: c == resolve.FIRST
    none = lambda c: c.isin(resolve.NONE, UNSEEN)
    return (
        F.when(first(ours_kind) & first(theirs_kind) & ~ours_to.eqNullSafe(theirs_to), F.coalesce(tag(specifier, ours_to, theirs_to), F.lit("focused_target_mismatch")))
        .when(none(ours_kind) & first(theirs_kind), "focused_ours_missing").when(first(ours_kind) & none(theirs_kind), "focused_theirs_missing")
        .when((ours_kind == resolve.THIRD) & first(theirs_kind) | first(ours_kind) & (theirs_kind == resolve.THIRD), "focused_classification_mismatch").otherwise("focused_edge_set_diff")
    )


#: What to look at for each category.
HINTS = {
    "edge_set_diff": "the edge sets differ; compare one file and import at a time",
    "focused_ours_missing": "the other tool resolved this import; check that both use one root configuration and its references",
    "focused_theirs_missing": "only we resolved this import; check that the trace is of the same build and has the importing file",
    "focused_classification_mismatch": "one side sees a package where the other sees a file; check exports, aliases and linked workspaces",
    "focused_target_mismatch": "both sides found a file, but not the same; check the order of aliases and the roots of references",
}


def hint(name: Column) -> Column:
    out = F.when(name.isin("extension_alias", "condition_names", "paths", "exports"), HINTS["focused_target_mismatch"])
    for k, text in HINTS.items():
        out = out.when(name == k, text)
    return out
