"""Boundaries between modules.

Everything that depends on modules alone is decided once for each pair of modules with an edge, and whether a file is
public once for each target file. Edges then meet two small tables; patterns are never matched edge by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archsieve.functions import globs, names
from archsieve.operators.violations import violation


def module_pairs(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """A row for each pair of modules with an edge between them, with what their specs say about each other."""
    return decided(edges.where("from_module <> to_module").select("from_module", "to_module").distinct(), specs)


def decided(pairs: DataFrame, specs: DataFrame) -> DataFrame:
    """The same for given pairs (from_module, to_module)."""
    importer = specs.select(F.col("module").alias("from_module"), "never_imports", "allow_imports_from", "allow_type_imports_from", F.col("enforce_in_tests").alias("importer_in_tests"))
    provider = specs.select(F.col("module").alias("to_module"), "public_api", "deny_imported_by", "allow_imported_by", "visibility", "friend_modules", "enforce_canonical_imports", F.col("enforce_in_tests").alias("provider_in_tests"))
    a, b = F.col("from_module"), F.col("to_module")
    any_of = globs.matches_any
    joined = pairs.join(importer, "from_module", "left").join(provider, "to_module", "left")
    return joined.select(
        "from_module", "to_module",
        any_of(b, F.col("never_imports")).alias("never"),
        (F.col("allow_imports_from").isNotNull() & ~any_of(b, F.col("allow_imports_from"))).alias("not_allowed"),
        any_of(b, F.col("allow_type_imports_from")).alias("type_allowed"),
        any_of(a, F.col("deny_imported_by")).alias("denied"),
        ((F.size(F.coalesce("allow_imported_by", F.array().cast("array<string>"))) > 0) & ~any_of(a, F.col("allow_imported_by"))).alias("not_listed"),
        (F.col("visibility") == "private").alias("private"),
        ((F.col("visibility") == "internal") & ~any_of(a, F.col("friend_modules"))).alias("stranger"),
        F.coalesce("enforce_canonical_imports", F.lit(False)).alias("canonical"),
        F.coalesce("importer_in_tests", F.lit(False)).alias("importer_in_tests"), F.coalesce("provider_in_tests", F.lit(False)).alias("provider_in_tests"),
    )


def hidden_files(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """Target files that their module's public interface does not name."""
    return with_hidden(edges.select("to_file", "to_module").distinct(), specs).where("hidden").select("to_file", "hidden")


def with_hidden(files: DataFrame, specs: DataFrame) -> DataFrame:
    """Files (to_file, to_module) with hidden: whether their module's public interface does not name them."""
    api = specs.where(F.size("public_api") > 0).select(F.col("module").alias("to_module"), "public_api")
    return files.join(api, "to_module", "left").withColumn("hidden", F.col("public_api").isNotNull() & ~globs.matches_any(F.col("to_file"), F.col("public_api"))).drop("public_api")


def relevant(edges: DataFrame, type_only: bool) -> DataFrame:
    """Edges that the rules look at."""
    crossing = edges.where("from_module <> to_module and not ignored")
    return crossing if type_only else crossing.where("not type_only")


def judged(edges: DataFrame, specs: DataFrame, type_only: bool, pairs: DataFrame | None = None, hidden: bool = True) -> DataFrame:
    """Relevant edges with what is decided for their modules and, if asked, their target file."""
    if "relative" not in edges.columns:
        edges = edges.withColumn("relative", names.is_relative(F.col("specifier")))
    seen = relevant(edges, type_only).join(module_pairs(edges, specs) if pairs is None else pairs, ["from_module", "to_module"])
    return seen.join(hidden_files(edges, specs), "to_file", "left") if hidden and "hidden" not in edges.columns else seen


def importer_rule() -> Column:
    """The importing module's rule that an edge breaks; the first that applies counts."""
    carved = F.col("type_only") & F.col("type_allowed")
    rule = F.when(F.col("never"), "boundary.never_imports").when(F.col("not_allowed") & ~carved, "boundary.allow_imports_from").when(F.col("hidden"), "boundary.public_api")
    return F.when(~F.col("from_test") | F.col("importer_in_tests"), rule)


def provider_rule() -> Column:
    """The target module's rule that an edge breaks; the first that applies counts."""
    rule = (
        F.when(F.col("denied"), "boundary.deny_imported_by").when(F.col("not_listed"), "boundary.allow_imported_by").when(F.col("private"), "boundary.visibility.private")
        .when(F.col("stranger"), "boundary.visibility.internal").when(F.col("canonical") & F.col("relative"), "boundary.canonical_import")
    )
    return F.when(~F.col("from_test") | F.col("provider_in_tests"), rule)


def importer_side(edges: DataFrame, specs: DataFrame, type_only: bool = False) -> DataFrame:
    """Findings of the importing module's rules."""
    return findings(judged(edges, specs, type_only), F.array(importer_rule()))


def provider_side(edges: DataFrame, specs: DataFrame, type_only: bool = False) -> DataFrame:
    """Findings of the target module's rules."""
    return findings(judged(edges, specs, type_only, hidden=False), F.array(provider_rule()))


def findings(seen: DataFrame, rules: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each rule that an edge breaks; rules: an array, null where none is broken. keep: more columns of the edges."""
    message = F.concat(F.col("from_module"), F.lit(" imports "), F.col("to_module"))
    hit = seen.withColumn("rule", F.explode(F.array_compact(rules))).withColumn("message", message)
    named = {c: F.col(c) for c in ("rule", "message", "from_file", "to_file", "from_module", "to_module", "line")}
    return hit.select(*violation(severity=F.lit("error"), **named), *keep)


def evaluate(edges: DataFrame, specs: DataFrame, type_only: bool = False, pairs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of both sides: an edge can break a rule of either module. Edges are read once for both; with pairs (``decided`` for all
    modules, where these are few) and edges that say themselves what is hidden, no pass before collects pairs and files."""
    return findings(judged(edges, specs, type_only, pairs), F.array(importer_rule(), provider_rule()), keep)
