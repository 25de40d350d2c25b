"""Which module owns a file: module maps, ownership findings and contradictions of specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archsieve.functions import globs, paths


def glob_matches(files: DataFrame, owners: DataFrame, separate: bool = True) -> DataFrame:
    """(path, module, glob): files of owners' globs. The directories that a glob's text fixes, those of each of its
    alternatives, are met by a file's ancestors in an equi-join; the rest of the pattern is tested on what is left, so no file meets all globs."""
    keyed = owners.select("module", "glob").distinct().withColumn("pattern", globs.glob_column(F.col("glob"), separate)).withColumn("directory", F.explode(globs.static_directories(F.col("glob"))))
    above = files.select("path").distinct().withColumn("directory", F.explode(paths.ancestors(F.col("path"))))
    return above.join(keyed, "directory").where(F.rlike("path", F.col("pattern"))).select("path", "module", "glob").distinct()


def module_map(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, module, claims): the least module that claims each file, and how many do."""
    return glob_matches(files, owners).groupBy("path").agg(F.min("module").alias("module"), F.count_distinct("module").alias("claims"))


def overlaps(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, selected, modules): files that more than one module claims."""
    found = glob_matches(files, owners).groupBy("path").agg(F.min("module").alias("selected"), F.array_sort(F.collect_set("module")).alias("modules"))
    return found.where(F.size("modules") > 1)


def unclaimed(files: DataFrame, owners: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(glob_matches(files, owners, separate=False), "path", "left_anti")


def orphans(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(module, glob): globs that no file matches."""
    return owners.select("module", "glob").distinct().join(glob_matches(files, owners, separate=False).select("module", "glob").distinct(), ["module", "glob"], "left_anti")


def repeated_modules(specs: DataFrame) -> DataFrame:
    return specs.groupBy("module").agg(F.count("*").alias("specs")).where("specs > 1")


def contradictions(owners: DataFrame, files: DataFrame) -> DataFrame:
    """(module_a, module_b, glob_a, glob_b, kind): pairs of modules whose globs are equal, or claim a file both. Pairs come from
    equal globs and from files that two globs match, never from all pairs of globs."""
    rows = owners.select("module", "glob").distinct()
    a, b = (rows.select(F.col("module").alias(f"module_{s}"), F.col("glob").alias(f"glob_{s}")) for s in "ab")
    equal = a.join(b, (F.col("glob_a") == F.col("glob_b")) & (F.col("module_a") < F.col("module_b"))).withColumn("kind", F.lit("equal"))
    found = glob_matches(files, owners, separate=False)
    left = found.select("path", F.col("module").alias("module_a"), F.col("glob").alias("glob_a"))
    right = found.select("path", F.col("module").alias("module_b"), F.col("glob").alias("glob_b"))
    seen = left.join(right, "path").where("module_a < module_b and glob_a <> glob_b").select("module_a", "module_b", "glob_a", "glob_b").distinct().withColumn("kind", F.lit("shared file"))
    return equal.select("module_a", "module_b", "glob_a", "glob_b", "kind").unionByName(seen)


def governance_conflicts(specs: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """(module, conflict, detail): specs that contradict themselves. specs: (module, allow_imports_from, never_imports,
    allow_imported_by, deny_imported_by, visibility, friend_modules)."""
    text = lambda c: F.array_join(F.array_sort(c), ",")
    both = lambda a, b: F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))

    def conflict(test: Column, name: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("conflict"), detail.alias("detail")))

    out, into = both(F.col("allow_imports_from"), F.col("never_imports")), both(F.col("allow_imported_by"), F.col("deny_imported_by"))
    open_private = (F.col("visibility") == "private") & (F.size("allow_imported_by") > 0)
    found = F.array(
        conflict(F.size(out) > 0, "allowed and never imported", text(out)), conflict(F.size(into) > 0, "allowed and denied importer", text(into)),
        conflict(open_private, "private with importers", text(F.col("allow_imported_by"))), conflict(F.array_contains(F.col("never_imports"), F.col("module")), "never imports itself", F.col("module")),
    )
    return specs.select("module", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("module", "x.conflict", "x.detail").distinct()


def dangling_contracts(references: DataFrame, registry: DataFrame) -> DataFrame:
    """(module, contract, missing): contracts with references ``module:id`` that are malformed or that nobody declares."""
    known = registry.select(F.concat_ws(":", "module", "id").alias("reference")).distinct()
    bad = references.join(known, "reference", "left_anti")
    return bad.groupBy("module", "contract").agg(F.array_join(F.array_sort(F.collect_set("reference")), ",").alias("missing"))


def probes(owned: DataFrame, modules: DataFrame, made_up: str = "probe.ts") -> DataFrame:
    """(module, importer, place): a file to look at each module from: the first one outside it, else the first inside it, else one that is
    made up in the root. owned: (path, module), module null where none owns the file. Only the first file of each module meets others."""
    firsts = owned.groupBy("module").agg(F.min("path").alias("path"))
    two = firsts.orderBy("path").limit(2).agg(F.array_sort(F.collect_list(F.struct("path", "module"))).alias("two"))  # one row
    own = firsts.where("module is not null").select("module", F.col("path").alias("inside"))
    rows = modules.select("module").distinct().join(own, "module", "left").crossJoin(F.broadcast(two))
    outside = F.filter("two", lambda x: ~x["module"].eqNullSafe(F.col("module")))
    near = F.get(outside, F.lit(0))["path"]
    place = F.when(near.isNotNull(), "outside").when(F.col("inside").isNotNull(), "inside").otherwise("made up")
    return rows.select("module", F.coalesce(near, "inside", F.lit(made_up)).alias("importer"), place.alias("place"))
