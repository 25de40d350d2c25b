"""Files, modules, edges and specs read from order tables.

Nations are modules, customers and suppliers are source files, and each line item is an import from a customer's
file to a supplier's. Specs follow from a nation's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, module, layer)."""
    layer = F.lower("r_name")
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").alias("k"), F.concat(layer, F.lit("/"), "n_name").alias("module"), layer.alias("layer"))


def path(kind: str, module: str, key: str) -> Column:
    """The path of a customer's or supplier's file."""
    return F.concat(F.lit("src/"), module, F.lit(f"/{kind}/"), F.col(key).cast("string"), F.lit(".ts"))


def in_modules(rows: DataFrame, nation: str, named: DataFrame) -> DataFrame:
    """Rows with the module (k, module) of their nation. Modules are a short list that people declare: all tasks get it."""
    return rows.join(F.broadcast(named.select("k", "module")), F.col(nation) == F.col("k")).drop("k")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("is_test", F.col("c_mktsegment") == "MACHINERY")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumn("is_test", F.col("s_suppkey") % 7 == 0)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, module, is_test, kind, key)."""
    named = modules(spark, sf_dir)
    side = lambda rows, kind, nation, key: in_modules(rows, nation, named).select(path(kind, "module", key).alias("path"), "module", "is_test", F.lit(kind).alias("kind"), F.col(key).alias("key"))
    return side(customers(spark, sf_dir), "customer", "c_nationkey", "c_custkey").unionByName(side(suppliers(spark, sf_dir), "supplier", "s_nationkey", "s_suppkey"))


def edges(spark: SparkSession, sf_dir: str, *more: str, marked: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """(from_file, to_file, from_module, to_module, from_test, to_test, specifier, relative, line, kind, type_only, ignored) and
    more columns of line items and orders. marked: adds columns to target files (to_file, to_module), which edges then have too.

    Only numbers and flags are shuffled: paths and modules are put together where all keys have met. dealt: the last join, by customer,
    is one of sorted sides even where customers are few, so edges lie by ``o_custkey``, and what is grouped within it stays where it is."""
    named, flag, relative = modules(spark, sf_dir), F.col("l_returnflag"), F.col("l_partkey") % 2 == 0
    to = suppliers(spark, sf_dir).select("s_suppkey", "s_nationkey", F.col("is_test").alias("to_test"))
    if marked is not None:
        at = in_modules(to, "s_nationkey", named).withColumn("to_file", path("supplier", "module", "s_suppkey")).withColumnRenamed("module", "to_module")
        to = marked(at).drop("to_file", "to_module")
    extra = [c for c in to.columns if c not in ("s_suppkey", "s_nationkey", "to_test")]
    items = table(spark, sf_dir, "lineitem").withColumns({"relative": relative, "type_only": flag == "R"})
    lines = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(to, F.col("l_suppkey") == F.col("s_suppkey"))
    of = customers(spark, sf_dir).select("c_custkey", "c_nationkey", F.col("is_test").alias("from_test"))
    joined = lines.join(of.hint("merge") if dealt else of, F.col("o_custkey") == F.col("c_custkey"))
    joined = in_modules(in_modules(joined, "c_nationkey", named).withColumnRenamed("module", "from_module"), "s_nationkey", named).withColumnRenamed("module", "to_module")
    return joined.select(
        path("customer", "from_module", "o_custkey").alias("from_file"), path("supplier", "to_module", "l_suppkey").alias("to_file"), "from_module", "to_module", "from_test", "to_test",
        specifier().alias("specifier"), "relative", F.col("l_linenumber").alias("line"),
        F.when(flag == "R", "type-only").when(flag == "A", "runtime").otherwise("re-export").alias("kind"), "type_only", (F.col("l_linenumber") == 7).alias("ignored"), *more, *extra,
    )


def specifier() -> Column:
    part = F.col("l_partkey").cast("string")
    return F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("../"), part)).otherwise(F.concat(F.lit("lib/"), part))


def module_edges(edges_of: DataFrame) -> DataFrame:
    """(from_module, to_module): all pairs of different modules with an import."""
    return edges_of.where("from_module <> to_module").select("from_module", "to_module").distinct()


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a module, with the fields of a module's boundaries."""
    k = F.col("k")
    globs = lambda *g: F.array(*map(F.lit, g))
    none, null = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    return modules(spark, sf_dir).select(
        "module", "k",
        F.when(k % 5 == 0, globs("asia/*", "europe/NATION_8")).otherwise(none).alias("never_imports"),
        F.when(k % 4 != 1, null).when(k % 8 == 1, none).otherwise(globs("america/*", "europe/*")).alias("allow_imports_from"),
        F.when(k % 4 == 1, globs("asia/*")).otherwise(none).alias("allow_type_imports_from"),
        F.when(k % 3 == 0, globs("src/*/supplier/*0.ts", "src/*/supplier/*5.ts")).otherwise(none).alias("public_api"),
        F.when(k % 6 == 2, globs("africa/*")).otherwise(none).alias("deny_imported_by"),
        F.when(k % 7 == 3, globs("europe/*", "asia/*")).otherwise(none).alias("allow_imported_by"),
        F.when(k % 11 == 4, "private").when(k % 5 == 1, "internal").otherwise("public").alias("visibility"),
        globs("africa/*").alias("friend_modules"),
        (k % 9 == 5).alias("enforce_canonical_imports"), (k % 2 == 0).alias("enforce_in_tests"),
    )


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, rule, severity): some modules only warn."""
    k = F.col("k")
    rules = F.array(F.lit("boundary.never_imports"), F.lit("boundary.visibility.internal"), F.lit("enforce-layer"))
    return modules(spark, sf_dir).where(k % 3 == 1).select("module", F.explode(rules).alias("rule"), F.when(k % 2 == 0, "warning").otherwise("error").alias("severity")).unionByName(
        modules(spark, sf_dir).where(k % 6 == 4).select("module", F.lit("boundary.never_imports").alias("rule"), F.lit("error").alias("severity"))
    )
