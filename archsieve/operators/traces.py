"""Walks through JSON of unknown shape by rows: each round takes all values one level down, as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.functions import hashing
from archsieve.operators.graphs import checkpointed

#: Limits of a walk; beyond them it is an error.
DEEPEST, MOST_NODES = 256, 1_000_000
#: Lines of a resolution and lookups of a request that a snapshot keeps.
MOST_LINES, MOST_LOOKUPS = 48, 32
ROW = "file string, at array<int>, v variant"
#: What an object may call its parts, the first that is a text counts.
FROM, TO, SPECIFIER = ("from", "source", "importer"), ("to", "target"), ("import_specifier", "import", "specifier")
KIND, TARGET, PACKAGE = ("result_kind", "resultKind"), ("resolved_to", "resolvedTo", "resolved"), ("package_name", "packageName")


class TraceError(ValueError):
    """A trace that cannot be read whole."""


def values(rows: DataFrame) -> DataFrame:
    """(file, at, v) of files (file, value): the JSON value of each, or those of its lines; blank files have none. at: where a value
    stands, as positions from the top. A file that is neither is an error, as is an object that repeats a key."""
    whole = rows.where(F.trim(F.regexp_replace("value", r"[\r\n\t]", " ")) != "").withColumn("v", hashing.parsed_json(F.col("value")))
    one = whole.where("v is not null").select("file", F.array(F.lit(0)).alias("at"), "v")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " ")) != "")
    many = whole.where("v is null").select("file", F.size(lines).alias("n"), F.posexplode(lines).alias("i", "line")).select("file", "n", F.array("i").alias("at"), hashing.parsed_json(F.col("line")).alias("v"))
    bad = many.where("v is null or n < 2").select("file").distinct().take(5)
    if bad:
        raise TraceError(f"neither JSON nor JSON lines: {', '.join(str(r.file) for r in bad)}")
    return one.unionByName(many.drop("n"))


def text(names: tuple[str, ...]) -> Column:
    """The first of the named fields of ``v`` that is a text."""
    of = lambda n: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) == "STRING", F.try_variant_get("v", f"$.{n}", "string"))
    return F.coalesce(*map(of, names))


def walk(rows: DataFrame, deepest: int = DEEPEST, most_nodes: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges and (file, at, from, specifier, kind, target, package) records anywhere below the values (file, at, v): objects with
    from and to, or with from and import. Fields of an object count in the order of their names. A file that is deeper or has more
    values than the limits is an error, never cut."""
    spark = rows.sparkSession
    level, depth, found, counts = checkpointed(rows.select("file", "at", "v")), 0, [], None
    while not level.isEmpty():
        seen = level.groupBy("file").agg(F.count("*").alias("n"))
        counts = checkpointed(seen if counts is None else counts.unionByName(seen).groupBy("file").agg(F.sum("n").alias("n")))
        if over := counts.where(F.col("n") > most_nodes).select("file").first():
            raise TraceError(f"{over.file} has more than {most_nodes} values")
        if depth > deepest:
            raise TraceError(f"{level.select('file').first().file} is nested more than {deepest} levels deep")
        named = level.select("file", "at", *[text(n).alias(c) for n, c in ((FROM, "from"), (TO, "to"), (SPECIFIER, "specifier"), (KIND, "kind"), (TARGET, "target"), (PACKAGE, "package"))])
        found.append(named.where("`from` <> '' and (`to` <> '' or specifier <> '')"))
        inner = spark.sql("SELECT l.file, l.at, e.pos, e.value FROM {l} AS l, LATERAL variant_explode(l.v) AS e", l=level)
        level, depth = checkpointed(inner.select("file", F.concat("at", F.array("pos")).alias("at"), F.col("value").alias("v"))), depth + 1
    empty = "file string, at array<int>, `from` string, `to` string, specifier string, kind string, target string, package string"
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)
    edges = every.where("`to` <> ''").select(F.col("from").alias("a"), F.col("to").alias("b"))
    return edges, every.where("specifier <> ''").select("file", "at", "from", "specifier", "kind", "target", "package")


def first_rows(rows: DataFrame, keys: tuple[str, ...], order: str, most: int) -> DataFrame:
    """The first rows of each key. Tasks leave out what cannot be among them before anything is shuffled."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_rank") <= most).drop("_rank")


def snapshot_lines(resolutions: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(from, specifier, at, line): the first lines of what a tool tells of each import. resolutions: (from, specifier, at, line)."""
    return first_rows(resolutions.select("from", "specifier", "at", "line"), ("from", "specifier"), "at", most)


def lookups(tried: DataFrame, most: int = MOST_LOOKUPS) -> DataFrame:
    """(directory, specifier, place, path, exists): the first paths that are tried for each request, as ``resolve.explain`` gives them."""
    return first_rows(tried, ("directory", "specifier"), "place", most)
