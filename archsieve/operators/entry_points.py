"""Entry points of packages: what a specifier that names a package, or one of a package's own ``#`` names, stands for.

The ``exports``, ``imports`` and main fields of all manifests become one table of patterns with ordered targets. Requests meet it in
equi-joins: their directories' ancestors find the package, the prefixes of their subpath its patterns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.functions import names, paths

#: Conditions that hold, and the fields that name a package's main file, in order.
CONDITIONS = ("import", "require", "node", "types", "default")
MAIN_FIELDS = ("module", "main")
#: A row a target. kind: package (one a manifest), exports, imports, main (no exports: any file below the root) or unreadable.
#: exact: no part is captured; else what stands between prefix and tail replaces each star of the target. A null target blocks.
ENTRIES = "package string, root string, kind string, prefix string, tail string, exact boolean, place int, target string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string()]


def targets(value: object, conditions: tuple[str, ...]) -> list[str | None] | None:
    """The targets of an entry in order; [None]: the entry is closed, None: no condition of it holds."""
    if value is None:
        return [None]
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        found = [t for v in value for t in targets(v, conditions) or [] if t is not None]
        return found or ([None] if value else None)
    if isinstance(value, dict):
        for name, inner in value.items():  # the order of the file decides, not that of the conditions
            if (name == "default" or name in conditions) and (found := targets(inner, conditions)) is not None:
                return found
    return None


def rows_of(text: str, conditions: tuple[str, ...], main_fields: tuple[str, ...]) -> list[tuple]:
    """(package, kind, prefix, tail, exact, place, target) of a manifest."""
    try:
        raw = json.loads((text or "").removeprefix("\ufeff"))
        if not isinstance(raw, dict):
            raise ValueError("a manifest is an object")
    except ValueError as e:
        return [(None, "unreadable", None, None, None, None, str(e))]
    package = raw.get("name") if isinstance(raw.get("name"), str) else None
    out = [(package, "package", None, None, None, None, None)]

    def add(kind: str, key: str, value: object) -> None:
        if key.count("*") > 1 or key.endswith("/"):
            return
        prefix, star, tail = key.partition("*")
        out.extend((package, kind, prefix, tail, not star, i, t) for i, t in enumerate(targets(value, conditions) or ()))

    exports = raw.get("exports")
    if exports is None:
        mains = [raw[f] for f in main_fields if isinstance(raw.get(f), str) and raw[f]]
        out += [(package, "main", ".", "", True, i, f"./{t}") for i, t in enumerate([*mains, "index"])]
        out.append((package, "main", "./", "", False, 0, "./*"))
    else:
        listed = isinstance(exports, dict) and any(k.startswith(".") for k in exports)
        for key, value in exports.items() if listed else [(".", exports)]:
            add("exports", key, value)
    for key, value in (raw.get("imports") or {}).items() if isinstance(raw.get("imports"), dict) else ():
        add("imports", key, value)
    return out


def entries(manifests: DataFrame, conditions: tuple[str, ...] = CONDITIONS, main_fields: tuple[str, ...] = MAIN_FIELDS) -> DataFrame:
    """The ENTRIES of manifests (path, content); one that cannot be read is a row of its own, with the reason as its target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(root, *row) for root, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in rows_of(text, conditions, main_fields)]
            columns = [pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i + 2] for f in found], t) for i, t in enumerate(_TYPES[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=["package", "root", "kind", "prefix", "tail", "exact", "place", "target"])

    return manifests.select(paths.directory(F.col("path")).alias("root"), "content").mapInArrow(run, ENTRIES)


def roots(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(directory, package, root): where each package that a directory asks for lies: in the nearest node_modules above it, else in the tree."""
    asked = pairs.select("directory", "package").distinct()
    own = table.where("kind = 'package' and package is not null").select("package", "root").distinct()
    inside = F.endswith("root", F.concat(F.lit("node_modules/"), "package"))
    scope = F.rtrim(F.expr("left(root, length(root) - length(package) - length('node_modules/'))"), F.lit("/"))
    near = own.where(inside).select("package", "root", scope.alias("scope"))
    linked = own.where(~inside).groupBy("package").agg(F.min("root").alias("linked"))
    above = asked.withColumn("scope", F.explode(paths.ancestors(F.concat("directory", F.lit("/_"))))).join(near, ["package", "scope"])
    nearest = above.groupBy("directory", "package").agg(F.max_by("root", F.length("scope")).alias("nearest"))
    found = asked.join(nearest, ["directory", "package"], "left").join(linked, "package", "left")
    return found.select("directory", "package", F.coalesce("nearest", "linked").alias("root")).where("root is not null")


def matched(asked: DataFrame, table: DataFrame) -> DataFrame:
    """asked (.., root, key) with place and target (null: closed) of the pattern that fits best: an exact one, else that with the longest
    prefix, then the longest tail. What no pattern fits is not there."""
    whole = [c for c in asked.columns]
    heads = asked.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substr("key", F.lit(1), n))))
    rest = F.substr("key", F.length("prefix") + 1, F.length("key"))
    fits = heads.join(table.select("root", "prefix", "tail", "exact", "place", "target"), ["root", "prefix"])
    fits = fits.where((F.col("exact") & (rest == "")) | (~F.col("exact") & F.endswith(rest, F.col("tail")) & (F.length(rest) > F.length("tail"))))
    kind = F.struct((~F.col("exact")).alias("loose"), (-F.length("prefix")).alias("short"), (-F.length("tail")).alias("end"))
    best = fits.withColumn("kind", kind).withColumn("best", F.min("kind").over(W.partitionBy(*whole))).where("kind = best")
    captured = F.substr(rest, F.lit(1), F.length(rest) - F.length("tail"))
    return best.select(*whole, "place", F.when(F.col("exact"), F.col("target")).otherwise(F.replace("target", F.lit("*"), captured)).alias("target"))


def stems(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(directory, specifier, place, stem, literal, root, inside): what requests for packages stand for. literal: the target is a
    file, nothing is added to it; stem is null where the package has no such entry or closes it; inside: below node_modules."""
    s = F.col("specifier")
    own = pairs.select("directory", "specifier").distinct()
    # names of a package's own: the nearest manifest above says what they are, a path or another package
    scopes = table.where("kind = 'package'").select(F.col("root").alias("scope")).distinct()
    marked = own.where(F.startswith(s, F.lit("#")))
    above = marked.select("directory").distinct().withColumn("scope", F.explode(paths.ancestors(F.concat("directory", F.lit("/_"))))).join(scopes, "scope")
    home = above.groupBy("directory").agg(F.max_by("scope", F.length("scope")).alias("root"))
    imports = matched(marked.join(home, "directory").select("directory", "specifier", "root", s.alias("key")), table.where("kind = 'imports'"))
    local = F.startswith("target", F.lit("./"))
    bare = own.where(names.is_bare(s) & ~F.startswith(s, F.lit("#"))).select("directory", "specifier", F.col("directory").alias("at"), s.alias("wanted"), F.lit(0).alias("first"))
    bare = bare.unionByName(imports.where(~local).select("directory", "specifier", F.col("root").alias("at"), F.col("target").alias("wanted"), F.col("place").alias("first")))
    named = bare.withColumn("package", names.package(F.col("wanted"))).where("package is not null")
    key = F.concat(F.lit("."), F.substr("wanted", F.length("package") + 1, F.length("wanted")))
    lie = named.join(roots(named.select(F.col("at").alias("directory"), "package"), table).withColumnRenamed("directory", "at"), ["at", "package"])
    asked = lie.select("directory", "specifier", "first", "root", key.alias("key"))
    # many directories ask for the same entry of a package: each is looked up once
    keys = asked.select("root", "key").distinct()
    found = matched(keys, table.where("kind in ('exports', 'main')"))
    modern = table.where("kind = 'exports'").select("root", F.lit(True).alias("literal")).distinct()
    below = F.col("root").rlike("(^|/)node_modules/")
    stem = lambda root: F.when(F.startswith("target", F.lit("./")), paths.collapsed(F.concat_ws("/", root, "target")))
    meant = keys.join(found, ["root", "key"], "left").join(modern, "root", "left").select("root", "key", F.coalesce("place", F.lit(0)).alias("place"), stem("root").alias("stem"), F.coalesce("literal", F.lit(False)).alias("literal"), below.alias("inside"))
    out = asked.join(meant, ["root", "key"]).select("directory", "specifier", F.struct("first", "place").alias("place"), "stem", "literal", "root", "inside")
    paths_of = imports.where(local | F.col("target").isNull()).select("directory", "specifier", F.struct(F.col("place").alias("first"), F.lit(0).alias("place")).alias("place"), stem("root").alias("stem"), F.lit(True).alias("literal"), "root", below.alias("inside"))
    return out.unionByName(paths_of)
