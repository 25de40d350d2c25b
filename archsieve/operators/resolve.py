"""Resolution of import specifiers to files and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.functions import names, paths
from archsieve.operators import entry_points

#: What is tried after a specifier, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.json")
#: What a written extension may stand for, in order.
ALIASES = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs")}
FIRST, THIRD, NONE = "first_party", "third_party", "unresolved"


def candidates(stem, literal: bool = False):
    """The array of paths that a stem may mean, in order. literal: it names a file, of which only the extension may stand for another."""
    usual = F.array(*[F.concat(stem, F.lit(e)) for e in (ENDINGS[:1] if literal else ENDINGS)])
    for written, real in ALIASES.items():
        cut = F.substr(stem, F.lit(1), F.length(stem) - len(written))
        usual = F.when(F.endswith(stem, F.lit(written)), F.array(*[F.concat(cut, F.lit(e)) for e in real])).otherwise(usual)
    return usual


def alias_stems(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(directory, specifier, choice, stem): the stems that aliases give to specifiers that are neither relative nor absolute.
    aliases: (prefix, replacement) and, where given, scope: the directory of the configuration, of which the nearest above
    a request counts; exact: no part is captured; tail and replacement_tail: what stands after the captured part; place: the order
    of one pattern's replacements; base: used after all patterns. Of the patterns that fit, the exact or longest counts."""
    for name, default in {"scope": "", "exact": False, "tail": "", "replacement_tail": "", "place": 0, "base": False}.items():
        if name not in aliases.columns:
            aliases = aliases.withColumn(name, F.lit(default))
    s = F.col("specifier")
    bare = pairs.where(~names.is_relative(s) & ~s.isin(".", "..") & ~F.startswith(s, F.lit("/")))
    scopes = aliases.select("scope").distinct()
    above = bare.select("directory").distinct().withColumn("scope", F.explode(paths.ancestors(F.concat("directory", F.lit("/_")))))
    own = above.join(scopes, "scope").groupBy("directory").agg(F.max_by("scope", F.length("scope")).alias("scope"))
    heads = bare.join(own, "directory").withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length(s)), lambda n: F.substr(s, F.lit(1), n))))
    rest = F.substr(s, F.length("prefix") + 1, F.length(s))
    fits = heads.join(aliases, ["scope", "prefix"]).where((F.col("exact") & (rest == "")) | (~F.col("exact") & F.endswith(rest, F.col("tail"))))
    captured = F.substr(rest, F.lit(1), F.length(rest) - F.length("tail"))
    kind = F.struct("base", (~F.col("exact")).alias("loose"), (-F.length("prefix")).alias("short"))
    best = F.min(F.when(~F.col("base"), kind)).over(W.partitionBy("directory", "specifier"))
    kept = fits.withColumn("kind", kind).withColumn("best", best).where("base or kind = best")
    stem = paths.collapsed(F.concat("replacement", F.when(F.col("exact"), F.lit("")).otherwise(captured), "replacement_tail"))
    return kept.select("directory", "specifier", F.struct("base", "place").alias("choice"), stem.alias("stem"))


def resolve(requests: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """requests (directory, specifier, ...) with kind, target and package. files: (path). packages: (package), those that are
    installed; aliases: see ``alias_stems``; entries: those of manifests (``entry_points.entries``). Each different pair of directory and
    specifier is resolved once: relative paths and aliases first, then entry points of packages. A package with a manifest is third
    party only if the manifest has the entry that is asked for, one below node_modules without any look at its files."""
    pairs = requests.select("directory", "specifier").distinct()
    s = F.col("specifier")
    stem = F.when(names.is_relative(s) | s.isin(".", ".."), paths.collapsed(F.concat_ws("/", "directory", "specifier"))).when(F.startswith(s, F.lit("/")), paths.collapsed(s))
    stems = pairs.select("directory", "specifier", F.struct(F.lit(False).alias("base"), F.lit(0).alias("place")).alias("choice"), stem.alias("stem")).where("stem is not null")
    if aliases is not None:
        stems = stems.unionByName(alias_stems(pairs, aliases))
    none = F.lit(None).cast("string")
    rows = stems.select("directory", "specifier", F.struct(F.lit(0).alias("way"), F.lit(0).alias("first"), F.col("choice.base").cast("int").alias("base"), F.col("choice.place").alias("of")).alias("choice"), "stem", F.lit(False).alias("literal"), F.lit(None).cast("boolean").alias("entered"), none.alias("other"))
    if entries is not None:
        own = entry_points.stems(pairs, entries)
        choice = F.struct(F.lit(1).alias("way"), F.col("place.first").alias("first"), F.lit(0).alias("base"), F.col("place.place").alias("of"))
        other = F.when(F.startswith(s, F.lit("#")) & F.col("inside"), F.regexp_extract("root", "(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1))
        rows = rows.unionByName(own.select("directory", "specifier", choice.alias("choice"), "stem", "literal", (F.col("inside") & F.col("stem").isNotNull()).alias("entered"), other.alias("other")))
    # files are looked up once a stem, which many requests may share; a null stem has a key of its own, for nulls would meet in one task
    at = F.coalesce("stem", F.concat(F.lit("\0"), "directory", F.lit("\0"), "specifier"))
    tried = rows.where("stem is not null").select("stem", "literal").distinct()
    tried = tried.select(F.col("stem").alias("_at"), "literal", F.posexplode(F.when(F.col("literal"), candidates(F.col("stem"), literal=True)).otherwise(candidates(F.col("stem")))).alias("place", "path"))
    first = tried.join(files.select("path").distinct(), "path").groupBy("_at", "literal").agg(F.min(F.struct("place", "path")).alias("there"))
    met = rows.withColumn("_at", at).join(first, ["_at", "literal"], "left")
    found = met.groupBy("directory", "specifier").agg(F.min_by("there.path", F.when(F.col("there").isNotNull(), F.struct("choice", "there.place"))).alias("_target"), F.bool_or("entered").alias("_entered"), F.max("other").alias("_other"))
    out = requests.join(found, ["directory", "specifier"], "left").withColumn("_package", F.coalesce(F.when(names.is_bare(s) & ~F.startswith(s, F.lit("#")), names.package(s)), "_other"))
    builtin = names.is_builtin(s) & names.is_bare(s)
    installed = F.lit(False)
    if packages is not None:
        out = out.join(packages.select(F.col("package").alias("_package"), F.lit(True).alias("_installed")).distinct(), "_package", "left")
        installed = F.coalesce("_installed", installed)
    installed = F.coalesce("_entered", installed)  # null where no package with a manifest is asked for
    kind = F.when(F.startswith(s, F.lit("node:")) & builtin, THIRD).when(F.col("_target").isNotNull(), FIRST).when(installed | builtin, THIRD).otherwise(NONE)
    kind = F.when(F.col("directory").isNotNull() & s.isNotNull(), kind)
    more = [c for c in requests.columns if c not in ("directory", "specifier")]
    return out.select("directory", "specifier", *more, kind.alias("kind"), F.col("_target").alias("target"), F.when(kind == THIRD, F.col("_package")).alias("package"))


def explain(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, specifier, place, path, exists): every path that is tried, in order."""
    s = F.col("specifier")
    tried = requests.select("directory", "specifier").distinct().where(names.is_relative(s)).select("directory", "specifier", F.posexplode(candidates(paths.collapsed(F.concat_ws("/", "directory", "specifier")))).alias("place", "path"))
    return tried.join(files.select("path", F.lit(True).alias("exists")).distinct(), "path", "left").select("directory", "specifier", "place", "path", F.coalesce("exists", F.lit(False)).alias("exists"))


def nearest(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(path, directory): the deepest of the given directories above each file."""
    above = files.select("path").distinct().withColumn("directory", F.explode(paths.ancestors(F.col("path"))))
    return above.join(directories.distinct(), "directory").groupBy("path").agg(F.max_by("directory", F.length("directory")).alias("directory"))


def lost_kind(specifier: Column, external: Column, dynamic: Column, known: Column) -> Column:
    """How an import without a target counts among the edges; ``known`` says that it names a module by its agreed id."""
    outside = F.coalesce(external, F.lit(False)) | F.coalesce(known, F.lit(False)) | names.is_bare(specifier)
    return F.when(outside, "external").when(dynamic, "unresolved_dynamic").otherwise("unresolved_literal")
