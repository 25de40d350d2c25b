"""Third-party packages: policy, deep imports and test boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archsieve.functions import globs, names
from archsieve.operators.violations import violation


def usage(imports: DataFrame) -> DataFrame:
    """(from_file, from_module, from_test, specifier, runtime): a row for each file and specifier; runtime if one use of it is."""
    return imports.groupBy("from_file", "from_module", "from_test", "specifier").agg(F.bool_or(~F.col("type_only")).alias("runtime"))


def package_policy(used: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings of forbidden and not allowed packages. policies: (module, forbidden, allowed, enforce_in_tests). Test files are
    exempt from allow lists unless their module says otherwise, never from what is forbidden. Type-only use is no use."""
    joined = used.where("runtime").withColumn("package", names.package(F.col("specifier"))).join(policies.withColumnRenamed("module", "from_module"), "from_module")
    any_of = globs.matches_any
    exempt = F.col("from_test") & ~F.col("enforce_in_tests")
    rule = F.when(any_of(F.col("package"), F.col("forbidden")), "dependency.forbidden").when((F.size("allowed") > 0) & ~any_of(F.col("package"), F.col("allowed")) & ~exempt, "dependency.not_allowed")
    hit = joined.where("package is not null").withColumn("rule", rule).where("rule is not null").withColumn("message", F.concat(F.lit("uses "), F.col("package")))
    return hit.select(*violation(severity=F.lit("error"), **{c: F.col(c) for c in ("rule", "message", "from_file", "from_module")}))


def deep_imports(used: DataFrame, entries: list[tuple[str, int, str]], overrides: DataFrame | None = None) -> DataFrame:
    """Imports deeper into a package than the first entry (pattern, most depth, severity) that fits them allows. overrides: (module,
    place, pattern, max_depth, allow): of the first that fits in the importing module, ``allow`` lets all through and its depth
    counts before the entry's; its severity stays the entry's, or warning."""
    s, p = F.col("specifier"), names.package(F.col("specifier"))
    used = used.withColumn("entry", F.lit(None).cast("struct<most:int,severity:string>"))
    if entries:
        first = None
        for pattern, most, severity in entries:
            fits = s.rlike(globs.compile_glob(pattern)) | p.rlike(globs.compile_glob(pattern)) | (s == pattern) | (p == pattern)
            entry = F.struct(F.lit(most).alias("most"), F.lit(severity).alias("severity"))
            first = F.when(fits, entry) if first is None else first.when(fits, entry)
        used = used.withColumn("entry", first)
    most, severity = F.col("entry.most"), F.col("entry.severity")
    if overrides is not None:
        asked = used.select("from_module", "specifier").distinct().join(overrides.withColumnRenamed("module", "from_module"), "from_module")
        fits = (s == F.col("pattern")) | (p == F.col("pattern")) | globs.matches_any(s, F.array("pattern")) | globs.matches_any(p, F.array("pattern"))
        own = asked.where(fits).groupBy("from_module", "specifier").agg(F.min_by(F.struct("allow", "max_depth"), "place").alias("own"))
        used = used.join(own, ["from_module", "specifier"], "left")
        set_here = F.col("own").isNotNull()
        most = F.when(F.col("own.allow"), F.lit(None)).when(set_here, F.coalesce("own.max_depth", "entry.most", F.lit(0))).otherwise(F.col("entry.most"))
        severity = F.coalesce("entry.severity", F.lit("warning"))
    deep = used.withColumn("depth", names.depth(names.subpath(s))).where(most.isNotNull() & (F.col("depth") > most))
    message = F.concat(s, F.lit(" is "), F.col("depth").cast("string"), F.lit(" deep"))
    return deep.select(*violation(rule=F.lit("hygiene.deep_third_party_import"), severity=severity, message=message, from_file=F.col("from_file")))


def test_modes(modules: DataFrame, usual: str) -> DataFrame:
    """(module, mode): what a module says of its test boundary, or the configuration's word."""
    return modules.select("module", F.coalesce("boundaries.import_hygiene.test_boundary.mode", F.lit(usual)).alias("mode"))


def test_boundary(edges: DataFrame, hidden: DataFrame, both_ways: bool = False, modes: DataFrame | None = None) -> DataFrame:
    """Production files that import tests; with ``both_ways`` also tests that import another module's hidden files.
    hidden: (to_file, hidden). modes: (module, mode), by which the importing module decides: off, production_only or bidirectional."""
    outward = ~F.col("from_test") & F.col("to_test")
    if modes is not None:
        edges = edges.join(modes.withColumnRenamed("module", "from_module"), "from_module", "left").where("mode is null or mode <> 'off'")
        inward = F.coalesce(F.col("mode") == "bidirectional", F.lit(both_ways))
    else:
        inward = F.lit(both_ways)
    kind = F.when(outward, "production imports a test")
    if both_ways or modes is not None:
        edges = edges.join(hidden, "to_file", "left")
        kind = kind.when(inward & F.col("from_test") & ~F.col("to_test") & (F.col("from_module") != F.col("to_module")) & F.coalesce("hidden", F.lit(False)), "a test imports a hidden file")
    hit = edges.withColumn("message", kind).where("message is not null")
    return hit.select(*violation(rule=F.lit("hygiene.test_in_production"), severity=F.lit("error"), **{c: F.col(c) for c in ("message", "from_file", "to_file", "line")}))
