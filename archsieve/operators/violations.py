"""The shape that all rules give their findings, their severities, and the verdict over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archsieve.functions import hashing

COLUMNS = ("rule", "severity", "message", "from_file", "to_file", "from_module", "to_module", "line")
#: Rules whose severity the importing module's constraints set; the target module's set the others.
OF_IMPORTER = ("boundary.never_imports", "boundary.allow_imports_from", "enforce-layer", "enforce-category")
#: The order of a verdict's rows.
ORDER = ("from_file", "line", "to_file", "rule", "severity", "fingerprint", "message")


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def violation(**columns: Column) -> list[Column]:
    """The columns of a finding; what is not given is null."""
    kinds = dict.fromkeys(COLUMNS, "string") | {"line": "int"}
    return [columns.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS]


def union(*parts: DataFrame) -> DataFrame:
    """All findings of several rules."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_severity(found: DataFrame, constraints: DataFrame, default: str = "error") -> DataFrame:
    """The strictest severity that a constraint of the responsible module sets for a rule. Constraints are declared by people: all tasks
    get their list, and findings stay where they are."""
    rules = constraints.groupBy("module", "rule").agg(F.min(rank(F.col("severity"))).alias("rank"))
    owner = F.when(F.col("rule").isin(*OF_IMPORTER), F.col("from_module")).otherwise(F.col("to_module"))
    joined = found.drop("severity").withColumn("module", owner).join(F.broadcast(rules), ["module", "rule"], "left")
    named = F.when(F.col("rank") == 0, "error").when(F.col("rank") == 1, "warning").otherwise(default)
    return joined.withColumn("severity", named).drop("module", "rank").select(*found.columns)


def fingerprinted(found: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", hashing.violation_fingerprint())


def summary(classified: DataFrame) -> DataFrame:
    """One row of counts. classified has severity and disposition (new or baseline)."""
    new, error = F.col("disposition") == "new", F.col("severity") == "error"
    return classified.agg(
        F.count("*").alias("total"), F.count_if(new).alias("new_violations"), F.count_if(~new).alias("baseline_violations"), F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"),
        F.count_if(new & error).alias("new_errors"), F.count_if(new & ~error).alias("new_warnings"),
    )


def status(counts: DataFrame, stale_fails: bool = False, stale: Column | None = None, widened: bool = False) -> DataFrame:
    """Adds status: fail on new errors, on stale entries where the policy says so, and on denied widenings."""
    bad = F.col("new_errors") > 0
    if stale_fails and stale is not None:
        bad = bad | (stale > 0)
    return counts.withColumn("status", F.when(bad | F.lit(widened), "fail").otherwise("pass"))


def diff_line() -> Column:
    """A line of the diff view: + for new, a space for accepted findings."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws("\t", F.when(F.col("disposition") == "new", "+").otherwise(" "), part("severity"), part("rule"), part("from_file"), part("line"), part("to_file"), part("message"))


def ndjson(found: DataFrame) -> DataFrame:
    """One JSON object a finding."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def rule_levels(found: DataFrame) -> DataFrame:
    """(rule, level): each rule once, at its strictest severity."""
    levels = found.groupBy("rule").agg(F.min(rank(F.col("severity"))).alias("rank"), F.count("*").alias("results"))
    return levels.select("rule", F.when(F.col("rank") == 0, "error").otherwise("warning").alias("level"), "results")


def title(rule: Column) -> Column:
    """A rule's id as words: ``ns.some_name`` gives ``Ns: some name``."""
    return F.concat_ws(": ", F.initcap(F.substring_index(rule, ".", 1)), F.nullif(F.translate(F.regexp_extract(rule, r"\.(.*)$", 1), "_-.", "   "), F.lit("")))


def sarif(found: DataFrame) -> DataFrame:
    """One JSON text: the SARIF log of the findings (severity, fingerprint and the columns of a finding). The log is one
    document by its format; the rules and results are gathered by one aggregation."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("from_file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    results = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("from_file", "line", "to_file", "rule", "fingerprint", result.alias("result")))), lambda x: x["result"]).alias("results"))
    rules = rule_levels(found).agg(F.array_sort(F.collect_list(F.struct(F.col("rule").alias("id"), F.struct(title(F.col("rule")).alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration")))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("archsieve").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return results.crossJoin(rules).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))  # one row by one row
