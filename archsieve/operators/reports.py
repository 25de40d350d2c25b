"""Reports for people and for other programs: (line, text) rows, to be read in order of ``line``.

Rows keep their order through a key, so that a long report is sorted and written by Spark: nothing is gathered on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.operators import violations
from archsieve.operators.snapshots import NARROWING, STRUCTURAL, WIDENING

KEY = "section int, first string, second string, third string"


def section(rows: DataFrame, number: int, text: Column, *order: Column | str) -> DataFrame:
    """Lines of one section of a report, in their order."""
    keys = [F.coalesce(F.col(o) if isinstance(o, str) else o, F.lit("")) for o in order] + [F.lit("")] * (3 - len(order))
    return rows.select(F.lit(number).alias("section"), *[k.alias(n) for k, n in zip(keys, ("first", "second", "third"))], text.alias("text"))


def report(*sections: DataFrame) -> DataFrame:
    """(section, first, second, third, text), sorted."""
    return violations.union(*sections).orderBy("section", "first", "second", "third", "text")


def texts(rows: DataFrame, path: str) -> None:
    """Writes the lines of a report as text files, in order."""
    rows.orderBy("section", "first", "second", "third", "text").select("text").write.mode("overwrite").text(path)


def place(file: Column, line: Column) -> Column:
    return F.concat_ws(":", F.coalesce(file, F.lit("-")), line.cast("string"))


def padded(line: Column) -> Column:
    return F.lpad(F.coalesce(line, F.lit(0)).cast("string"), 10, "0")


def finding_line() -> Column:
    """A finding in one line: its severity, whether it is accepted, its rule, place and message."""
    accepted = F.when(F.col("disposition") == "baseline", " (baseline)").otherwise("")
    to = F.when(F.col("to_file").isNotNull(), F.concat(F.lit(" -> "), "to_file")).otherwise("")
    return F.concat(F.upper("severity"), accepted, F.lit(" ["), "rule", F.lit("] "), place(F.col("from_file"), F.col("line")), to, F.lit(": "), F.coalesce("message", F.lit("")))


def summary_line() -> Column:
    """The counts of a verdict in one line."""
    part = lambda n, c: F.concat(F.lit(f"{n}="), F.col(c).cast("string"))
    return F.concat_ws(" ", F.concat(F.lit("Summary: "), "status"), part("total", "total"), part("new", "new_violations"), part("baseline", "baseline_violations"), part("errors", "new_errors"), part("warnings", "new_warnings"))


def summary_table(counts: DataFrame) -> DataFrame:
    """The counts of a verdict as one tab-separated line under its names."""
    names = ["total", "new_violations", "baseline_violations", "errors", "warnings", "new_errors", "new_warnings"]
    body = F.concat_ws("\t", *[F.col(n).cast("string") for n in names])
    return report(section(counts, 0, F.lit("\t".join(names))), section(counts, 1, body))


def verdict(found: DataFrame, summary: DataFrame, classification: DataFrame | None = None, unresolved: DataFrame | None = None) -> DataFrame:
    """A verdict for people. found: classified findings; summary: their counts with the status; classification: one row of edge
    counts; unresolved: (from_file, line, specifier)."""
    told = F.array_compact(F.array(F.when(F.col("total") == 0, F.struct(F.lit(0).alias("section"), F.lit("No violations found").alias("text"))), F.struct(F.lit(2).alias("section"), summary_line().alias("text"))))
    counted = summary.select(F.inline(told)).select("section", *[F.lit("").alias(n) for n in ("first", "second", "third")], "text")  # both lines from one reading
    parts = [section(found, 1, finding_line(), "from_file", padded(F.col("line")), "rule"), counted]
    if classification is not None:
        shown = F.concat_ws("  ", *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in (("Resolved", "resolved"), ("Type-only", "type_only"), ("External", "external"), ("Unresolved", "unresolved"))])
        parts.append(section(classification, 3, F.concat(F.lit("Edges: "), shown)))
    if unresolved is not None:
        parts.append(section(unresolved, 4, F.concat(F.lit("Unresolved: "), place(F.col("from_file"), F.col("line")), F.lit(" -> "), "specifier"), "from_file", padded(F.col("line")), "specifier"))
    return report(*parts)


def policy(changes: DataFrame, config_changes: DataFrame, compensations: DataFrame, summary: DataFrame, base: str, head: str) -> DataFrame:
    """A policy difference for people: what widens, narrows and is structural, then the configuration, what offsets what, and the counts."""
    kinds = (WIDENING, NARROWING, STRUCTURAL)
    top = section(summary, 0, F.lit(f"Policy diff: base={base} head={head}"))
    line = F.concat(F.lit("  "), "module", F.lit(" "), "field", F.coalesce(F.concat(F.lit(" ["), "subject", F.lit("]")), F.lit("")), F.lit(": "), F.coalesce("detail", F.lit("")))
    parts = [top]
    for n, kind in enumerate(kinds):
        mine = changes.where(F.col("classification") == kind)
        count = mine.agg(F.count("*").alias("n")).where("n > 0")
        parts += [section(count, 10 + 2 * n, F.concat(F.lit(f"{kind.upper()} ("), F.col("n").cast("string"), F.lit("):"))), section(mine, 11 + 2 * n, line, "module", "field", "subject")]
    parts.append(section(config_changes, 20, F.concat(F.lit("  config "), F.col("classification"), F.lit(" "), "field", F.lit(": "), F.coalesce("detail", F.lit(""))), "field"))
    made_good = F.concat(F.lit("  COMPENSATED ("), "result", F.lit("): widening in "), "widened", F.lit("/"), "field", F.lit(" by narrowing in "), "narrowed", F.lit("/"), "field")
    parts.append(section(compensations, 21, made_good, "widened", "field", "narrowed"))
    counts = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in (("modules_changed", "changed"), ("widening", "widenings"), ("narrowing", "narrowings"), ("structural", "structurals"), ("net", "net"))])
    return report(*parts, section(summary, 30, F.concat(F.lit("Summary: "), counts)))


def policy_events(changes: DataFrame, config_changes: DataFrame, compensations: DataFrame, summary: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A policy difference as JSON lines: errors, changes, changes of the configuration, compensations and the summary, in this order."""
    event = lambda df, kind: F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns))
    parts = [] if errors is None else [section(errors, 0, event(errors, "error"), "spec_path")]
    parts += [section(changes, 1, event(changes, "change"), "module", "field", "subject"), section(config_changes, 2, event(config_changes, "config_change"), "field")]
    parts += [section(compensations, 3, event(compensations, "compensation"), "widened", "field", "narrowed"), section(summary, 4, event(summary, "summary"))]
    return report(*parts)


def policy_json(changes: DataFrame, config_changes: DataFrame, compensations: DataFrame, summary: DataFrame) -> DataFrame:
    """A policy difference as one JSON text. It is one document by its format; one aggregation gathers each of its lists."""
    many = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    one = summary.select(F.struct(*summary.columns).alias("summary"))
    whole = many(changes, "changes").crossJoin(many(config_changes, "config_changes")).crossJoin(many(compensations, "compensations")).crossJoin(one)  # one row by one row
    return whole.select(F.to_json(F.struct("changes", "config_changes", "compensations", "summary")).alias("value"))


def numbered(rows: DataFrame) -> DataFrame:
    """(line, text) of a report that one task may hold, such as a summary."""
    return rows.select(F.row_number().over(W.orderBy("section", "first", "second", "third", "text")).alias("line"), "text")


def error(code: str, message: str, details: list[str] = ()) -> str:
    """The JSON text of a run that failed."""
    return json.dumps({"schema_version": "2.2", "status": "error", "code": code, "message": message, "details": sorted(set(details))})
