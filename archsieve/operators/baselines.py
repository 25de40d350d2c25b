"""Accepted violations: classification, staleness, refresh and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.functions import dates

#: An older name of a rule that baselines may still hold.
ALIASES = {"boundary.canonical_imports": "boundary.canonical_import"}


def rule_name(rule: Column) -> Column:
    out = rule
    for old, new in ALIASES.items():
        out = F.when(rule == old, new).otherwise(out)
    return out


def numbered(order: tuple[str, ...], *group: Column | str) -> Column:
    """The place of a row in its group."""
    return F.row_number().over(W.partitionBy(*group).orderBy(*[F.asc_nulls_first(c) for c in order]))


def disposition(nth: Column, accepted: Column) -> Column:
    return F.when(nth <= accepted, "baseline").otherwise("new")


def active(entries: DataFrame, today: Column) -> DataFrame:
    return entries.where(~dates.is_expired(F.col("expires_at"), today))


def classify(found: DataFrame, entries: DataFrame, today: Column, order: tuple[str, ...] = ("from_file", "line", "to_file", "rule", "message"), legacy: str | None = None) -> DataFrame:
    """Adds disposition. Of a fingerprint's findings, in order, as many are baseline as it has active entries. ``legacy``
    names a column with an older fingerprint, used where the new one has no entry at all."""
    counts = active(entries, today).groupBy("fingerprint").agg(F.count("*").alias("accepted"))
    key = F.col("fingerprint")
    if legacy:
        has = counts.select("fingerprint", F.lit(True).alias("has"))
        found = found.join(has, "fingerprint", "left").withColumn("_key", F.when(F.col("has"), F.col("fingerprint")).otherwise(F.col(legacy))).drop("has")
        key = F.col("_key")
    nth = numbered(order, key)
    counts = counts.withColumnRenamed("fingerprint", "_entry")
    ranked = found.withColumn("_nth", nth).join(counts, key == F.col("_entry"), "left")
    named = ranked.withColumn("disposition", disposition(F.col("_nth"), F.coalesce("accepted", F.lit(0))))
    return named.drop("_nth", "_entry", "accepted", "_key")


def classify_own(found: DataFrame, accepted: Column, order: tuple[str, ...] = ("from_file", "line", "to_file", "rule", "message"), near: tuple[str, ...] = ()) -> DataFrame:
    """The same where entries were made of the findings themselves: ``accepted`` says of which there is an active one. Findings are read once.
    near: columns that are equal wherever fingerprints are; findings that lie by them already are not dealt out again."""
    group = W.partitionBy(*near, "fingerprint")
    ranked = found.withColumn("_nth", numbered(order, *near, "fingerprint")).withColumn("_accepted", F.count_if(accepted).over(group))
    return ranked.withColumn("disposition", disposition(F.col("_nth"), F.col("_accepted"))).drop("_nth", "_accepted")


def staleness(found: DataFrame, entries: DataFrame, today: Column) -> DataFrame:
    """One row: entries, expired, matched, stale (active entries that no finding used up)."""
    marked = entries.withColumn("expired", dates.is_expired(F.col("expires_at"), today))
    counts = marked.groupBy("fingerprint").agg(F.count_if(~F.col("expired")).alias("accepted"), F.count_if("expired").alias("expired"))
    there = found.groupBy("fingerprint").agg(F.count("*").alias("there"))
    return tally(counts.join(there, "fingerprint", "left"))


def staleness_own(found: DataFrame, there: Column, entry: Column, expired: Column, near: tuple[str, ...] = ()) -> DataFrame:
    """The same where entries were made of findings: ``entry`` says of which, ``there`` which findings there still are. near: see ``classify_own``."""
    return tally(found.groupBy(*near, "fingerprint").agg(F.count_if(entry & ~expired).alias("accepted"), F.count_if(entry & expired).alias("expired"), F.count_if(there).alias("there")))


def tally(counts: DataFrame) -> DataFrame:
    """The row of ``staleness`` from the counts of each fingerprint."""
    used = counts.select("accepted", "expired", F.least("accepted", F.coalesce("there", F.lit(0))).alias("matched"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return used.agg((zero("accepted") + zero("expired")).alias("entries"), zero("expired").alias("expired"), zero("matched").alias("matched"), (zero("accepted") - zero("matched")).alias("stale"))


def refresh(found: DataFrame, entries: DataFrame, order: tuple[str, ...] = ("from_file", "line", "to_file", "rule", "message")) -> DataFrame:
    """The findings as entries; owner, reason and expiry pass from the n-th entry of a fingerprint to its n-th finding."""
    old = entries.withColumn("n", numbered(("position",), "fingerprint")).select("fingerprint", "n", "owner", "reason", "expires_at", "added_at")
    return found.withColumn("n", numbered(order, "fingerprint")).join(old, ["fingerprint", "n"], "left").drop("n")


def refresh_own(found: DataFrame, entry: Column, passed: dict[str, Column], order: tuple[str, ...] = ("from_file", "line", "to_file", "rule", "message"), near: tuple[str, ...] = ()) -> DataFrame:
    """The same where entries were made of findings: ``entry`` says of which, and ``passed`` what they hold, ``position`` among it. A finding
    stands once for itself and once for its entry; both are numbered apart, and meet by their number. near: see ``classify_own``."""
    held = F.struct(*[c.alias(n) for n, c in passed.items()])
    rows = found.select("*", F.posexplode(F.array(F.when(F.lit(False), held), F.when(entry, held))).alias("_entry", "_held")).where("_entry = 0 or _held is not null")
    group, is_entry = (*near, "fingerprint"), F.col("_entry") == 1
    first = F.when(is_entry, F.col("_held.position"))
    nth = F.row_number().over(W.partitionBy(*group, "_entry").orderBy(F.asc_nulls_first(first), *[F.asc_nulls_first(c) for c in order]))
    given = F.max("_held").over(W.partitionBy(*group, "_nth"))
    met = rows.withColumn("_nth", nth).withColumn("_given", given).where("_entry = 0")
    return met.select(*found.columns, *[F.col(f"_given.{n}").alias(n) for n in passed if n != "position"])


def add(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries and those findings that none of them stands for yet (same fingerprint and line, null matching null)."""
    have = entries.select(F.col("fingerprint").alias("_f"), F.col("line").alias("_l"))
    new = found.join(have, (F.col("fingerprint") == F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")), "left_anti")
    return entries.unionByName(new, allowMissingColumns=True)


def audit(entries: DataFrame, today: Column) -> DataFrame:
    """One row of counts over all entries."""
    state = dates.expiry(F.col("expires_at"), today)
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return entries.withColumn("state", state).agg(
        F.count("*").alias("entries"), F.count_if(has("owner")).alias("with_owner"), F.count_if(has("reason")).alias("with_reason"), F.count_if(~(has("owner") & has("reason"))).alias("gaps"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("expired", "expiring", "active", "no_expiry")],
    )


def matching(found: DataFrame, **wanted: str | None) -> DataFrame:
    """The findings whose columns (rule, from_module, to_module, from_file, to_file) have the wanted values; what is None is not asked."""
    for name, value in wanted.items():
        if value is not None:
            found = found.where(F.col(name).eqNullSafe(value))
    return found


def listed(entries: DataFrame, today: Column, owner: str | None = None, rule: str | None = None, module: str | None = None, expired: bool = False, expires_within: int | None = None) -> DataFrame:
    """The entries that all given filters keep. expires_within: days; entries without a day, or past it, do not expire within any."""
    out = matching(entries, owner=owner, from_module=module)
    if rule is not None:
        out = out.where(rule_name(F.col("rule")) == rule_name(F.lit(rule)))
    if expired:
        out = out.where(dates.is_expired(F.col("expires_at"), today))
    if expires_within is not None:
        day = dates.iso_date(F.col("expires_at"))
        out = out.where((day >= today) & (day <= F.date_add(today, expires_within)))
    return out


def groups(entries: DataFrame, by: str) -> DataFrame:
    """(group, entries): how many entries each rule, owner or module (from_module) has; those without one are a group."""
    column = {"rule": "rule", "owner": "owner", "module": "from_module"}[by]
    return entries.groupBy(F.coalesce(tidy(F.col(column)), F.lit(f"<no {by}>")).alias("group")).agg(F.count("*").alias("entries"))


def tidy(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def by_owner(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("owner", F.lit("<no owner>")).alias("owner")).agg(F.count("*").alias("entries"))
