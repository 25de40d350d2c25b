"""Contracts between modules: their files, the sources they match and the calls that validate them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.operators import extract, ownership
from archsieve.operators.violations import union, violation


def finding(rows: DataFrame, rule: str, message, severity: str = "error", file="contract") -> DataFrame:
    return rows.withColumn("message", message).select(*violation(rule=F.lit(rule), severity=F.lit(severity), message=F.col("message"), from_file=F.col(file), from_module=F.col("module")))


def files_of(contracts: DataFrame, listing: DataFrame) -> DataFrame:
    """Contracts whose file is missing or empty. contracts: (module, id, contract, ...); listing: (path, length)."""
    joined = contracts.join(listing.select(F.col("path").alias("contract"), "length"), "contract", "left")
    missing = finding(joined.where("length is null"), "boundary.contract_missing", F.concat(F.lit("contract "), F.col("id"), F.lit(" has no file")))
    return missing.unionByName(finding(joined.where("length = 0"), "boundary.contract_empty", F.concat(F.lit("contract "), F.col("id"), F.lit(" has an empty file"))))


def matched(contracts: DataFrame, listing: DataFrame) -> DataFrame:
    """(module, id, path): the files that a contract's globs match."""
    rows = contracts.select("module", "id", F.explode("files").alias("glob"))
    found = ownership.glob_matches(listing, rows.select(F.concat_ws("\x00", "module", "id").alias("module"), "glob"))
    parts = F.split("module", "\x00")
    return found.select(parts[0].alias("module"), parts[1].alias("id"), "path").distinct()


def unresolved(contracts: DataFrame, found: DataFrame) -> DataFrame:
    """Contracts with globs of which none matches a file."""
    lost = contracts.where(F.size("files") > 0).join(found.select("module", "id").distinct(), ["module", "id"], "left_anti")
    return finding(lost, "boundary.match_unresolved", F.concat(F.lit("no file matches contract "), F.col("id")))


def references(contracts: DataFrame) -> DataFrame:
    """Contracts that refer to others (``module:id``) which nobody declares."""
    rows = contracts.select("module", F.col("id").alias("contract"), F.explode("imports_contract").alias("reference"))
    return finding(ownership.dangling_contracts(rows, contracts), "boundary.contract_ref_invalid", F.concat(F.lit("unknown: "), F.col("missing")))


def envelopes(contracts: DataFrame, found: DataFrame, sources: DataFrame, packages: tuple[str, ...], pattern: str) -> DataFrame:
    """Matched files of contracts with a required envelope that lack the import or the call. Only matched files are scanned."""
    needed = contracts.where("envelope = 'required'").join(found, ["module", "id"]).select("module", "id", F.col("pattern").alias("function"), "path")
    inside = needed.select("path", "function").distinct()
    seen = extract.calls(sources, packages, pattern, inside)
    named = needed.select("module", "id", "path", F.col("function").alias("_f"))
    hits = seen.where("has_import").select(F.col("path").alias("_p"), F.col("function").alias("_g"), F.col("contract_id").alias("_id")).distinct()
    lack = named.join(hits, (F.col("path") == F.col("_p")) & F.col("_f").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id")), "left_anti")
    return finding(lack, "boundary.envelope_missing", F.concat(F.lit("no validated call of contract "), F.col("id")), "warning", "path")


def evaluate(contracts: DataFrame, listing: DataFrame, sources: DataFrame, packages: tuple[str, ...] = (), pattern: str = "boundary.validate") -> DataFrame:
    found = matched(contracts, listing)
    parts = [files_of(contracts, listing), unresolved(contracts, found), references(contracts)]
    if packages:
        parts.append(envelopes(contracts, found, sources, packages, pattern))
    return union(*parts)


def shared_ids(contracts: DataFrame) -> DataFrame:
    """(contract, module, selected, publishers): modules that publish a contract under an id that other modules use too, one row each;
    selected: the least of them. contracts: (module, id). A module that repeats an id is one publisher."""
    rows = contracts.where("id <> ''").select(F.col("id").alias("contract"), "module").distinct()
    counts = rows.groupBy("contract").agg(F.min("module").alias("selected"), F.count("*").alias("publishers")).where("publishers > 1")
    return rows.join(counts, "contract").select("contract", "module", "selected", "publishers")


def consumers(contracts: DataFrame) -> DataFrame:
    """(reference, direction, envelope, module, contract): who refers to which contract, and how."""
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    return contracts.select(F.explode("imports_contract").alias("reference"), low("direction").alias("direction"), low("envelope").alias("envelope"), "module", F.col("id").alias("contract")).distinct()


def reference_classes(contracts: DataFrame) -> DataFrame:
    """(reference, direction, envelope, module, contract, members, against): the ways in which a reference is used, where there are
    several that contradict each other. One row a way: its least consumer stands for it, ``against`` names the other ways.
    References have a handful of ways, so they are the only rows that meet; members are counted, never paired."""
    ways = consumers(contracts).groupBy("reference", "direction", "envelope").agg(F.min(F.struct("module", "contract")).alias("first"), F.count("*").alias("members"))
    way = F.concat_ws("/", "direction", "envelope")
    every = F.array_sort(F.collect_list(way).over(W.partitionBy("reference")))
    torn = ways.withColumn("way", way).withColumn("against", every).where(F.size("against") > 1)
    return torn.select("reference", "direction", "envelope", "first.module", "first.contract", "members", F.array_remove("against", F.col("way")).alias("against"))


def reference_members(contracts: DataFrame) -> DataFrame:
    """(reference, module, contract, direction, envelope, first_module, first_contract): each consumer of a reference that is used in
    contradicting ways, with the one that stands for its way. As many rows as consumers."""
    first = reference_classes(contracts).select("reference", "direction", "envelope", F.col("module").alias("first_module"), F.col("contract").alias("first_contract"))
    return consumers(contracts).join(first, ["reference", "direction", "envelope"])


def conflicts(contracts: DataFrame) -> DataFrame:
    """(module, conflict, detail): shared ids and contradicting references, one row an id and one a way of a reference."""
    shared = shared_ids(contracts).where("module = selected").select("module", F.lit("contract id of several modules").alias("conflict"), F.concat("contract", F.lit(": "), F.col("publishers").cast("string"), F.lit(" modules")).alias("detail"))
    ways = reference_classes(contracts)
    told = F.concat("reference", F.lit(": "), F.concat_ws("/", "direction", "envelope"), F.lit(" by "), F.col("members").cast("string"), F.lit(" against "), F.array_join("against", ", "))
    return shared.unionByName(ways.select("module", F.lit("contradicting contract references").alias("conflict"), told.alias("detail")))
