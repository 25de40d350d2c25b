"""What is wrong with specs, as rows (module, level, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archsieve.functions import globs

VERSIONS = ("2.2", "2.3")
#: Rule ids that a constraint may name.
RULES = (
    "no-circular-deps", "enforce-layer", "enforce-category", "boundary.never_imports", "boundary.allow_imports_from", "boundary.public_api", "boundary.deny_imported_by", "boundary.allow_imported_by", "boundary.visibility.internal",
    "boundary.visibility.private", "boundary.canonical_import", "boundary.canonical_imports", "boundary.unique_export", "dependency.forbidden", "dependency.not_allowed",
)
LISTS = ("never_imports", "allow_imports_from", "allow_type_imports_from", "deny_imported_by", "allow_imported_by", "friend_modules")
EMPTY = "array<string>"


def bad_glob(pattern: Column) -> Column:
    """Braces and classes that are not closed, or closed before they are opened, and a backslash at the end."""
    left = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[[!^]?[^\]]+\]", "")
    for _ in range(4):  # pairs from the inside out
        left = F.regexp_replace(left, r"\{[^{}]*\}", "")
    return left.rlike(r"[{}\[]|\\$")


def issues(specs: DataFrame) -> DataFrame:
    """All issues of specs, each once."""
    b = F.col("boundaries")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def when(level: str, test: Column, message: Column) -> Column:
        return F.when(test, F.array(F.struct(F.lit(level).alias("level"), message.alias("message"))))

    def each(level: str, values: Column, test, message) -> Column:
        hit = F.filter(F.coalesce(values, F.array().cast(EMPTY)), test)
        return F.transform(hit, lambda v: F.struct(F.lit(level).alias("level"), message(v).alias("message")))

    contracts = F.coalesce(b["contracts"], F.filter(F.array(F.lit(None)), lambda _: F.lit(False)).cast("array<struct<id:string,contract:string,match:struct<files:array<string>,pattern:string>,direction:string,envelope:string,imports_contract:array<string>>>"))
    ids = F.transform(contracts, lambda c: c["id"])
    allow, never = F.coalesce(b["allow_imports_from"], F.array().cast(EMPTY)), F.coalesce(b["never_imports"], F.array().cast(EMPTY))
    meets = lambda a: F.exists(never, lambda n: globs.overlap(a, n) & (globs.literal_prefix(a) != "") & (globs.literal_prefix(n) != ""))
    parts = [
        when("error", ~F.col("version").isin(*VERSIONS), text("unsupported version ", F.col("version"))),
        when("error", (F.col("version") == "2.2") & (F.size(contracts) > 0), F.lit("contracts need version 2.3")),
        when("error", F.trim("module") == "", F.lit("module must not be empty")),
        each("error", F.transform("constraints", lambda c: c["rule"]), lambda r: ~r.isin(*RULES), lambda r: text("unknown rule ", r)),
        each("error", F.transform(F.filter("constraints", lambda c: c["rule"] == "no-circular-deps"), lambda c: F.coalesce(F.get_json_object(c["params"], "$.scope"), F.lit("both"))), lambda s: ~s.isin("internal", "external", "both"), lambda s: text("unknown scope ", s)),
        when("error", bad_glob(b["path"]), text("bad glob ", b["path"])),
        each("error", b["public_api"], bad_glob, lambda p: text("bad glob ", p)),
        *[each("warning", b[name], lambda p: p.rlike(r"[*?\[{]") & bad_glob(p), lambda p: text("bad glob ", p)) for name in LISTS],
        each("warning", allow, meets, lambda a: text("allowed and never imported: ", a)),
        each("warning", F.array_intersect(F.coalesce(b["allow_imported_by"], F.array().cast(EMPTY)), F.coalesce(b["deny_imported_by"], F.array().cast(EMPTY))), lambda _: F.lit(True), lambda x: text("allowed and denied importer: ", x)),
        each("error", ids, lambda i: F.coalesce(F.trim(i), F.lit("")) == "", lambda _: F.lit("a contract needs an id")),
        when("error", F.size(F.array_distinct(ids)) < F.size(ids), F.lit("contract ids repeat")),
        each("error", F.transform(contracts, lambda c: c["contract"]), lambda p: F.startswith(p, F.lit("/")) | p.rlike(r"(^|/)\.\.(/|$)") | (F.trim(p) == ""), lambda p: text("contract must lie inside the project: ", p)),
        each("error", F.flatten(F.transform(contracts, lambda c: c["match"]["files"])), bad_glob, lambda p: text("bad glob ", p)),
        each("error", F.flatten(F.transform(contracts, lambda c: c["imports_contract"])), lambda r: ~r.rlike("^[^:]+:[^:]+$"), lambda r: text("not module:contract: ", r)),
    ]
    found = F.flatten(F.filter(F.array(*[F.coalesce(p, F.array().cast("array<struct<level:string,message:string>>")) for p in parts]), lambda x: F.size(x) > 0))
    rows = specs.select("module", "spec_path", F.explode(found).alias("x")).select("module", "spec_path", "x.level", "x.message")
    return rows.unionByName(repeated(specs)).distinct()


def repeated(specs: DataFrame) -> DataFrame:
    """Modules and import ids that more than one spec declares; the first by path has them."""
    before = F.lag("spec_path").over(W.partitionBy("module").orderBy("spec_path"))
    again = specs.select("module", "spec_path").withColumn("before", before).where("before is not null")
    modules = again.select("module", "spec_path", F.lit("error").alias("level"), F.concat(F.lit("module is declared in "), F.col("before")).alias("message"))
    ids = specs.select("module", "spec_path", F.explode(F.array_distinct(F.filter(F.concat(F.array("import_id"), "import_ids"), lambda i: F.coalesce(F.trim(i), F.lit("")) != ""))).alias("id"))
    first = F.first("module").over(W.partitionBy("id").orderBy("module", "spec_path"))
    taken = ids.withColumn("owner", first).where("owner <> module")
    return modules.unionByName(taken.select("module", "spec_path", F.lit("error").alias("level"), F.concat(F.lit("import id "), "id", F.lit(" belongs to "), "owner").alias("message")))
