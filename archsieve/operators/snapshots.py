"""Differences of two snapshots of policy: what widens, what narrows, and what offsets what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDENING, NARROWING, STRUCTURAL = "widening", "narrowing", "structural"
#: What adding to and removing from each set-valued field means.
SETS = {
    "public_api": (WIDENING, NARROWING), "allow_imports_from": (WIDENING, NARROWING), "allow_type_imports_from": (WIDENING, NARROWING), "friend_modules": (WIDENING, NARROWING), "allowed_dependencies": (WIDENING, NARROWING),
    "allow_imported_by": (WIDENING, NARROWING), "never_imports": (NARROWING, WIDENING), "deny_imported_by": (NARROWING, WIDENING), "forbidden_dependencies": (NARROWING, WIDENING), "exclude": (WIDENING, NARROWING), "spec_dirs": (NARROWING, WIDENING),
    "match_files": (NARROWING, WIDENING),
}
#: Fields of which true is stricter.
FLAGS = ("enforce_canonical_imports", "enforce_in_tests", "strict_ownership", "enforce_type_only_imports", "require_expiry", "envelope_enabled")
#: Ranks of ordered fields; the lower rank is the wider.
RANKS = {
    "visibility": ("public", "internal", "private"), "severity": ("warning", "error"), "envelope": ("optional", "required"), "jest_mock_mode": ("warn", "enforce"), "stale_baseline": ("warn", "fail"),
    "unresolved_edge_policy": ("ignore", "warn", "error"), "strict_ownership_level": ("errors", "warnings"),
}
CHANGE = ("field", "classification", "detail", "signature")
ONE_CHANGE = "struct<field:string,classification:string,detail:string,signature:string>"


def change(field: str, classification: Column | str, detail: Column, signature: Column | None = None) -> Column:
    """signature: what the change is about, whichever way it goes: the opposite change of another module has the same one. Null: nothing
    is its opposite."""
    kind = F.lit(classification) if isinstance(classification, str) else classification
    signature = F.lit(None) if signature is None else signature
    return F.struct(F.lit(field).alias("field"), kind.alias("classification"), detail.alias("detail"), signature.cast("string").alias("signature"))


def of_values(strict: Column, wide: Column) -> Column:
    """The signature of two values, the stricter one first."""
    return F.to_json(F.array(strict.cast("string"), wide.cast("string")))


def of_sets(*parts: Column) -> Column:
    """The signature of a set: all values that one side has and the other lacks."""
    return F.to_json(F.struct(F.array_sort(F.array_union(*parts)).alias("differing")))


def set_changes(field: str, before: Column, after: Column, name: str | None = None) -> Column:
    """An array of changes: added and removed values. Null and [] differ for allow_imports_from (null: anything goes)
    and for allow_imported_by an empty list means anyone."""
    added, removed = SETS[field]
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(before, empty), F.coalesce(after, empty)
    plus, minus = F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))
    text = lambda x: F.array_join(x, ",")
    name, both = name or field, of_sets(plus, minus)
    usual = [F.when(F.size(plus) > 0, change(name, added, F.concat(F.lit("+"), text(plus)), both)), F.when(F.size(minus) > 0, change(name, removed, F.concat(F.lit("-"), text(minus)), both))]
    none = F.lit(None).cast(ONE_CHANGE)
    if field == "allow_imports_from":
        opened, closed = before.isNotNull() & after.isNull(), before.isNull() & after.isNotNull()
    elif field == "allow_imported_by":
        opened, closed = (F.size(a) > 0) & (F.size(b) == 0), (F.size(a) == 0) & (F.size(b) > 0)
    else:
        return F.array(*usual)
    limited = of_values(F.to_json(F.array_sort(F.coalesce(before, after))), F.lit(None)) if field == "allow_imports_from" else both
    whole = F.when(opened, change(field, WIDENING, F.lit("unrestricted"), limited)).when(closed, change(field, NARROWING, F.lit("restricted"), limited))
    return F.array(whole, *[F.when(opened | closed, none).otherwise(u) for u in usual])


def flag_change(field: str, before: Column, after: Column) -> Column:
    a, b = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    values = of_values(F.lit("true"), F.lit("false"))
    return F.when(a & ~b, change(field, WIDENING, F.lit("true -> false"), values)).when(~a & b, change(field, NARROWING, F.lit("false -> true"), values))


def rank_change(field: str, before: Column, after: Column, name: str | None = None) -> Column:
    levels = RANKS[field]
    rank = F.create_map(*[x for i, name in enumerate(levels) for x in (F.lit(name), F.lit(i))])
    detail, name = F.concat(before, F.lit(" -> "), after), name or field
    return F.when(rank[after] < rank[before], change(name, WIDENING, detail, of_values(before, after))).when(rank[after] > rank[before], change(name, NARROWING, detail, of_values(after, before)))


def limit_change(field: str, before: Column, after: Column) -> Column:
    """A limit: none is no limit; a higher one widens."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    most = F.lit(2**62)
    a, b = F.coalesce(before.cast("long"), most), F.coalesce(after.cast("long"), most)
    detail = F.concat(text(before), F.lit(" -> "), text(after))
    return F.when(b > a, change(field, WIDENING, detail, of_values(before, after))).when(b < a, change(field, NARROWING, detail, of_values(after, before)))


def structural_change(field: str, before: Column, after: Column) -> Column:
    return F.when(~before.eqNullSafe(after), change(field, STRUCTURAL, F.concat(F.coalesce(before.cast("string"), F.lit("none")), F.lit(" -> "), F.coalesce(after.cast("string"), F.lit("none")))))


def diff(base: DataFrame, head: DataFrame, key: str = "module", structural: tuple[str, ...] = (), limits: tuple[str, ...] = ()) -> DataFrame:
    """(key, field, classification, detail, signature): all changes between two snapshots with a row a key. A new key is structural, a
    removed one widens; fields are compared by what they are."""
    fields = [c for c in base.columns if c != key]
    joined = base.select(F.col(key).alias("_k"), F.struct(*fields).alias("base")).join(head.select(F.col(key).alias("_h"), F.struct(*fields).alias("head")), F.col("_k") == F.col("_h"), "full_outer")
    parts: list[Column] = []
    for f in fields:
        a, b = F.col(f"base.{f}"), F.col(f"head.{f}")
        if f in SETS:
            parts.append(set_changes(f, a, b))
        elif f in FLAGS:
            parts.append(F.array(flag_change(f, a, b)))
        elif f in RANKS:
            parts.append(F.array(rank_change(f, a, b)))
        elif f in limits:
            parts.append(F.array(limit_change(f, a, b)))
        elif f in structural:
            parts.append(F.array(structural_change(f, a, b)))
    changes = F.when(F.col("base").isNull(), F.array(change("spec", STRUCTURAL, F.lit("added")))).when(F.col("head").isNull(), F.array(change("spec", WIDENING, F.lit("removed")))).otherwise(F.concat(*parts))
    rows = joined.select(F.coalesce("_k", "_h").alias(key), F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("x"))
    return rows.select(key, *[f"x.{c}" for c in CHANGE])


def last(rows: DataFrame, keys: tuple[str, ...], place: str = "place") -> DataFrame:
    """One row a key: where a key repeats in a list, the last of them."""
    rest = [c for c in rows.columns if c not in (*keys, place)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def listed_changes(base: DataFrame, head: DataFrame, keys: tuple[str, str], parts: list[Column], gone: Column, new: Column) -> DataFrame:
    """(module, field, subject, classification, detail, signature): changes of rows that two snapshots list a module. parts: arrays of changes of
    the structs ``a`` and ``b``."""
    side = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    joined = side(base, "a").join(side(head, "b"), list(keys), "full_outer")
    changes = F.when(F.col("b").isNull(), F.array(gone)).when(F.col("a").isNull(), F.array(new)).otherwise(F.concat(*parts))
    rows = joined.select(*keys, F.explode(F.filter(changes, lambda x: x.isNotNull())).alias("x"))
    return rows.select(keys[0], "x.field", F.col(keys[1]).alias("subject"), "x.classification", "x.detail", "x.signature")


def tidy(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def constraint_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(module, field, subject, classification, detail, signature) of constraints (module, place, rule, params, severity, message); the subject is
    ``rule::params``. A milder severity widens, a stricter one narrows; all else is structural."""
    keyed = lambda df: last(df.select("module", F.concat_ws("::", F.trim("rule"), "params").alias("subject"), "place", "severity", tidy(F.col("message")).alias("message")), ("module", "subject"))
    parts = [F.array(rank_change("severity", F.col("a.severity"), F.col("b.severity"), "constraints.severity"), structural_change("constraints.message", F.col("a.message"), F.col("b.message")))]
    return listed_changes(keyed(base), keyed(head), ("module", "subject"), parts, change("constraints", STRUCTURAL, F.lit("removed")), change("constraints", STRUCTURAL, F.lit("added")))


def contract_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(module, field, subject, classification, detail, signature) of contracts (module, place, id, contract, files, pattern, direction, envelope,
    imports_contract); the subject is the id. A new contract narrows, a removed one widens; more matched files and a required
    envelope narrow; a first pattern widens, for it matches less."""
    names = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    keyed = lambda df: last(df.select("module", F.trim("id").alias("subject"), "place", F.trim("contract").alias("contract"), names("files").alias("files"), tidy(F.col("pattern")).alias("pattern"), "direction", "envelope", names("imports_contract").alias("refs")), ("module", "subject"))
    before, after = F.col("a.pattern"), F.col("b.pattern")
    text = lambda c: F.coalesce(c, F.lit("none"))
    kind = F.when(before.isNull(), WIDENING).when(after.isNull(), NARROWING).otherwise(STRUCTURAL)
    pattern = F.when(~before.eqNullSafe(after), change("contracts.match.pattern", kind, F.concat(text(before), F.lit(" -> "), text(after)), F.when(after.isNull(), of_values(after, before)).otherwise(of_values(before, after))))
    parts = [
        F.array(rank_change("envelope", F.col("a.envelope"), F.col("b.envelope"), "contracts.envelope"), pattern), set_changes("match_files", F.col("a.files"), F.col("b.files"), "contracts.match.files"),
        F.array(*[structural_change(f"contracts.{n}", F.col(f"a.{c}"), F.col(f"b.{c}")) for n, c in (("contract", "contract"), ("direction", "direction"))], structural_change("contracts.imports_contract", F.array_join("a.refs", ","), F.array_join("b.refs", ","))),
    ]
    return listed_changes(keyed(base), keyed(head), ("module", "subject"), parts, change("contracts", WIDENING, F.lit("removed")), change("contracts", NARROWING, F.lit("added")))


def file_changes(operations: DataFrame, pairing: DataFrame) -> DataFrame:
    """(module, field, subject, classification, detail, signature) of spec files that were deleted, renamed or copied: fail closed. operations:
    (status, from_path, to_path); pairing: (from_path, to_path, result) as ``renamed`` gives it. The module is guessed from the path."""
    hint = F.regexp_replace(F.regexp_extract("to_path", "([^/]*)$", 1), r"\.spec\.yml$", "")
    joined = operations.where(F.col("status").isin("D", "R", "C")).join(pairing.select("from_path", "to_path", "result"), ["from_path", "to_path"], "left")
    kind = F.when((F.col("status") != "D") & (F.col("result") == "equivalent"), STRUCTURAL).otherwise(WIDENING)
    detail = F.when(F.col("status") == "D", "deleted").otherwise(F.concat("from_path", F.lit(" -> "), "to_path", F.lit(": "), F.coalesce("result", F.lit("inconclusive"))))
    return joined.select(hint.alias("module"), F.lit("spec_file").alias("field"), F.col("to_path").alias("subject"), kind.alias("classification"), detail.alias("detail"), F.lit(None).cast("string").alias("signature"))


def path_coverage(base: DataFrame, head: DataFrame, key: str = "module") -> DataFrame:
    """(key, classification): how the set of files that a path pattern covers has changed. base, head: (key, path), distinct.
    More files widen, fewer narrow, both are structural."""
    a, b = base.withColumn("before", F.lit(True)), head.withColumn("after", F.lit(True))
    counts = a.join(b, [key, "path"], "full_outer").groupBy(key).agg(F.count_if(F.col("before").isNull()).alias("plus"), F.count_if(F.col("after").isNull()).alias("minus"))
    kind = F.when((F.col("plus") > 0) & (F.col("minus") > 0), STRUCTURAL).when(F.col("plus") > 0, WIDENING).when(F.col("minus") > 0, NARROWING)
    return counts.select(key, kind.alias("classification"), "plus", "minus").where("classification is not null")


def summary(changes: DataFrame, key: str = "module") -> DataFrame:
    """One row: changes by class, how many keys changed, and the net class."""
    count = lambda c: F.count_if(F.col("classification") == c)
    out = changes.agg(count(WIDENING).alias("widenings"), count(NARROWING).alias("narrowings"), count(STRUCTURAL).alias("structurals"), F.count_distinct(key).alias("changed"))
    return out.withColumn("net", net(F.col("widenings"), F.col("narrowings")))


def net(widenings: Column, narrowings: Column) -> Column:
    return F.when(widenings > 0, WIDENING).when(narrowings > 0, NARROWING).otherwise(STRUCTURAL)


def compensations(changes: DataFrame, adjacent: DataFrame, key: str = "module") -> DataFrame:
    """(widened, narrowed, field, signature, result): widenings that a narrowing of the same field and signature in an adjacent module
    makes good. changes: as ``diff`` gives them, and a subject where there is one. adjacent: (a, b), in either direction.

    A narrowing that fits one widening offsets it, one that fits several is ambiguous with all of them; and where several offset
    widenings of one module and field, all that touch these are ambiguous. Signatures and neighbours are one join key, so no
    change meets those of modules that are not adjacent."""
    subject = F.coalesce("subject", F.lit("")) if "subject" in changes.columns else F.lit("")
    own = F.when(F.startswith("field", F.lit("constraints")), F.concat_ws("\x00", subject, "signature")).otherwise(F.col("signature"))
    told = changes.where("signature is not null").select(F.col(key).alias("key"), "field", "classification", subject.alias("subject"), "detail", "signature", own.alias("what"))
    of = lambda kind, name: told.where(F.col("classification") == kind).select(F.col("key").alias(name), "field", "what", "signature", F.struct("subject", "detail").alias(f"{name}_change"))
    ways = adjacent.select(F.col("a").alias("widened"), F.col("b").alias("narrowed")).unionByName(adjacent.select(F.col("b").alias("widened"), F.col("a").alias("narrowed"))).where("widened <> narrowed").distinct()
    near = of(WIDENING, "widened").join(ways, "widened")
    pairs = near.join(of(NARROWING, "narrowed").drop("signature"), ["narrowed", "field", "what"])
    fits = F.count("*").over(W.partitionBy("narrowed", "field", "what", "narrowed_change"))
    offsets = F.count_if(F.col("fits") == 1).over(W.partitionBy("widened", "field"))
    ambiguous = (F.col("fits") > 1) | (F.col("offsets") > 1)
    return pairs.withColumn("fits", fits).withColumn("offsets", offsets).select("widened", "narrowed", "field", "signature", F.when(ambiguous, "ambiguous").otherwise("offset").alias("result"))


def offset(changes: DataFrame, candidates: DataFrame, key: str = "module") -> DataFrame:
    """The changes without the widenings that an offset makes good."""
    done = candidates.where("result = 'offset'").select(F.col("widened").alias(key), "field", F.lit(WIDENING).alias("classification")).distinct()
    return changes.join(done, [key, "field", "classification"], "left_anti")


def edge_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(a, b, side): edges that one of two sets lacks."""
    a, b = ours.select("a", "b"), theirs.select("a", "b")
    return a.subtract(b).withColumn("side", F.lit("ours")).unionByName(b.subtract(a).withColumn("side", F.lit("theirs")))


def renamed(base: DataFrame, head: DataFrame, pairs: DataFrame, key: str = "module") -> DataFrame:
    """(from_key, to_key, result): whether renamed specs are the same apart from their place. pairs: (from_key, to_key)."""
    fields = [c for c in base.columns if c != key]
    content = lambda df, name: df.select(F.col(key).alias(name), F.sha2(F.to_json(F.struct(*fields)), 256).alias(f"{name}_content"))
    joined = pairs.join(content(base, "from_key"), "from_key", "left").join(content(head, "to_key"), "to_key", "left")
    same = F.col("from_key_content") == F.col("to_key_content")
    return joined.select("from_key", "to_key", F.when(same, "equivalent").when(~same, "different").otherwise("inconclusive").alias("result"))
