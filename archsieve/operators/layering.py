"""Layers, categories, unique exports and cycles of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archsieve.functions import hashing, names
from archsieve.operators.violations import violation


def layer_inversions(edges: DataFrame, layers: list[str]) -> DataFrame:
    """Edges from a later to an earlier layer. A module's layer is its first segment. Type-only and ignored edges count."""
    if not layers or len(set(layers)) != len(layers):
        raise ValueError("layers must be different and at least one")
    place = F.create_map(*[x for i, layer in enumerate(layers) for x in (F.lit(layer), F.lit(i))])
    a, b = (place[names.first_segment(F.col(c))] for c in ("from_module", "to_module"))
    hit = edges.where(b < a).withColumn("message", F.concat(names.first_segment(F.col("from_module")), F.lit(" must not use "), names.first_segment(F.col("to_module"))))
    return hit.select(*violation(rule=F.lit("enforce-layer"), severity=F.lit("error"), **{c: F.col(c) for c in ("message", "from_file", "to_file", "from_module", "to_module", "line")}))


def declared(rules: DataFrame, rule: str, field: str, named: str | None = None) -> DataFrame:
    """(module, title, names, fault) of a rule's different declarations: the list of names that its parameters hold, trimmed, and what is wrong
    with it. rules: (module, rule, params); named: a field that must be a text that is not blank, the title."""
    v = F.col("v")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    names_ = F.transform(F.coalesce(F.try_variant_get(v, f"$.{field}", "array<string>"), F.array().cast("array<string>")), lambda n: F.trim(n))
    title = F.trim(F.try_variant_get(v, f"$.{named}", "string")) if named else F.lit("")
    rows = rules.where(F.col("rule") == rule).select("module", "params").distinct().withColumn("v", hashing.parsed_json(F.col("params")))
    fault = F.when(~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<")), F.lit(False)), "parameters are not an object")
    if named:
        fault = fault.when(~F.coalesce(kind(named) == "STRING", F.lit(False)), f"{named} must be a text").when(title == "", f"{named} is blank")
    fault = (
        fault.when(~F.coalesce(F.startswith(kind(field), F.lit("ARRAY<")), F.lit(False)), f"{field} must be a list").when(kind(field) == "ARRAY<VOID>", F.when(F.size(names_) > 0, f"{field} must hold texts alone").otherwise(f"{field} is empty"))
        .when((kind(field) != "ARRAY<STRING>") | F.exists(names_, lambda n: n.isNull()), f"{field} must hold texts alone").when(F.exists(names_, lambda n: n == ""), f"{field} holds a blank name")
        .when(F.size(F.array_distinct(names_)) < F.size(names_), f"{field} holds a name twice")
    )
    return rows.select("module", title.alias("title"), names_.alias("names"), fault.alias("fault"))


def canonical(found: DataFrame) -> DataFrame:
    """(module, title, names): the declaration that counts, the first sound one by module, title and names; one row, or none."""
    return found.where("fault is null").orderBy("module", "title", "names").limit(1).select("module", "title", "names")


def declaration_faults(found: DataFrame, rule: str) -> DataFrame:
    """(rule, module, message): declarations that cannot be used, and those that differ from the one that counts."""
    wrong = found.where("fault is not null").select("module", F.col("fault").alias("message"))
    first = canonical(found).select(F.col("module").alias("_module"), F.struct("title", "names").alias("_first"))
    others = found.where("fault is null").crossJoin(F.broadcast(first)).where(F.struct("title", "names") != F.col("_first"))  # one row
    told = others.select("module", F.concat(F.lit("differs from the declaration of "), "_module", F.lit(", which counts: "), F.array_join("names", ", ")).alias("message"))
    return wrong.unionByName(told).distinct().select(F.lit(rule).alias("rule"), "module", "message")


def unknown_layers(modules: DataFrame, layers: list[str]) -> DataFrame:
    """Modules whose layer is none of the list: a fault of the configuration. A module without a layer is none."""
    layer = names.first_segment(F.col("module"))
    return modules.select("module").distinct().where(layer.isNotNull() & ~layer.isin(*layers))


def category_mixing(edges: DataFrame, members: list[str]) -> DataFrame:
    """Edges between two different members of a category."""
    a, b = names.first_segment(F.col("from_module")), names.first_segment(F.col("to_module"))
    hit = edges.where(a.isin(*members) & b.isin(*members) & (a != b)).withColumn("message", F.concat(a, F.lit(" and "), b, F.lit(" are apart")))
    return hit.select(*violation(rule=F.lit("enforce-category"), severity=F.lit("error"), **{c: F.col(c) for c in ("message", "from_file", "to_file", "from_module", "to_module", "line")}))


def repeated_exports(exports: DataFrame) -> DataFrame:
    """(module, name, n_files, files): names that more than one file of a module exports. exports: (module, name, path, is_default)."""
    named = exports.where("not is_default and name <> '*'").select("module", "name", "path").distinct()
    return named.groupBy("module", "name").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("path")).alias("files")).where("n_files > 1")


def circular(cycles: DataFrame, constraints: DataFrame) -> DataFrame:
    """Findings for each declaring module and each cycle in its scope. cycles: (component, members, n_modules);
    constraints: (module, scope, severity)."""
    kind = F.when(F.col("n_modules") == 1, "internal").when(F.col("n_modules") > 1, "external").otherwise("unscoped")
    declared = constraints.select("module", "scope", "severity").distinct()
    # one row for each declaring module and cycle is the result asked for: an equality on the scopes that a cycle falls under
    scopes = cycles.withColumn("scope", F.explode(F.array(kind, F.lit("both"))))
    hit = scopes.join(declared, "scope").withColumn("message", F.concat(F.lit("cycle: "), F.col("members")))
    return hit.select(*violation(rule=F.lit("no-circular-deps"), severity=F.col("severity"), message=F.col("message"), from_module=F.col("module"), from_file=F.col("component"))).distinct()
