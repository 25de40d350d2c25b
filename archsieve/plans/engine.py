"""The engine over a project's sources: check, validate, baseline, doctor and policy differences.

``Project`` reads a source tree into tables once; every verb is a composition of operators over them and gives DataFrames.
"""

from __future__ import annotations

import functools
import os
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archsieve.functions import globs, hashing, paths
from archsieve.operators import baselines, boundary, contracts, entry_points, extract, graphs, layering, ownership, packages, parity, reports, resolve, snapshots, validate, violations
from archsieve.sources import project as sources

PASS, VIOLATIONS, FAULT, MISMATCH = 0, 1, 2, 3


class ProjectError(ValueError):
    """A project whose specs or configuration cannot be used."""


@dataclass
class Verdict:
    violations: DataFrame
    summary: DataFrame

    def exit_code(self) -> int:
        return PASS if self.summary.first()["status"] == "pass" else VIOLATIONS


class Project:
    def __init__(self, spark: SparkSession, root: str, settings: sources.Config | None = None, packages_installed: DataFrame | None = None, keyword: str = "@archsieve-ignore", config_file: str = "archsieve.config.yml"):
        """settings: read from the root's configuration file unless given; packages_installed: looked for below node_modules unless given."""
        self.spark, self.root, self.keyword, self.config_file = spark, root, keyword, config_file
        spark.catalog.refreshByPath(root)  # tables that an earlier project of the session cached may be of an older tree
        self.settings = settings or sources.project_config(spark, root, config_file)
        self._installed = packages_installed

    @cached_property
    def files(self) -> DataFrame:
        return sources.source_files(self.spark, self.root, self.settings).persist()

    def warnings(self) -> DataFrame:
        """(path, warning): entries of the tree that could not be read."""
        return sources.discovery_warnings(self.spark, self.root, self.settings)

    @cached_property
    def installed(self) -> DataFrame:
        return (sources.installed(self.spark, self.root) if self._installed is None else self._installed).persist()

    @cached_property
    def aliases(self) -> DataFrame:
        """Aliases of the compiler configurations of the tree."""
        found = sources.texts(self.spark, self.root, self.settings.tsconfig_filename.removesuffix(".json") + "*.json")
        there = sources.aliases(found.where(~paths.skipped(F.col("path"), self.settings.include_dirs)), self.settings.tsconfig_filename)
        return graphs.checkpointed(there)

    @cached_property
    def entries(self) -> DataFrame:
        """Entry points of the tree's own packages and of those right below its node_modules."""
        found = sources.texts(self.spark, self.root, "package.json")
        at = F.regexp_replace("path", r"(^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json$", "$1package.json")
        return graphs.checkpointed(entry_points.entries(found.where(~paths.skipped(at, self.settings.include_dirs))))

    @cached_property
    def listing(self) -> DataFrame:
        return sources.listing(self.spark, self.root)

    @cached_property
    def specs(self) -> DataFrame:
        found, errors = sources.specs(self.spark, self.root, self.settings)
        if bad := errors.orderBy("spec_path").take(20):
            raise ProjectError("; ".join(f"{r.spec_path}: {r.error}" for r in bad))
        return found.persist()

    @cached_property
    def boundaries(self) -> DataFrame:
        """Specs as the boundary operators take them."""
        b = self.specs.select("module", F.coalesce("boundaries", F.from_json(F.lit('{"public_api":[],"never_imports":[],"allow_type_imports_from":[],"visibility":"public","allow_imported_by":[],"deny_imported_by":[],"friend_modules":[],"allowed_dependencies":[],"forbidden_dependencies":[],"contracts":[],"enforce_canonical_imports":false,"enforce_in_tests":false}'), sources.BOUNDARIES)).alias("b"))
        return b.select("module", "b.*")

    @cached_property
    def owners(self) -> DataFrame:
        """(module, glob); modules without a path own the directory of their name."""
        return self.specs.select("module", F.coalesce("boundaries.path", F.concat("module", F.lit("/**/*"))).alias("glob"))

    @cached_property
    def owned(self) -> DataFrame:
        """(path, module, is_test)."""
        return self.files.select("path", "is_test").join(ownership.module_map(self.files, self.owners).select("path", "module"), "path", "left")

    @cached_property
    def rows(self) -> DataFrame:
        return extract.imports(self.files, self.keyword).persist()

    @cached_property
    def resolved(self) -> DataFrame:
        """Each request with its directory, resolution and the module of its file."""
        wanted = extract.requests(self.rows, self.settings.jest_mock_mode == "enforce").withColumnRenamed("kind", "edge_kind").withColumn("directory", F.regexp_extract("from_file", "^(.*)/[^/]*$", 1))
        own = self.owned.select(F.col("path").alias("from_file"), F.col("module").alias("from_module"), F.col("is_test").alias("from_test"))
        return graphs.checkpointed(resolve.resolve(wanted, self.files, self.installed, self.aliases, self.entries).join(own, "from_file"))

    @cached_property
    def edges(self) -> DataFrame:
        own = self.owned.select(F.col("path").alias("to_file"), F.col("module").alias("to_module"), F.col("is_test").alias("to_test"))
        first = self.resolved.where(F.col("kind") == resolve.FIRST).withColumnRenamed("target", "to_file").join(own, "to_file")
        return first.select("from_file", "to_file", "from_module", "to_module", "from_test", "to_test", "specifier", "line", F.col("edge_kind").alias("kind"), "type_only", "ignored")

    @cached_property
    def unresolved(self) -> DataFrame:
        return self.resolved.where(F.col("kind") == resolve.NONE).where("not ignored")

    def exports(self) -> DataFrame:
        e = self.rows.where("kind = 'export'").select("path", "name", "is_default")
        return e.join(self.owned.select("path", "module"), "path").where("module is not null")

    def deep_overrides(self) -> DataFrame:
        """(module, place, pattern, max_depth, allow): what modules say of deep imports themselves."""
        return sources.listed(self.specs, "boundaries.import_hygiene.deny_deep_imports")

    def cycles(self) -> DataFrame:
        pairs = self.edges.select(F.col("from_file").alias("a"), F.col("to_file").alias("b"))
        return graphs.cycles(graphs.components(pairs), self.owned.select(F.col("path").alias("node"), "module"))

    @staticmethod
    def declarations(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What specs declare of layers and of categories."""
        return layering.declared(rules, "enforce-layer", "layers"), layering.declared(rules, "enforce-category", "members", "category")

    def rule_faults(self) -> DataFrame:
        """(rule, module, message): parameters of layers and categories that cannot be used or contradict those that count, and modules
        whose layer is not in the list."""
        layers, members = self.declarations(sources.rules_of(self.specs))
        out = layering.declaration_faults(layers, "enforce-layer").unionByName(layering.declaration_faults(members, "enforce-category"))
        if first := layering.canonical(layers).first():
            unknown = layering.unknown_layers(self.specs, first.names)
            out = out.unionByName(unknown.select(F.lit("enforce-layer").alias("rule"), "module", F.concat(F.lit("its layer is none of "), F.lit(", ".join(first.names))).alias("message")))
        return out

    def edges_of(self, path: str) -> DataFrame:
        """The imports of one file, in order."""
        return self.edges.where(F.col("from_file") == path).orderBy("to_file", "kind", "specifier", "line")

    def files_of(self, module: str) -> DataFrame:
        """(path): the files of a module, in order."""
        return self.owned.where(F.col("module") == module).select("path").orderBy(paths.sort_key(F.col("path")))

    def verdict_edges(self) -> DataFrame:
        """(from_module, to_module, edge_type, import_path, file, line): imports with a target that are not of types alone, and those
        without one that nobody ignores, with how these count; in order."""
        first = self.edges.where("kind <> 'type-only'").select("from_module", "to_module", F.lit("resolved").alias("edge_type"), F.col("specifier").alias("import_path"), F.col("from_file").alias("file"), "line")
        own = self.owned.select(F.col("path").alias("file"), F.col("module").alias("from_module"))
        rest = self.lost().withColumnRenamed("from_file", "file").join(own, "file", "left").select("from_module", F.lit(None).cast("string").alias("to_module"), F.col("kind").alias("edge_type"), F.col("specifier").alias("import_path"), "file", "line")
        order = ("file", "line", "import_path", "edge_type", "from_module", "to_module")
        return first.unionByName(rest).orderBy(*[F.asc_nulls_first(c) for c in order])

    def findings(self) -> DataFrame:
        """All findings of all rules, with their severities."""
        rules = sources.rules_of(self.specs).persist()
        crossing = self.edges.where("from_module is not null and to_module is not null")
        parts = [boundary.evaluate(crossing, self.boundaries, self.settings.enforce_type_only_imports)]
        third = self.resolved.where(F.col("kind") == resolve.THIRD).where("from_module is not null and not ignored")
        used = packages.usage(third.select("from_file", "from_module", "from_test", "specifier", "type_only"))
        policies = self.boundaries.select("module", F.col("forbidden_dependencies").alias("forbidden"), F.col("allowed_dependencies").alias("allowed"), "enforce_in_tests")
        parts.append(packages.package_policy(used, policies))
        deep = [(e["pattern"], e.get("max_depth", 0), e.get("severity", "warning")) for e in self.settings.import_hygiene.get("deny_deep_imports", [])]
        parts.append(packages.deep_imports(packages.usage(self.resolved.where(F.col("kind") != resolve.FIRST).select("from_file", "from_module", "from_test", "specifier", "type_only")), deep, self.deep_overrides()))
        test_rule = self.settings.import_hygiene.get("test_boundary") or {}
        usual = (test_rule.get("mode") or "production_only") if test_rule.get("enabled") else "off"
        modes = packages.test_modes(self.specs, usual)
        if usual != "off" or not modes.where("mode <> 'off'").isEmpty():
            of_mode = self.edges if usual != "off" else self.edges.where("from_module is not null")
            parts.append(packages.test_boundary(of_mode, boundary.hidden_files(crossing, self.boundaries), usual == "bidirectional", modes))
        circular = rules.where("rule = 'no-circular-deps'").select("module", F.coalesce(F.get_json_object("params", "$.scope"), F.lit("both")).alias("scope"), "severity")
        if not circular.isEmpty():
            parts.append(layering.circular(self.cycles(), circular))
        layers, members = (layering.canonical(d).first() for d in self.declarations(rules))
        if layers:
            parts.append(layering.layer_inversions(crossing, layers.names))
        if members:
            parts.append(layering.category_mixing(crossing, members.names))
        if not rules.where("rule = 'boundary.unique_export'").isEmpty():
            only = rules.where("rule = 'boundary.unique_export'").select("module").distinct()
            twice = layering.repeated_exports(self.exports().join(only, "module", "left_semi"))
            parts.append(twice.select(*violations.violation(rule=F.lit("boundary.unique_export"), severity=F.lit("error"), message=F.concat(F.col("name"), F.lit(" is exported by "), F.array_join("files", ", ")), from_file=F.col("files")[0], to_module=F.col("module"))))
        agreed = sources.contracts_of(self.specs)
        envelope = self.settings.envelope
        parts.append(contracts.evaluate(agreed, self.listing, self.files, tuple(envelope.get("import_patterns") or ()) if envelope.get("enabled", True) else (), envelope.get("function_pattern") or "boundary.validate"))
        policy = self.settings.unresolved_edge_policy
        if policy != "ignore":
            lost = self.unresolved.where(~F.col("specifier").rlike(r"^[^./]"))
            parts.append(lost.select(*violations.violation(rule=F.lit("hygiene.unresolved_import"), severity=F.lit("error" if policy == "error" else "warning"), message=F.concat(F.lit("cannot resolve "), F.col("specifier")), from_file=F.col("from_file"), from_module=F.col("from_module"), line=F.col("line"))))
        everything = violations.union(*parts, *self.config_findings())
        set_by_constraints = everything.where(F.col("rule").rlike("^(boundary|enforce-)") & ~F.col("rule").rlike(r"^boundary\.(contract|match|envelope)"))
        rest = everything.where(~(F.col("rule").rlike("^(boundary|enforce-)") & ~F.col("rule").rlike(r"^boundary\.(contract|match|envelope)")))
        return violations.with_severity(set_by_constraints, rules).unionByName(rest)

    def config_findings(self) -> list[DataFrame]:
        """Findings of globs that are none, in the configuration and in lists of public files."""
        b = self.boundaries.join(self.specs.select("module", "spec_path"), "module")
        bad = b.withColumn("bad", F.filter(F.coalesce("public_api", F.array().cast("array<string>")), validate.bad_glob)).where(F.size("bad") > 0)
        message = F.concat(F.lit("public_api of "), F.col("module"), F.lit(" has globs that do not compile: "), F.array_join("bad", ", "))
        out = [bad.select(*violations.violation(rule=F.lit("boundary.config.invalid_public_api_glob"), severity=F.lit("error"), message=message, from_file=F.col("spec_path"), from_module=F.col("module")))]
        one = self.spark.range(1)
        more = (self.settings.import_hygiene.get("test_boundary") or {}).get("test_patterns") or ()
        for rule, patterns, file in (("boundary.config.invalid_test_glob", self.settings.test_patterns, "."), ("hygiene.config_error", (*self.settings.test_patterns, *more), self.config_file)):
            if wrong := globs.faults(patterns):
                out.append(one.select(*violations.violation(rule=F.lit(rule), severity=F.lit("error"), message=F.lit(f"test_patterns: {'; '.join(wrong)}"), from_file=F.lit(file))))
        return out

    def lost(self) -> DataFrame:
        """(from_file, specifier, line, kind): how each import without a target counts among the edges."""
        ids = self.specs.select(F.explode(F.filter(F.concat(F.array("import_id"), F.coalesce("import_ids", F.array().cast("array<string>"))), lambda i: i.isNotNull())).alias("specifier")).distinct().withColumn("known", F.lit(True))
        rows = self.unresolved.join(ids, "specifier", "left")
        return rows.select("from_file", "specifier", "line", resolve.lost_kind(F.col("specifier"), F.lit(False), F.col("edge_kind") == "dynamic", F.col("known")).alias("kind"))

    def governance_hashes(self) -> DataFrame:
        """One row (project, config_hash, spec_hash): digests of where the project lies, of its configuration and of all its specs. Neither the order of files nor that of keys matters."""
        project, config = (F.lit("sha256:" + hashing.sha256_hex(t)) for t in (os.path.realpath(self.root), hashing.canonical(asdict(self.settings))))
        return self.specs.agg(hashing.of_rows(*sorted(self.specs.columns)).alias("spec_hash")).select(project.alias("project"), config.alias("config_hash"), "spec_hash")

    def classification(self) -> DataFrame:
        """One row: resolved, type-only, external and unresolved requests that are not ignored."""
        k, t = F.col("kind"), F.col("type_only")
        return self.resolved.where("not ignored").agg(
            F.count_if((k == resolve.FIRST) & ~t).alias("resolved"), F.count_if((k == resolve.FIRST) & t).alias("type_only"), F.count_if((k == resolve.THIRD) | ((k == resolve.NONE) & ~F.col("specifier").rlike(r"^[./]"))).alias("external"),
            F.count_if((k == resolve.NONE) & F.col("specifier").rlike(r"^[./]")).alias("unresolved"),
        )

    def validate(self) -> DataFrame:
        return validate.issues(self.specs)

    def check(self, baseline: str | None = None, since: str | None = None, today: str | None = None, deny_widenings: bool = False) -> Verdict:
        """The verdict. since: only findings of files changed since a reference and of modules that they reach; with
        ``deny_widenings`` a policy that has widened since then fails."""
        if deny_widenings and not since:
            raise ProjectError("deny_widenings needs since, the reference to compare with")
        if bad := self.validate().where("level = 'error'").orderBy("module", "message").take(20):
            raise ProjectError("; ".join(f"{r.module}: {r.message}" for r in bad))
        if bad := self.rule_faults().orderBy("rule", "module", "message").take(20):
            raise ProjectError("; ".join(f"{r.rule}: {r.module}: {r.message}" for r in bad))
        found = self.findings()
        if since:
            changed = sources.changed_files(self.spark, self.root, since)
            touched = self.owned.join(changed, "path", "left_semi").where("module is not null").select("module")
            reached = graphs.blast_radius(self.edges.where("from_module is not null and to_module is not null"), touched).select(F.col("module").alias("from_module"), F.lit(True).alias("_reached"))
            by_file = changed.select(F.col("path").alias("from_file"), F.lit(True).alias("_changed")).distinct()
            # equal findings stay apart, for a baseline counts them
            found = found.join(reached, "from_module", "left").join(by_file, "from_file", "left").where("_reached or _changed").select(*found.columns)
        widened = deny_widenings and policy_report(self.spark, self.root, since, "HEAD", config_file=self.config_file).summary.first()["widenings"] > 0
        day = F.lit(today).cast("date") if today else F.current_date()
        printed = violations.fingerprinted(found)
        entries = sources.baseline(self.spark, baseline) if baseline else self.spark.createDataFrame([], sources.ENTRY)
        classified = baselines.classify(printed, entries, day).persist()
        counts = violations.summary(classified).crossJoin(baselines.staleness(printed, entries, day).select("stale", "expired"))  # one row by one row
        return Verdict(classified.orderBy(*[F.asc_nulls_first(c) for c in violations.ORDER]), violations.status(counts, self.settings.stale_baseline == "fail", F.col("stale"), widened))

    def ownership(self) -> dict[str, DataFrame]:
        claimed = self.specs.where("boundaries.path is not null").select("module", F.col("boundaries.path").alias("glob"))
        return {"unclaimed": ownership.unclaimed(self.files, claimed), "overlaps": ownership.overlaps(self.files, claimed), "orphans": ownership.orphans(self.files, claimed), "repeated": ownership.repeated_modules(self.specs), "contradictions": ownership.contradictions(claimed, self.files)}

    def governance(self) -> DataFrame:
        """(module, conflict, detail): specs that contradict themselves or, by their contracts, each other."""
        agreed = self.boundaries.select("module", F.explode("contracts").alias("c")).select("module", "c.id", "c.direction", "c.envelope", "c.imports_contract")
        return ownership.governance_conflicts(self.boundaries).unionByName(contracts.conflicts(agreed))

    def canonical_findings(self) -> DataFrame:
        """(rule, severity, module, id, importer, place, target, message): agreed import ids of modules that enforce them which, asked for from
        a file outside the module, lead to no public file of it."""
        named = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array("import_id"), "import_ids"), lambda i: F.trim(i)), lambda i: F.coalesce(i, F.lit("")) != "")))
        ids = self.specs.where("boundaries.enforce_canonical_imports").select("module", F.explode(named).alias("id"), "boundaries.public_api")
        asked = ids.join(ownership.probes(self.owned, ids), "module").withColumn("directory", paths.directory(F.col("importer")))
        found = resolve.resolve(asked.select("module", "directory", F.col("id").alias("specifier")), self.files, self.installed, self.aliases, self.entries)
        owner = self.owned.select(F.col("path").alias("target"), F.col("module").alias("target_module"))
        told = asked.join(found.select("module", F.col("specifier").alias("id"), "kind", "target", "package"), ["module", "id"]).join(owner, "target", "left")
        here = (F.col("kind") == resolve.FIRST) & (F.col("target_module") == F.col("module"))
        public = here & globs.matches_any(F.col("target"), F.col("public_api"))
        leads = F.when(here, F.concat(F.lit("a file that is not public: "), "target")).when(F.col("kind") == resolve.FIRST, F.concat(F.lit("another module's file: "), "target")).when(F.col("kind") == resolve.THIRD, F.concat(F.lit("a package: "), F.coalesce("package", "id"))).otherwise("nothing")
        wrong = told.where(~F.coalesce(public, F.lit(False)))
        message = F.concat(F.lit("import id "), "id", F.lit(" leads from "), "importer", F.lit(" to "), leads)
        return wrong.select(F.lit("boundary.canonical_import_dangling").alias("rule"), F.lit("warning").alias("severity"), "module", "id", "importer", "place", "target", message.alias("message"))

    def compare(self, trace: str) -> DataFrame:
        """(a, b, side): edges that only we or only another tool's trace has."""
        theirs, _ = sources.trace(self.spark, trace)
        return snapshots.edge_differences(self.edges.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")), theirs)


    def compare_import(self, trace: str, from_file: str, specifier: str) -> DataFrame:
        """One row: how we and another tool's trace resolve one import of a file, whether that matches, and if not, in which way."""
        edges, records = sources.trace_records(self.spark, trace)
        asked = self.spark.createDataFrame([(from_file, specifier)], "from_file string, specifier string").withColumn("directory", paths.directory(F.col("from_file")))
        ours = resolve.resolve(asked, self.files, self.installed, self.aliases, self.entries).select("from_file", "specifier", F.col("kind").alias("ours_kind"), F.when(F.col("kind") == resolve.FIRST, F.col("target")).alias("ours_to"))
        both = parity.theirs(ours, edges, records)
        pair = [F.col("from_file") == F.col("_a"), F.col("ours_to") == F.col("_b")]
        mark = lambda df, a, b, name: df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.lit(True).alias(name)).distinct()
        both = both.join(mark(self.edges, "from_file", "to_file", "here"), pair, "left").drop("_a", "_b").join(mark(edges, "a", "b", "there"), pair, "left").drop("_a", "_b")
        same = F.coalesce("here", F.lit(False)) == F.coalesce("there", F.lit(False))
        kind = F.when(~same, parity.category(F.col("specifier"), F.col("ours_kind"), F.col("ours_to"), F.col("theirs_kind"), F.col("theirs_to")))
        return both.select("from_file", "specifier", "ours_kind", "ours_to", "theirs_kind", "theirs_to", "source", F.when(same, "match").otherwise("mismatch").alias("status"), kind.alias("category"), parity.hint(kind).alias("hint"))

    def report(self, verdict: Verdict) -> DataFrame:
        """A verdict's lines for people."""
        return reports.verdict(verdict.violations, verdict.summary, self.classification(), self.unresolved.select("from_file", "line", "specifier"))


SPEC_FIELDS = ("public_api", "allow_imports_from", "never_imports", "allow_type_imports_from", "visibility", "allow_imported_by", "deny_imported_by", "friend_modules", "enforce_canonical_imports", "allowed_dependencies", "forbidden_dependencies", "enforce_in_tests")


def specs_at(spark: SparkSession, root: str, ref: str, settings: sources.Config = sources.Config()) -> DataFrame:
    """The specs of a reference; one that cannot be read is an error."""
    found, errors = sources.specs_of(sources.files_at(spark, root, ref).where(sources.in_spec_dirs(F.col("path"), settings)))
    if bad := errors.orderBy("spec_path").take(5):
        raise ProjectError("; ".join(f"{r.spec_path}: {r.error}" for r in bad))
    return found


def policy_diff(spark: SparkSession, root: str, base: str, head: str, config_file: str = "archsieve.config.yml") -> DataFrame:
    """(module, field, subject, classification, detail, signature): what changed in the specs between two references. The subject is the
    constraint, contract or spec file that a change is of; changes of a spec's own fields have none."""
    old, new = (sources.config_at(root, ref, config_file) for ref in (base, head))
    before, after = specs_at(spark, root, base, old).persist(), specs_at(spark, root, head, new).persist()
    side = lambda df: df.select("module", "version", "package", "import_id", F.array_join(F.array_sort("import_ids"), ",").alias("import_ids"), "description", *[F.col(f"boundaries.{f}").alias(f) for f in SPEC_FIELDS])
    columns = ("module", "field", "subject", "classification", "detail", "signature")
    plain = snapshots.diff(side(before), side(after), structural=("version", "package", "import_id", "import_ids", "description")).withColumn("subject", F.lit(None).cast("string")).select(*columns)
    kept = lambda a, b: a.join(b.select("module").distinct(), "module", "left_semi")
    base_both, head_both = kept(before, after), kept(after, before)
    rules = snapshots.constraint_changes(sources.listed(base_both, "constraints"), sources.listed(head_both, "constraints"))
    agreed = lambda df: sources.listed(df, "boundaries.contracts").select("module", "place", "id", "contract", F.col("match.files").alias("files"), F.col("match.pattern").alias("pattern"), "direction", "envelope", "imports_contract")
    contract = snapshots.contract_changes(agreed(base_both), agreed(head_both))

    def covered(found: DataFrame, ref: str) -> DataFrame:
        owners = found.where("boundaries.path is not null").select("module", F.col("boundaries.path").alias("glob"))
        return ownership.glob_matches(sources.paths_at(spark, root, ref), owners).select("module", "path").distinct()

    was, now = covered(before, base), covered(after, head)
    moved = snapshots.path_coverage(kept(was, now), kept(now, was))
    places = moved.select("module", F.lit("path").alias("field"), F.lit(None).cast("string").alias("subject"), "classification", F.concat(F.lit("+"), F.col("plus").cast("string"), F.lit(" -"), F.col("minus").cast("string")).alias("detail"), F.lit(None).cast("string").alias("signature"))
    gone = before.join(after.select("module"), "module", "left_anti").select(F.lit("D").alias("status"), F.col("spec_path").alias("to_path"))  # told by their module
    operations = sources.spec_changes(spark, root, base, head).where(sources.in_spec_dirs(F.coalesce("from_path", "to_path"), old) | sources.in_spec_dirs(F.col("to_path"), new)).join(gone, ["status", "to_path"], "left_anti")
    keyed = lambda df: df.select("spec_path", *[c for c in df.columns if c != "spec_path"])
    pairing = snapshots.renamed(keyed(before), keyed(after), operations.where("status in ('R', 'C')").select(F.col("from_path").alias("from_key"), F.col("to_path").alias("to_key")), key="spec_path")
    files = snapshots.file_changes(operations, pairing.select(F.col("from_key").alias("from_path"), F.col("to_key").alias("to_path"), "result"))
    return violations.union(plain, *(p.select(*columns) for p in (rules, contract, places, files)))


@dataclass
class PolicyReport:
    changes: DataFrame
    config_changes: DataFrame
    compensations: DataFrame
    summary: DataFrame

    def human(self, base: str, head: str) -> DataFrame:
        return reports.policy(self.changes, self.config_changes, self.compensations, self.summary, base, head)

    def events(self) -> DataFrame:
        return reports.policy_events(self.changes, self.config_changes, self.compensations, self.summary)

    def json(self) -> DataFrame:
        return reports.policy_json(self.changes, self.config_changes, self.compensations, self.summary)

    def exit_code(self) -> int:
        return VIOLATIONS if self.summary.first()["net"] == snapshots.WIDENING else PASS


def policy_report(spark: SparkSession, root: str, base: str, head: str, compensate: bool = False, config_file: str = "archsieve.config.yml") -> PolicyReport:
    """What changed in specs and configuration between two references. With ``compensate`` widenings that a narrowing of a module that
    imports from it, or that it imports from, offsets do not count for the net class."""
    old, new = (sources.config_at(root, ref, config_file) for ref in (base, head))
    changes = policy_diff(spark, root, base, head, config_file).persist()
    settings = config_diff(spark, old, new).persist()
    adjacent = specs_at(spark, root, head, new).select(F.col("module").alias("a"), F.explode("boundaries.allow_imports_from").alias("b")).distinct()
    pairs = snapshots.compensations(changes, adjacent)
    pairs = (pairs if compensate else pairs.limit(0)).persist()
    everything = changes.select("module", "field", "classification").unionByName(settings.select(F.lit(None).cast("string").alias("module"), "field", "classification"))
    counts = snapshots.summary(everything).drop("net")
    left = snapshots.offset(everything, pairs).agg(F.count_if(F.col("classification") == snapshots.WIDENING).alias("left"))
    summary = counts.crossJoin(left).withColumn("net", snapshots.net(F.col("left"), F.col("narrowings"))).drop("left")  # one row by one row
    return PolicyReport(changes, settings, pairs, summary)


#: Settings inside others: the name of the change, the section and the field.
SECTIONS = {"escape_hatches.max_new_per_diff": ("escape_hatches", "max_new_per_diff"), "escape_hatches.require_expiry": ("escape_hatches", "require_expiry"), "envelope.enabled": ("envelope", "enabled")}


def config_diff(spark: SparkSession, base: sources.Config, head: sources.Config) -> DataFrame:
    """(key, field, classification, detail): what changed in the configuration."""
    names = ["exclude", "spec_dirs", "jest_mock_mode", "stale_baseline", "unresolved_edge_policy", "strict_ownership", "strict_ownership_level", "enforce_type_only_imports", "telemetry", "release_channel", "tsconfig_filename", "test_patterns", "include_dirs"]
    kinds = {"exclude": sources.TEXTS, "spec_dirs": sources.TEXTS, "test_patterns": sources.TEXTS, "include_dirs": sources.TEXTS, "strict_ownership": "boolean", "enforce_type_only_imports": "boolean", "telemetry": "boolean"}
    schema = ", ".join(["key string", *(f"{n} {kinds.get(n, 'string')}" for n in names), *(f"`{n}` {'long' if 'max' in n else 'boolean'}" for n in SECTIONS)])
    row = lambda c: ["config", *(list(v) if isinstance(v := getattr(c, n), tuple) else v for n in names), *((getattr(c, a) or {}).get(b, None if "max" in b else False) for a, b in SECTIONS.values())]
    side = lambda c: spark.createDataFrame([row(c)], schema).withColumnsRenamed({n: n.rpartition(".")[2] for n in SECTIONS}).withColumnRenamed("enabled", "envelope_enabled")
    plain = snapshots.diff(side(base), side(head), key="key", structural=("telemetry", "release_channel", "tsconfig_filename", "test_patterns", "include_dirs"), limits=("max_new_per_diff",)).drop("signature")
    full = {n.rpartition(".")[2]: n for n in SECTIONS if n != "envelope.enabled"} | {"envelope_enabled": "envelope.enabled"}
    named = functools.reduce(lambda c, n: c.when(F.col("field") == n, full[n]), full, F.when(F.lit(False), "")).otherwise(F.col("field"))
    entries = lambda c: {e["pattern"].strip(): (e.get("max_depth", 0), e.get("severity") or "warning") for e in c.import_hygiene.get("deny_deep_imports") or []}
    deep = deep_import_diff(*(spark.createDataFrame([(p, *e) for p, e in entries(c).items()], DEEP) for c in (base, head)))
    told = deep.select(F.lit("config").alias("key"), F.lit("import_hygiene.deny_deep_imports").alias("field"), "classification", "detail")
    return plain.select("key", named.alias("field"), "classification", "detail").unionByName(told)


DEEP = "pattern string, max_depth int, severity string"


def deep_import_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(pattern, classification, detail) of deep-import entries (pattern, max_depth, severity). A new entry narrows, a lost one widens; a
    smaller depth and a stricter severity narrow, and both ways at once are structural. A pattern comes once a side."""
    entry = lambda df, name: df.select("pattern", F.struct("max_depth", "severity").alias(name))
    sign = lambda x: F.signum(x.cast("double"))
    depth = sign(F.col("b.max_depth") - F.col("a.max_depth"))
    level = sign(violations.rank(F.col("b.severity")) - violations.rank(F.col("a.severity")))
    total = F.when(depth * level < 0, snapshots.STRUCTURAL).when(depth + level > 0, snapshots.WIDENING).when(depth + level < 0, snapshots.NARROWING)
    kind = F.when(F.col("a").isNull(), snapshots.NARROWING).when(F.col("b").isNull(), snapshots.WIDENING).otherwise(total)
    text = lambda c: F.coalesce(F.concat(F.col(f"{c}.max_depth").cast("string"), F.lit(" "), F.col(f"{c}.severity")), F.lit("none"))
    joined = entry(base, "a").join(entry(head, "b"), "pattern", "full_outer")
    return joined.select("pattern", kind.alias("classification"), F.concat("pattern", F.lit(": "), text("a"), F.lit(" -> "), text("b")).alias("detail")).where("classification is not null")
