"""Sources of a project: files, specs, configuration, baselines, traces, workspaces and snapshots of a repository."""

from __future__ import annotations

import dataclasses
import json
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archsieve.functions import globs, paths
from archsieve.operators import traces
from archsieve.operators.graphs import checkpointed
from archsieve.sources import discovery, one_object

TEXTS = "array<string>"
CONTRACT = "struct<id:string,contract:string,match:struct<files:array<string>,pattern:string>,direction:string,envelope:string,imports_contract:array<string>>"
HYGIENE = "struct<deny_deep_imports:array<struct<pattern:string,max_depth:bigint,allow:boolean>>,test_boundary:struct<mode:string>>"
BOUNDARIES = (
    "struct<path:string,public_api:array<string>,allow_imports_from:array<string>,never_imports:array<string>,allow_type_imports_from:array<string>,visibility:string,allow_imported_by:array<string>,deny_imported_by:array<string>,"
    f"friend_modules:array<string>,enforce_canonical_imports:boolean,allowed_dependencies:array<string>,forbidden_dependencies:array<string>,enforce_in_tests:boolean,import_hygiene:{HYGIENE},contracts:array<{CONTRACT}>>"
)
SPEC = f"version string, module string, package string, import_id string, import_ids array<string>, description string, boundaries {BOUNDARIES}, constraints array<struct<rule:string,params:string,severity:string,message:string>>"
#: The fields of a spec file; anything else is an error.
FIELDS = {
    "": ("version", "module", "package", "import_id", "import_ids", "description", "boundaries", "constraints"),
    "boundaries": (
        "path", "public_api", "allow_imports_from", "never_imports", "allow_type_imports_from", "visibility", "allow_imported_by", "deny_imported_by", "friend_modules", "enforce_canonical_imports", "allowed_dependencies",
        "forbidden_dependencies", "enforce_in_tests", "import_hygiene", "contracts",
    ),
    "constraints": ("rule", "params", "severity", "message"),
    "contracts": ("id", "contract", "match", "direction", "envelope", "imports_contract"),
}
#: What tests are called where the configuration does not say.
TESTS = ("**/*.test.ts", "**/*.test.tsx", "**/*.spec.ts", "**/*.spec.tsx", "**/__tests__/**", "**/__mocks__/**")


@dataclass(frozen=True)
class Config:
    """A project's configuration; unknown keys are ignored."""

    spec_dirs: tuple[str, ...] = (".",)
    exclude: tuple[str, ...] = tuple(f"**/{d}/**" for d in paths.SKIPPED)
    test_patterns: tuple[str, ...] = TESTS
    include_dirs: tuple[str, ...] = ()
    jest_mock_mode: str = "warn"
    stale_baseline: str = "warn"
    release_channel: str = "stable"
    telemetry: bool = False
    enforce_type_only_imports: bool = False
    tsconfig_filename: str = "tsconfig.json"
    unresolved_edge_policy: str = "warn"
    strict_ownership: bool = False
    strict_ownership_level: str = "errors"
    envelope: dict = field(default_factory=dict)
    import_hygiene: dict = field(default_factory=dict)
    baseline: dict = field(default_factory=dict)
    escape_hatches: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.tsconfig_filename or "/" in self.tsconfig_filename:
            raise ValueError("tsconfig_filename must be a file's name")


def config(text: str | None) -> Config:
    """The configuration of a YAML text; none gives the defaults."""
    raw = yaml.safe_load(text or "") or {}
    known = {f.name: f for f in dataclasses.fields(Config)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None}
    if isinstance(values.get("telemetry"), dict):  # an older shape
        values["telemetry"] = bool(values["telemetry"].get("enabled"))
    if "stale_baseline_policy" in raw:
        values.setdefault("stale_baseline", raw["stale_baseline_policy"])
    return Config(**values)


def project_config(spark: SparkSession, root: str, name: str = "archsieve.config.yml") -> Config:
    """The configuration in a file of the root; the defaults where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{root.rstrip('/')}/{name}", wholetext=True).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return config(row["value"] if row else None)


def config_at(root: str, ref: str, name: str = "archsieve.config.yml") -> Config:
    """The configuration as it was at a reference; the defaults where it had none."""
    commit = valid_ref(root, ref)
    there = git(root, "ls-tree", "-z", "--name-only", commit, "--", name)
    return config(next(blobs(root, [f"{commit}:{name}"])).decode(errors="replace") if there else None)


def texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content, length) of the files below a root whose names match."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    clean = F.regexp_replace("path", "^file:/+", "/")
    below = F.regexp_replace(paths.relative_to(clean, root.removeprefix("file://")), "^/+", "")
    return found.select(below.alias("path"), F.decode("content", "UTF-8").alias("content"), "length")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a root."""
    return texts(spark, root, "*").select("path", "length")


def source_files(spark: SparkSession, root: str, settings: Config = Config()) -> DataFrame:
    """(path, content, is_test) of source files outside the excluded directories. Test patterns of which one is no glob mark nothing."""
    if discovery.local(root):  # the walk leaves directories out before it lists them
        kept = discovery.source_tree(spark, root, settings.exclude, settings.include_dirs)[0]
    else:
        kept = texts(spark, root, "*.{" + ",".join(paths.EXTENSIONS) + "}").where(~paths.skipped(F.col("path"), settings.include_dirs))
    excluded = [g for g in settings.exclude if not any(g == f"**/{d}/**" for d in settings.include_dirs)]
    for g in excluded:
        kept = kept.where(~F.col("path").rlike(globs.compile_glob(g)))
    test = F.lit(False)
    for g in () if globs.faults(settings.test_patterns) else settings.test_patterns:
        test = test | F.col("path").rlike(globs.compile_glob(g))
    return kept.dropDuplicates(["path"]).select("path", "content", test.alias("is_test"))


def discovery_warnings(spark: SparkSession, root: str, settings: Config = Config()) -> DataFrame:
    """(path, warning): what discovery could not read. Of a root that is no path of the file system Spark itself reads all or fails."""
    if not discovery.local(root):
        return spark.createDataFrame([], "path string, warning string")
    return discovery.source_tree(spark, root, settings.exclude, settings.include_dirs)[1].orderBy("path")


def faults(raw: object) -> list[str]:
    """What is wrong with a spec's shape."""
    if not isinstance(raw, dict):
        return ["a spec is a mapping"]
    out = [f"unknown field {k}" for k in raw if k not in FIELDS[""]] + [f"{k} is required" for k in ("version", "module") if not raw.get(k)]
    b = raw.get("boundaries") or {}
    out += [f"unknown field boundaries.{k}" for k in b if k not in FIELDS["boundaries"]]
    out += [f"unknown field contracts.{k}" for c in b.get("contracts") or [] for k in c if k not in FIELDS["contracts"]]
    return out + [f"unknown field constraints.{k}" for c in raw.get("constraints") or [] for k in c if k not in FIELDS["constraints"]]


def normal(raw: dict) -> dict:
    """A spec with its parameters as JSON texts and its defaults filled in."""
    b = raw.get("boundaries")
    if b is not None:
        for k in ("public_api", "never_imports", "allow_type_imports_from", "allow_imported_by", "deny_imported_by", "friend_modules", "allowed_dependencies", "forbidden_dependencies", "contracts"):
            b[k] = b.get(k) or []
        b["visibility"] = b.get("visibility") or "public"
        for k in ("enforce_canonical_imports", "enforce_in_tests"):
            b[k] = bool(b.get(k))
        for c in b["contracts"]:
            c["match"] = {"files": [], "pattern": None} | (c.get("match") or {})
            c["direction"], c["envelope"], c["imports_contract"] = c.get("direction") or "bidirectional", c.get("envelope") or "optional", c.get("imports_contract") or []
        for e in (b.get("import_hygiene") or {}).get("deny_deep_imports") or []:
            e.setdefault("allow", False)
    rules = [{"rule": c.get("rule"), "params": json.dumps(c.get("params") or {}, sort_keys=True), "severity": c.get("severity") or "error", "message": c.get("message")} for c in raw.get("constraints") or []]
    return raw | {"version": str(raw.get("version")), "constraints": rules, "import_ids": raw.get("import_ids") or []}


def specs_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spec_path, and the fields of a spec) of spec files (path, content); and (spec_path, error) of those that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    raw = yaml.safe_load(text or "")
                    wrong = faults(raw)
                    out.append((None, "; ".join(wrong)) if wrong else (json.dumps(normal(raw)), None))
                except Exception as e:  # a file that is no YAML is a finding, not a failure
                    out.append((None, str(e).replace("\n", " ")))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in zip(*out))] if out else [pa.array([], pa.string())] * 3, names=["spec_path", "json", "error"])

    parsed = files.select("path", "content").mapInArrow(run, "spec_path string, json string, error string")
    good = parsed.where("error is null").select("spec_path", F.from_json("json", SPEC).alias("s")).select("spec_path", "s.*")
    return good, parsed.where("error is not null").select("spec_path", "error")


def in_spec_dirs(path: Column, settings: Config) -> Column:
    """Whether a path is below a spec directory; ``.`` is the root itself."""
    tops = [d.strip("/").removeprefix("./") for d in settings.spec_dirs]
    return F.lit(True) if not tops or {"", "."} & set(tops) else reduce(or_, [F.startswith(path, F.lit(f"{d}/")) for d in tops])


def specs(spark: SparkSession, root: str, settings: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """All specs below the spec directories of a root."""
    path = F.col("path")
    return specs_of(texts(spark, root, "*.spec.yml").where(~paths.skipped(path, settings.include_dirs) & in_spec_dirs(path, settings)))


def installed(spark: SparkSession, root: str) -> DataFrame:
    """(package): packages with a directory below any node_modules."""
    name = F.regexp_extract("path", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/@.][^/]*)/[^/]", 1)
    return texts(spark, root, "*").select(name.alias("package")).where("package <> ''").distinct()


COMPILER = "extends string, base_url string, paths string, refers array<string>"
#: How long a chain of configurations that extend each other may be; a longer one, or a ring, is an error.
LONGEST_CHAIN = 32


def compiler_options(text: str) -> tuple[str | None, str | None, str | None, list[str]]:
    """(extends, baseUrl, paths as JSON pairs, paths of references) of a compiler configuration: JSON with comments and trailing commas."""
    token = r'("(?:\\.|[^"\\])*")'
    bare = re.sub(token + r"|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text.removeprefix("\ufeff"), flags=re.S)
    raw = json.loads(re.sub(token + r"|,(?=\s*[}\]])", lambda m: m[1] or "", bare) or "{}")
    options = raw.get("compilerOptions") or {}
    mapped = options.get("paths")
    extends = raw.get("extends")
    refers = [r["path"] for r in raw.get("references") or [] if isinstance(r, dict) and isinstance(r.get("path"), str)]
    return extends if isinstance(extends, str) else None, options.get("baseUrl"), None if mapped is None else json.dumps(sorted(mapped.items())), refers


def compiler_configs(files: DataFrame) -> DataFrame:
    """(path, next, base, paths, paths_at, refers) of compiler configurations (path, content): what each says itself; next: the one that
    it extends, refers: those that it refers to, as written. Packages that are extended are left out. One that cannot be read raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [compiler_options(t or "") for t in batch.column(1).to_pylist()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=["path", "extends", "base_url", "paths", "refers"])

    here = paths.directory(F.col("path"))
    parsed = files.select("path", "content").mapInArrow(run, f"path string, {COMPILER}")
    up = F.when(F.col("extends").rlike(r"^\.{1,2}/"), paths.collapsed(F.concat_ws("/", here, F.when(F.endswith("extends", F.lit(".json")), F.col("extends")).otherwise(F.concat("extends", F.lit(".json"))))))
    return parsed.select("path", up.alias("next"), F.when(F.col("base_url").isNotNull(), paths.collapsed(F.concat_ws("/", here, "base_url"))).alias("base"), "paths", F.when(F.col("paths").isNotNull(), here).alias("paths_at"), "refers")


def references(configs: DataFrame, name: str = "tsconfig.json") -> tuple[DataFrame, DataFrame]:
    """(path, refers_to, depth, place): all configurations that each one refers to, directly or through others, nearest first, in the order
    of the lists; and (path, refers_to, error): references to nothing, and configurations that refer to themselves in a ring.
    configs: as ``compiler_configs`` gives them. A reference names a file, or a directory whose configuration has the given name. A
    round reaches one step further and keeps each pair once, at its least depth, so rings end; nothing is limited."""
    at = paths.collapsed(F.concat_ws("/", paths.directory(F.col("path")), F.col("written")))
    file = F.when(F.endswith("written", F.lit(".json")), at).when(at == "", F.lit(name)).otherwise(F.concat(at, F.lit(f"/{name}")))
    written = configs.select("path", F.posexplode("refers").alias("place", "written")).select("path", file.alias("refers_to"), "place")
    there = configs.select(F.col("path").alias("refers_to"))
    lost = written.join(there, "refers_to", "left_anti").select("path", "refers_to", F.lit("there is no such configuration").alias("error"))
    step = written.join(there, "refers_to", "left_semi").groupBy("path", "refers_to").agg(F.min("place").alias("place"))
    reached = checkpointed(step.select("path", "refers_to", F.lit(1).alias("depth"), F.array("place").alias("place")))
    edge, last, depth = step.select(F.col("path").alias("refers_to"), F.col("refers_to").alias("_next"), F.col("place").alias("_place")), reached, 1
    while not last.isEmpty():
        depth += 1
        more = last.join(edge, "refers_to").groupBy("path", F.col("_next").alias("refers_to")).agg(F.min(F.concat("place", F.array("_place"))).alias("place"))
        last = checkpointed(more.join(reached, ["path", "refers_to"], "left_anti").select("path", "refers_to", F.lit(depth).alias("depth"), "place"))
        reached = checkpointed(reached.unionByName(last))
    rings = reached.where("path = refers_to").select("path", "refers_to", F.lit("it refers to itself in a ring").alias("error"))
    return reached.where("path <> refers_to"), lost.unionByName(rings)


def aliases(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """Aliases of specifiers as ``resolve.alias_stems`` takes them, of compiler configurations (path, content). A configuration
    that says nothing of paths or of its base has what the one it extends says, relative to where that stands. Those of the given
    name count for the directories below them. One that such a configuration refers to counts, by any name, below where it lies:
    the nearest first, and before the one that refers to it. The rest is there to be extended."""
    own = compiler_configs(files).persist()
    above = own.select(F.col("path").alias("next"), F.col("next").alias("_next"), F.col("base").alias("_base"), F.col("paths").alias("_paths"), F.col("paths_at").alias("_at"))
    whole, rounds = own.drop("refers"), 0
    while not whole.where("next is not null").isEmpty():
        rounds += 1
        if rounds > LONGEST_CHAIN:
            raise ValueError("compiler configurations extend each other in a ring")
        joined = whole.join(above, "next", "left")
        whole = joined.select("path", F.col("_next").alias("next"), F.coalesce("base", "_base").alias("base"), F.coalesce("paths", "_paths").alias("paths"), F.coalesce("paths_at", "_at").alias("paths_at"))
    named = F.regexp_extract("path", "([^/]*)$", 1) == name
    if own.where(F.size("refers") > 0).isEmpty():
        chosen = whole.where(named)
    else:  # of the configurations that count in one directory the first stands for it
        reached, _ = references(own, name)
        by_other = reached.where(named).groupBy("refers_to").agg(F.min(F.struct("depth", "place", "path")).alias("rank")).select(F.col("refers_to").alias("path"), "rank")
        counted = whole.join(by_other, "path", "left").where(named | F.col("rank").isNotNull())
        says = F.col("base").isNotNull() | F.col("paths").isNotNull()
        first = F.struct((~says).alias("silent"), F.col("rank").isNull().alias("own"), "rank", "path")
        best = counted.groupBy(paths.directory(F.col("path"))).agg(F.min(first).alias("best")).select(F.col("best.path").alias("path"))
        chosen = whole.join(best, "path", "left_semi")
    whole = chosen
    scope = paths.directory(F.col("path")).alias("scope")
    listed = whole.where("paths is not null").select(scope, F.coalesce("base", "paths_at").alias("top"), F.explode(F.from_json("paths", "array<array<string>>")).alias("entry"))
    pairs = listed.select("scope", "top", F.col("entry")[0].alias("pattern"), F.posexplode(F.from_json(F.col("entry")[1], TEXTS)).alias("place", "target"))
    part = lambda c, n: F.coalesce(F.get(F.split(c, r"\*", 2), F.lit(n)), F.lit(""))
    at = lambda top, c: F.when(F.col(top) == "", c).otherwise(F.concat(F.col(top), F.lit("/"), c))
    mapped = pairs.select("scope", part("pattern", 0).alias("prefix"), part("pattern", 1).alias("tail"), (~F.contains("pattern", F.lit("*"))).alias("exact"), "place", at("top", part("target", 0)).alias("replacement"), part("target", 1).alias("replacement_tail"), F.lit(False).alias("base"))
    plain = whole.where("base is not null").select(scope, F.lit("").alias("prefix"), F.lit("").alias("tail"), F.lit(False).alias("exact"), F.lit(0).alias("place"), at("base", F.lit("")).alias("replacement"), F.lit("").alias("replacement_tail"), F.lit(True).alias("base"))
    none = whole.where("paths is null and base is null").select(scope, F.lit("\0").alias("prefix"), F.lit("").alias("tail"), F.lit(True).alias("exact"), F.lit(0).alias("place"), F.lit("").alias("replacement"), F.lit("").alias("replacement_tail"), F.lit(False).alias("base"))
    return mapped.unionByName(plain).unionByName(none)


def rules_of(specs_df: DataFrame) -> DataFrame:
    """(module, rule, params, severity, message): the constraints of specs."""
    return specs_df.select("module", F.explode("constraints").alias("c")).select("module", "c.*")


def listed(specs_df: DataFrame, field: str) -> DataFrame:
    """(module, place, and the fields of its elements) of a list of specs, such as constraints or boundaries.contracts."""
    return specs_df.select("module", F.posexplode(field).alias("place", "x")).select("module", "place", "x.*")


def contracts_of(specs_df: DataFrame) -> DataFrame:
    """(module, id, contract, files, pattern, direction, envelope, imports_contract)."""
    c = specs_df.where("boundaries is not null").select("module", F.explode("boundaries.contracts").alias("c"))
    return c.select("module", "c.id", "c.contract", F.col("c.match.files").alias("files"), F.col("c.match.pattern").alias("pattern"), "c.direction", "c.envelope", "c.imports_contract")


ENTRY = "fingerprint string, positional_fingerprint string, rule string, severity string, message string, from_file string, to_file string, from_module string, to_module string, line int, column int, owner string, reason string, expires_at string, added_at string"


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a baseline: one JSON object with ``entries``, or an entry a line as ``write_baseline`` leaves them; none where nothing is there.
    A file that is neither is an error."""
    from pyspark.errors import AnalysisException

    try:
        first = spark.read.text(path).where(F.trim("value") != "").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first = None
    if first is None:
        return spark.createDataFrame([], ENTRY)
    try:
        lines = "fingerprint" in json.loads(first["value"])
    except ValueError:
        lines = False
    reader = spark.read.option("mode", "FAILFAST")
    if lines:
        return reader.schema(ENTRY).json(path)
    fields = ", ".join(f"{n}:{t}" for n, t in (x.split() for x in ENTRY.split(", ")))
    return reader.schema(f"version string, entries array<struct<{fields}>>").json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def write_baseline(entries: DataFrame, path: str) -> None:
    """Entries in order, one JSON object a line."""
    order = ["fingerprint", "positional_fingerprint", "rule", "from_file", "to_file", "line", "message"]
    entries.dropDuplicates(["fingerprint", "positional_fingerprint"]).orderBy(*[F.asc_nulls_first(c) for c in order]).write.mode("overwrite").json(path)


def write_baseline_file(entries: DataFrame, path: str, generated_from: dict | None = None, version: str = "1") -> None:
    """Entries in order as one JSON object with its header, which replaces the file at once or not at all. generated_from: the digests
    of what the baseline was made of. An entry that comes twice is one."""
    order = ["fingerprint", "positional_fingerprint", "rule", "from_file", "to_file", "line", "message"]
    rows = entries.dropDuplicates(["fingerprint", "positional_fingerprint"]).orderBy(*[F.asc_nulls_first(c) for c in order])
    one_object.write(rows, path, {"version": version, "generated_from": generated_from or {}}, "entries")


def write_snapshot(edges: DataFrame, path: str) -> None:
    """Edges (a, b) in order as one trace snapshot."""
    one_object.write(edges.select(F.col("a").alias("from"), F.col("b").alias("to")).distinct().orderBy("from", "to"), path, {"schema_version": "1", "resolutions": []}, "edges")


SNAPSHOT = "schema_version string, edges array<struct<from:string,to:string>>, resolutions array<struct<from:string,import_specifier:string,result_kind:string,resolved_to:string,package_name:string,trace:array<string>>>"
TraceError = traces.TraceError


def trace_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges and (place, from, specifier, kind, target, package) records of trace files: structured ones by their schema, others
    by a walk. place: the file and the record's position in it."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    shaped = rows.select(F.from_json("value", SNAPSHOT).alias("s"), "value", "file")
    structured = F.col("s.schema_version") == "1"
    wrong = shaped.where("s.schema_version is not null and s.schema_version <> '1'")
    if not wrong.isEmpty():
        raise ValueError("a trace must have schema_version 1")
    known = shaped.where(structured)
    free_edges, free = traces.walk(traces.values(shaped.where(~F.coalesce(structured, F.lit(False))).select("file", "value")))
    edges = known.select(F.explode("s.edges").alias("e")).select(F.col("e.from").alias("a"), F.col("e.to").alias("b")).unionByName(free_edges)
    place = F.struct("file", "at").alias("place")
    told = known.select("file", F.posexplode("s.resolutions").alias("i", "r")).withColumn("at", F.array("i")).select(place, F.col("r.from").alias("from"), F.col("r.import_specifier").alias("specifier"), F.col("r.result_kind").alias("kind"), F.col("r.resolved_to").alias("target"), F.col("r.package_name").alias("package"))
    found = told.unionByName(free.select(place, "from", "specifier", "kind", "target", "package"))
    tidy = lambda c: F.regexp_replace(paths.normalised(F.col(c)), "^\\./", "").alias(c)
    return edges.select(tidy("a"), tidy("b")).distinct(), found.select("place", tidy("from"), "specifier", "kind", tidy("target"), "package")


def trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges and (from, specifier) resolutions of trace files."""
    edges, found = trace_records(spark, path)
    return edges, found.select("from", "specifier").distinct()


def write_trace(edges: DataFrame, path: str) -> None:
    """Edges as JSON lines, in order."""
    edges.select(F.col("a").alias("from"), F.col("b").alias("to")).orderBy("from", "to").write.mode("overwrite").json(path)


def workspace_patterns(pnpm: str | None, package_json: str | None) -> list[str]:
    """The package globs of a monorepo's files."""
    out = list((yaml.safe_load(pnpm or "") or {}).get("packages") or [])
    spaces = json.loads(package_json).get("workspaces") if package_json else None
    if isinstance(spaces, dict):
        spaces = spaces.get("packages")
    if spaces is not None and not (isinstance(spaces, list) and all(isinstance(s, str) for s in spaces)):
        raise ValueError("workspaces must be a list of globs, or an object that has one")
    return sorted({p.strip().removeprefix("./").rstrip("/") for p in out + (spaces or []) if p.strip()})


def workspaces(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(directory, module): packages of a monorepo, directories that match a pattern and hold a package.json or sources; ! takes
    directories out. Packages of one name are told apart by their parent's."""
    from pyspark.sql import Window as W

    holds = files.select("path").where(F.col("path").rlike(r"(^|/)package\.json$") | F.col("path").rlike("(^|/)src/[^/]+$"))
    dirs = holds.select(F.regexp_replace("path", r"(/?package\.json|/?src/[^/]+)$", "").alias("directory")).where("directory <> ''").distinct()
    hit, out = F.lit(False), F.lit(False)
    for p in patterns:
        rx = globs.compile_glob(p.removeprefix("!"), separate=True)
        if p.startswith("!"):
            out = out | F.col("directory").rlike(rx)
        else:
            hit = hit | F.col("directory").rlike(rx)
    parts = F.split("directory", "/")
    name, parent = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    rank = F.row_number().over(W.partitionBy("name").orderBy("directory"))
    return dirs.where(hit & ~out).withColumns({"name": name, "parent": parent}).withColumn("rank", rank).select("directory", F.when(F.col("rank") == 1, F.col("name")).otherwise(F.concat_ws("__", "parent", "name")).alias("module"))


# Snapshots of a repository: git runs on the driver and gives rows -----------------------------------------------------


def git(root: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip() or f"git {arguments[0]} failed")
    return done.stdout


def valid_ref(root: str, ref: str) -> str:
    if not ref or ref.startswith("-"):
        raise ValueError(f"no reference: {ref!r}")
    return git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path): files that differ from a reference in the working tree; deleted ones are left out."""
    out = git(root, "diff", "-z", "--name-only", "--diff-filter=ACMRT", valid_ref(root, ref), "--").decode()
    return spark.createDataFrame([(p,) for p in out.split("\0") if p], "path string")


def name_status(raw: str) -> list[tuple[str, str | None, str]]:
    """(status, from_path, to_path) of NUL-separated status output."""
    out, parts = [], [p for p in raw.split("\0")]
    i = 0
    while i < len(parts) and parts[i]:
        status = parts[i][0]
        if status in "AMTD":
            out.append((status, None, parts[i + 1]))
            i += 2
        elif status in "RC":
            out.append((status, parts[i + 1], parts[i + 2]))
            i += 3
        else:
            raise ValueError(f"unknown status {parts[i]!r}")
    return out


def spec_changes(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """(status, from_path, to_path) of spec files between two references."""
    raw = git(root, "diff", "-z", "--name-status", "-M", "-C", valid_ref(root, base), valid_ref(root, head), "--", "*.spec.yml").decode()
    return spark.createDataFrame(name_status(raw), "status string, from_path string, to_path string")


def blobs(root: str, names: list[str]) -> Iterator[bytes]:
    """The contents of objects, in order, by one git process."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
        for name in names:
            process.stdin.write(name.encode() + b"\n")
            process.stdin.flush()
            head = process.stdout.readline().split()
            if len(head) != 3 or head[1] != b"blob":
                raise ValueError(f"no file {name}: {b' '.join(head).decode(errors='replace')}")
            content = process.stdout.read(int(head[2]))
            if len(content) < int(head[2]) or process.stdout.read(1) != b"\n":
                raise ValueError(f"{name} is cut short")
            yield content
        process.stdin.close()


def files_at(spark: SparkSession, root: str, ref: str, pattern: str = "*.spec.yml") -> DataFrame:
    """(path, content) of the files of a reference whose path matches."""
    import fnmatch

    entries = [e.split("\t", 1) for e in git(root, "ls-tree", "-r", "-z", valid_ref(root, ref)).decode().split("\0") if e]
    wanted = [(path, head.split()[2]) for head, path in entries if head.split()[1] == "blob" and fnmatch.fnmatch(path, pattern)]
    contents = blobs(root, [sha for _, sha in wanted])
    return spark.createDataFrame([(path, c.decode(errors="replace")) for (path, _), c in zip(wanted, contents)], "path string, content string")


def paths_at(spark: SparkSession, root: str, ref: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in git(root, "ls-tree", "-r", "-z", "--name-only", valid_ref(root, ref)).decode().split("\0") if p], "path string")
