"""Specifiers, packages and module names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that the runtime has built in.
BUILTINS = (
    "_http_agent", "_http_client", "_http_common", "_http_incoming", "_http_outgoing", "_http_server", "_stream_duplex", "_stream_passthrough", "_stream_readable", "_stream_transform", "_stream_wrap",
    "_stream_writable", "_tls_common", "_tls_wrap", "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain",
    "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "sea", "sqlite", "stream",
    "string_decoder", "sys", "test", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
)


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?/")


def is_bare(specifier: Column) -> Column:
    return ~specifier.rlike(r"^(\.\.?/|/)")


def is_builtin(specifier: Column) -> Column:
    first = F.regexp_extract(F.regexp_replace(specifier, "^node:", ""), "^([^/]*)", 1)
    return first.isin(*BUILTINS)


def package(specifier: Column) -> Column:
    """The package of a bare specifier, with its scope; null where there is none."""
    name = F.regexp_extract(F.regexp_replace(specifier, "^node:", ""), "^(@[^/]+/[^/]+|[^@./][^/]*)", 1)
    return F.when(name != "", name)


def subpath(specifier: Column) -> Column:
    """What follows the package; null if nothing does."""
    rest = F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^@./][^/]*)/(.+)$", 2)
    return F.when(rest != "", rest)


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")).cast("long")


def first_segment(module: Column) -> Column:
    """The first segment of a module's name that is not blank."""
    return F.element_at(F.filter(F.split(module, "/"), lambda s: F.trim(s) != ""), 1)


def tidy(names: Column) -> Column:
    """Trimmed, without blanks and doubles, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: s != "")))
