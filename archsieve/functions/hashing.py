"""Fingerprints and canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a violation's fingerprint, in order. Lines are left out, so that moved code keeps its fingerprint.
CONTENT = ("rule", "severity_name", "message", "from_file", "to_file", "from_module", "to_module")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint_text(parts: list[str | None]) -> str:
    return "sha256:" + sha256_hex("|".join(p or "" for p in parts))


def fingerprint(*parts: Column) -> Column:
    """``sha256:`` and the digest of the parts, joined by ``|``; null counts as empty."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def violation_fingerprint(position: bool = False) -> Column:
    """The fingerprint of a violation's columns; with ``position`` its line and column count too."""
    named = {"severity_name": F.initcap("severity")}
    parts = [named.get(c, F.col(c)) for c in CONTENT]
    return fingerprint(*parts, *([F.col("line"), F.col("col")] if position else []))


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parsed_json(text: Column) -> Column:
    """The JSON value that a text is, as VARIANT; null where it is none, or more than one. The parser stops behind a first value, so the
    text is tried inside a list and inside an object, which must close behind it."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"e":1}')))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & (F.try_variant_get(named, "$.e", "int") == 1)
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all objects in order and no spaces; what stands in arrays keeps its order, and numbers are written as
    they were but for zeros that say nothing. Null where the text is no JSON."""
    return F.to_json(parsed_json(text))


def json_digest(text: Column) -> Column:
    """``sha256:`` and the digest of the canonical JSON, which does not depend on the order of keys."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def of_rows(*columns: str) -> Column:
    """An aggregate: one digest for the named columns of all rows, whatever their order. Only digests meet, never the rows."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(F.to_json(F.struct(*columns)), 256))), ","), 256))
