"""Deterministic sharded WARC writer and reader.

Records are cut into shards by ranges of their page id, then of a hash of id, payload and url. The bounds come from a sample chosen by a hash of the
ids, so the same pages always give the same shards. Within a shard, records are sorted and streamed
into gzip members; a file is closed when its compressed size passes ``file_bytes``. Files are written
under temporary names; each task reports its files as manifest rows, and only when the manifest is
complete are they renamed. A task that runs twice writes twice under other temporary names, and the
manifest names one of them.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest page id is a response, the others
are revisits of it; exact repetitions of its row are responses too. A null payload is an empty one. Rows without an
id come first; with no other id for their payload they are responses. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, unquote
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import tidy

MANIFEST = "shard int, file string, temporary string, records long, bytes long, sha256 string"
#: Sampled ids for each shard, and most shards: together the bound of what the driver gathers.
SAMPLED, MOST_SHARDS = 20, 20_000
#: The record id of a page without an id; that of others is PAGE and the id, quoted.
NO_PAGE, PAGE = "urn:no-page", "urn:page:"
#: Compressed bytes that the reader takes at a time.
STEP = 8 << 10


def folder_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
    return pyarrow.fs.LocalFileSystem(), uri


def record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + content + b"\r\n\r\n") + z.flush()


def sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def name_of(page: object) -> str:
    return NO_PAGE if page is None else PAGE + quote(str(page), safe="")


def page_record(page: object, url: str | None, body: bytes, refers_to: str | None, date: str) -> bytes:
    """The response or revisit record of one page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    content = http + body if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name_of(page)}>"), ("WARC-Date", date), ("WARC-Target-URI", (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1(body)}"), ("WARC-Block-Digest", f"sha1:{sha1(content)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(body))),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{name_of(refers_to)}>")]
    return record(headers, content)


def spread(page: str = "page_id", digest: str = "digest", url: str = "url") -> Column:
    """What parts the rows of one page id, so that an id that many rows have does not fill one shard."""
    return F.xxhash64(page, digest, url)


def bounds(pages: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page_id, spread) of all shards but the first. pages: (page_id, digest, url, body)."""
    size = pages.agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("rows")).first()
    shards = min(MOST_SHARDS, -(-(size["bytes"] or 0) // shard_bytes))
    if shards < 2:
        return []
    every = max(1, size["rows"] // (SAMPLED * shards))
    keys = pages.select("page_id", spread().alias("s"))
    sample = keys.where(F.pmod(F.xxhash64("page_id", "s"), F.lit(every)) == 0).distinct().orderBy("page_id", "s").collect()
    return list(dict.fromkeys(tuple(sample[i * len(sample) // shards]) for i in range(1, shards))) if sample else []


def write(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the pages (page_id, url, html) below ``folder``; returns the manifest, which is also stored there."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("body")).withColumn("digest", F.sha1("body"))
    kind = rows.schema["page_id"].dataType
    cuts = bounds(rows, shard_bytes)
    lost = [s for page, s in cuts if page is None]  # rows without an id come first
    named = [page for page, _ in cuts if page is not None]
    named = np.array(named, dtype=object if any(isinstance(p, str) for p in named) else None)
    spreads = [s for page, s in cuts if page is not None]

    @F.pandas_udf("int")
    def shard(ids, parts):
        missing = ids.isna().to_numpy()
        out = np.zeros(len(ids), dtype="int32")
        out[missing] = np.searchsorted(lost, parts[missing].to_numpy(), side="right")
        if len(named):
            known, mine = ids[~missing].to_numpy().astype(named.dtype), parts[~missing].to_numpy()
            low, high = np.searchsorted(named, known, side="left"), np.searchsorted(named, known, side="right")
            out[~missing] = len(lost) + low
            for i in np.flatnonzero(high > low):  # the bounds of one id
                out[np.flatnonzero(~missing)[i]] += np.searchsorted(spreads[low[i] : high[i]], mine[i], side="right")
        else:
            out[~missing] = len(lost)
        return pd.Series(out)

    small = rows.where(F.octet_length("body") >= least_bytes).select("page_id", "digest", "url")
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    # revisits travel as narrow rows and meet their page in the shard, just before it in the order
    revisits = small.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    notes = revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.col("first").cast("string").alias("refers_to"), "url", F.lit(None).cast("string").alias("body"))
    whole = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("refers_to"), "url", "body")
    dealt = whole.unionByName(notes).withColumn("spread", spread()).withColumn("shard", shard("page_id", "spread")).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "spread", "digest", "url", "kind")
    attempt = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        mine = uuid.uuid4().hex
        done: list[tuple] = []
        out = None
        note: tuple = ()

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                done.append((out["shard"], out["file"], out["path"], out["records"], out["bytes"], out["sha"].hexdigest()))
            out = None

        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                for page, digest, kind, refers_to, url, body, number in zip(*(c.to_pylist() for c in part.columns)):
                    if kind == 0:
                        note = (page, digest, url, refers_to)
                        continue
                    if out and (out["shard"] != number or out["bytes"] >= file_bytes):
                        close()
                    if not out:
                        serial = sum(d[0] == number for d in done)
                        name = f"pages-{number:05d}-{serial:05d}.warc.gz"
                        fs.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
                        path = f"{base}/_temporary/{attempt}/{mine}-{name}"
                        out = {"shard": number, "file": name, "path": path, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "stream": fs.open_output_stream(path, compression=None)}
                        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out["stream"].write(info)
                        out["sha"].update(info)
                        out["bytes"] += len(info)
                    packed = page_record(page, url, (body or "").encode(), note[3] if note[:3] == (page, digest, url) else None, date)
                    out["stream"].write(packed)
                    out["sha"].update(packed)
                    out["bytes"] += len(packed)
                    out["records"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "file", "temporary", "records", "bytes", "sha256"])

    manifest = f"{folder}/_manifest"
    dealt.select("page_id", "digest", "kind", "refers_to", "url", "body", "shard").mapInArrow(tidy(run), MANIFEST).write.parquet(manifest)
    files = spark.read.schema(MANIFEST).parquet(manifest)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fs.get_file_info(temporary).type != pyarrow.fs.FileType.NotFound:  # else an earlier attempt of this task renamed it
                    fs.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    committed = files.select("file", "temporary").mapInArrow(tidy(commit), "file string").count()
    fs, base = folder_of(folder)
    if fs.get_file_info(f"{base}/_temporary").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{base}/_temporary")  # what is left there are files of attempts that did not count
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/_COMMITTED", compression=None) as f:
        f.write(json.dumps({"files": committed}).encode())
    return files


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file of gzip members."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, raw = zlib.decompressobj(31), b""
        while not z.eof:  # by small steps, for what is left over of a step is copied
            step = view[at : at + STEP]
            if not len(step):
                raise ValueError("a record is cut short")
            raw += z.decompress(step)
            at += len(step)
        at -= len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, folder: str, page_type: T.DataType) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, intact) of all committed records."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    most = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    content = f.read()
                rows: list[tuple] = []
                for headers, block in records(content):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    response = headers["WARC-Type"] == "response"
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, refers = (unquote(name[len(PAGE) + 1 : -1]) if (name := headers.get(k, "")).startswith(f"<{PAGE}") else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    intact = headers["WARC-Block-Digest"] == f"sha1:{sha1(block)}" and (not response or sha1(payload) == digest)
                    rows.append((page, headers["WARC-Target-URI"], payload if response else None, len(payload) if response else int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], refers, intact))
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    raw = files.repartition(min(most, 10_000)).mapInArrow(tidy(run), "page string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers string, intact boolean")
    return raw.select(F.col("page").cast(page_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(page_type).alias("refers_to"), "intact")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
    names = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers", "intact"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
