"""A sink that writes one JSON object: a header, and the rows as a list, a line each.

Tasks write parts beside the file; the commit puts the header and the parts, in the order of the partitions, into a new file and renames it.
A write that fails leaves the old file as it was. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def plain(value: object) -> object:
    """A row as a JSON value; fields that are null are left out."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list) else value


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = os.path.abspath(options["path"].removeprefix("file://"))
        self.header, self.field = json.loads(options.get("header", "{}")), options.get("field", "entries")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Part:
        task = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        path, n = os.path.join(self.parts, f"{task.partitionId()}-{task.taskAttemptId()}"), 0
        with open(path, "w", encoding="utf-8") as out:
            for row in rows:
                out.write(json.dumps(plain(row), ensure_ascii=False) + "\n")
                n += 1
        return Part(task.partitionId(), path, n)

    def commit(self, messages: list[Part | None]) -> None:
        new, first = f"{self.path}.new-{uuid.uuid4().hex}", True
        try:
            with open(new, "w", encoding="utf-8") as out:
                head = json.dumps(self.header, ensure_ascii=False)[1:-1]
                out.write("{" + head + (", " if head else "") + json.dumps(self.field) + ": [")
                for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                    with open(part.path, encoding="utf-8") as lines:
                        for line in lines:  # a line at a time, however large the parts are
                            out.write(("\n" if first else ",\n") + line.rstrip("\n"))
                            first = False
                out.write("\n]}\n")
                out.flush()
                os.fsync(out.fileno())
            os.replace(new, self.path)
        finally:
            if os.path.exists(new):
                os.remove(new)
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class OneObject(DataSource):
    """Options: path, header (a JSON object), field (the list's name)."""

    @classmethod
    def name(cls) -> str:
        return "archsieve_object"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def write(rows: DataFrame, path: str, header: dict, field: str) -> None:
    """The rows, in the order of their partitions, as a list of one JSON object."""
    rows.sparkSession.dataSource.register(OneObject)
    rows.write.format("archsieve_object").mode("append").option("header", json.dumps(header)).option("field", field).save(path)
