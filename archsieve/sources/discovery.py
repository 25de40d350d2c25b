"""A source of files whose partitions are directories.

The driver looks at a few directories only, until there are enough of them for all tasks; each task walks its own. A directory that is
left out is not listed at all. What cannot be read becomes a row with a warning. Links are followed; a file is told by where it lies.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from archsieve.functions import globs, paths

FILES = "path string, length long, content binary, warning string"


@dataclass
class Directory(InputPartition):
    """A directory below the root; whole: with all that lies below it, else its files alone."""

    path: str
    whole: bool


class Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.named = re.compile(options.get("named", ""))
        self.skipped = frozenset(json.loads(options.get("skipped", "[]")))
        self.excluded = [re.compile(rx) for rx in json.loads(options.get("excluded", "[]"))]
        self.contents = options.get("contents", "true") == "true"
        self.least = int(options.get("parts", "64"))

    def left_out(self, path: str, directory: bool) -> bool:
        if directory and path.rpartition("/")[2] in self.skipped:
            return True
        return any(rx.match(path) or (directory and rx.match(path + "/")) for rx in self.excluded)

    def entries(self, at: str) -> tuple[list[str], list[str], list[tuple]]:
        """(directories, files, warnings) right below a directory, in order."""
        directories, files, warnings = [], [], []
        top = os.path.join(self.root, at)
        try:
            found = sorted(os.scandir(top), key=lambda e: e.name)
        except OSError as e:
            return [], [], [self.warning(at, e)]
        for entry in found:
            path = f"{at}/{entry.name}" if at else entry.name
            try:
                directory = entry.is_dir()
                if self.left_out(path, directory):
                    continue
                if not directory:
                    os.stat(entry.path)  # a link to nothing is told here
                    if entry.is_file() and self.named.search(entry.name):
                        files.append(path)
                elif entry.is_symlink() and (os.path.realpath(top) + "/").startswith(os.path.realpath(entry.path) + "/"):
                    warnings.append((path, None, None, "a link to a directory that it lies in"))
                else:
                    directories.append(path)
            except OSError as e:
                warnings.append(self.warning(path, e))
        return directories, files, warnings

    @staticmethod
    def warning(path: str, error: OSError) -> tuple:
        return (path, None, None, error.strerror or type(error).__name__)

    def partitions(self) -> list[Directory]:
        flat, todo = [], deque([""])
        while todo and len(flat) + len(todo) < self.least and len(flat) < self.least:
            at = todo.popleft()
            flat.append(Directory(at, False))
            todo.extend(self.entries(at)[0])
        return flat + [Directory(at, True) for at in todo]

    def read(self, partition: Directory) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            at = todo.pop()
            directories, files, warnings = self.entries(at)
            yield from warnings
            for path in files:
                try:
                    whole = os.path.realpath(os.path.join(self.root, path))
                    content = None
                    if self.contents:
                        with open(whole, "rb") as f:
                            content = f.read()
                    yield (os.path.relpath(whole, self.root) if whole.startswith(self.root + "/") else whole, os.path.getsize(whole), content, None)
                except OSError as e:
                    yield self.warning(path, e)
            if partition.whole:
                todo += reversed(directories)


class Tree(DataSource):
    """Options: path (the root), named (a pattern of files' names), skipped (names of directories), excluded (patterns of paths), contents, parts."""

    @classmethod
    def name(cls) -> str:
        return "archsieve_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> Walk:
        return Walk(self.options)


def local(root: str) -> bool:
    """Whether a root is a path of the file system, which driver and executors share."""
    return root.startswith(("/", "file:/")) or "://" not in root


def tree(spark: SparkSession, root: str, named: str = "", exclude: tuple[str, ...] = (), include_dirs: tuple[str, ...] = (), contents: bool = True, parts: int = 64) -> DataFrame:
    """(path, length, content, warning) of the files below a root whose names match a pattern. A file that is reached twice is one row.
    Directories that discovery leaves out by default, unless included, and those that a glob excludes are never listed."""
    spark.dataSource.register(Tree)
    skipped = sorted(set(paths.SKIPPED) - set(include_dirs))
    excluded = [globs.compile_glob(g) for g in exclude if not any(g == f"**/{d}/**" for d in include_dirs)]
    reader = spark.read.format("archsieve_tree").option("named", named).option("skipped", json.dumps(skipped)).option("excluded", json.dumps(excluded)).option("contents", str(contents).lower()).option("parts", str(parts))
    return reader.load(re.sub("^file:/+", "/", root)).dropDuplicates(["path", "warning"])


def source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...], include_dirs: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(path, content, length) of source files, and (path, warning) of what could not be read."""
    found = tree(spark, root, r"\.(" + "|".join(paths.EXTENSIONS) + ")$", exclude, include_dirs)
    files = found.where("warning is null").select("path", F.decode("content", "UTF-8").alias("content"), "length")
    return files, found.where("warning is not null").select("path", "warning")
