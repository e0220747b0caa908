"""A Python data source for trees of source files: format("source_tree").

Options: path; suffixes (comma-separated, default all that a language claims); max_bytes; batch (files per
partition); prune_root (whether the rules for folder names apply to the root as well).  Folders that begin
with a dot and dependency folders are not entered, links are not followed, and what is too large or can't
be read is left out, all before a file is opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES = 4 << 20
PRUNED = frozenset({"node_modules", "vendor", "dist"})


@dataclass
class Batch(InputPartition):
    files: list[tuple[str, str]]


def listed(root: str, suffixes: set[str], max_bytes: int = MAX_BYTES, prune_root: bool = True, pruned: frozenset[str] = PRUNED) -> Iterator[tuple[str, str]]:
    """(relative path, full path) in the order of names."""
    root = os.path.abspath(root)
    name = os.path.basename(root)
    if prune_root and (name.startswith(".") or name in pruned):
        return
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in pruned and not os.path.islink(os.path.join(folder, f)))
        for n in sorted(names):
            full = os.path.join(folder, n)
            if os.path.splitext(n)[1].lower() not in suffixes or os.path.islink(full):
                continue
            try:
                if os.path.getsize(full) > max_bytes:
                    continue
            except OSError:
                continue
            yield os.path.relpath(full, root).replace(os.sep, "/"), full


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        from ..operators.languages import by_extension

        self.root = options["path"]
        given = options.get("suffixes")
        self.suffixes = {s.strip().lower() for s in given.split(",")} if given else set(by_extension())
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.batch = int(options.get("batch", 200))
        self.prune_root = str(options.get("prune_root", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = list(listed(self.root, self.suffixes, self.max_bytes, self.prune_root))
        return [Batch(files[k : k + self.batch]) for k in range(0, len(files), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for rel, full in partition.files:
            try:
                with open(full, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield rel, data.decode("utf-8", "replace"), len(data)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string, size bigint"

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)


def read_remote_tree(spark: SparkSession, root: str, suffixes: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, size) of a tree on a file system that Arrow opens (``hdfs://...``, ``s3://...``), by the same rules.

    The driver lists the root's own entries; every folder in it is walked and read by a task.
    """
    from ..operators.languages import by_extension

    wanted = {s.strip().lower() for s in suffixes.split(",")} if suffixes else set(by_extension())
    enters = lambda name: not name.startswith(".") and name not in PRUNED
    files, base = fs.FileSystem.from_uri(root)
    top = [(e.path, True) for e in files.get_file_info(fs.FileSelector(base)) if e.type == fs.FileType.Directory and enters(e.base_name)]
    folders = spark.createDataFrame([(base, False), *top], "folder string, deep boolean")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, home = fs.FileSystem.from_uri(root)
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                todo = [folder]
                while todo:
                    for e in own.get_file_info(fs.FileSelector(todo.pop())):
                        if e.type == fs.FileType.Directory:
                            todo.extend([e.path] * (deep and enters(e.base_name)))
                        elif e.size <= max_bytes and os.path.splitext(e.base_name)[1].lower() in wanted:
                            try:
                                with own.open_input_file(e.path) as f:
                                    data = f.read()
                            except OSError:
                                continue
                            rel = e.path[len(home.rstrip("/")) + 1 :]
                            yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64())], names=["path", "content", "size"])

    return folders.repartition(max(1, len(top))).mapInArrow(read, "path string, content string, size bigint")


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, content, size) of a tree: local ones by the data source, others (``hdfs://...``) folder by folder in tasks."""
    if "://" in root and not root.startswith("file://"):
        return read_remote_tree(spark, root, options.get("suffixes"), int(options.get("max_bytes", MAX_BYTES)))
    root = root.removeprefix("file://")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(root)
