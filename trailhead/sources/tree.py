"""A directory tree as a table: (path, size, content), every regular file, dot files and empty ones too."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trailhead import ship

# Directories that a scan leaves out, at any depth.
IGNORED = [".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor", "out", "dist", "build", "target", "bin", "__pycache__", ".cache"]


def walk(root: str, ignored: set[str], max_depth: int = 0) -> list[str]:
    """Sorted paths below `root`; ignored directories are pruned, links skipped, and errors end the scan."""

    def fail(e: OSError) -> None:
        raise e

    found = []
    for folder, dirs, names in os.walk(root, onerror=fail):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        dirs[:] = [] if max_depth and rel.count("/") + 1 >= max_depth else [d for d in dirs if d not in ignored]
        found += [rel + n for n in names if stat.S_ISREG(os.lstat(os.path.join(folder, n)).st_mode)]
    return sorted(found, key=lambda p: p.encode())


class Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignored = set(options["ignore"].split(",")) if options.get("ignore") is not None else set(IGNORED)
        self.depth = int(options.get("maxdepth", 0))
        self.chunk = int(options.get("chunk", 256))
        self.contents = options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        paths = walk(self.root, self.ignored - {""}, self.depth)
        return [Chunk(paths[i : i + self.chunk]) for i in range(0, max(1, len(paths)), self.chunk)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for p in partition.paths:
            full = os.path.join(self.root, p)
            text = None
            if self.contents:
                with open(full, "rb") as f:
                    text = f.read().decode("utf-8", errors="replace")
            yield p, os.path.getsize(full), text


class TreeSource(DataSource):
    """Format `tree`: options path, ignore (comma-separated; default IGNORED), maxdepth (0: any), chunk, content."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, max_depth: int = 0, content: bool = True) -> DataFrame:
    """The tree must be on a path that driver and executors share. `content=False` reads names only."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("maxdepth", max_depth).option("content", str(content).lower())
    if ignore is not None:
        reader = reader.option("ignore", ",".join(ignore))
    return reader.load(root)


def is_ignored(name: str, ignored: list[str] | None = None) -> bool:
    return name in (IGNORED if ignored is None else ignored)
