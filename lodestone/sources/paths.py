"""A data source of listed paths: files as they are, folders scanned, what is neither as an error row.

    spark.dataSource.register(PathsSource)
    spark.read.format("paths").option("paths", "a.txt\\nsrc").load()

Options: paths (a line each), max_files (1000, over all paths together; folders get what is left when their turn comes), and those
of the corpus source but max_files. Rows have path, file (relative to ``base``, the working folder by default), size,
last_modified, content and ord, or error alone.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .corpus import CorpusReader, scan


def listed(paths: list[str], max_files: int, how: dict) -> tuple[list[str], list[str]]:
    """Absolute files in the order of the paths, and errors."""
    files: list[str] = []
    errors = []
    for p in paths:
        full = os.path.abspath(p)
        if not os.path.exists(full):
            errors.append(f"Path not found: {p}")
        elif os.path.isfile(full):
            files.append(full)
        elif os.path.isdir(full):
            if not os.access(full, os.R_OK | os.X_OK):
                errors.append(f"Failed to scan directory {p}: permission denied")
                continue
            files += [os.path.join(full, x) for x in islice(scan(full, **how), max(0, max_files - len(files)))]
        else:
            errors.append(f"Not a file or directory: {p}")
    return files[:max_files], errors


class Part(InputPartition):
    def __init__(self, files: list[tuple[int, str]], errors: list[str]):
        super().__init__(0)
        self.files, self.errors = files, errors


class PathsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        reader = CorpusReader({**options, "path": ""})
        self.how, self.per, self.content = reader.how, reader.per, reader.content
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.max_files = int(options.get("max_files", 1000))
        self.base = options.get("base") or os.getcwd()

    def partitions(self) -> list[InputPartition]:
        files, errors = listed(self.paths, self.max_files, self.how)
        numbered = list(enumerate(files))
        return [Part([], errors), *[Part(numbered[i : i + self.per], []) for i in range(0, len(numbered), self.per)]]

    def read(self, partition: Part) -> Iterator[tuple]:
        for e in partition.errors:
            yield None, None, None, None, None, None, e
        for k, full in partition.files:
            name = os.path.relpath(full, self.base)
            try:
                stat = os.stat(full)
                data = None
                if self.content:
                    with open(full, "rb") as f:
                        data = f.read().decode("utf-8", "replace")
            except OSError as e:
                yield full, name, None, None, None, k, f"Failed to read {name}: {e.strerror}"
                continue
            yield full, name, stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC), data, k, None


class PathsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paths"

    def schema(self) -> str:
        return "path string, file string, size bigint, last_modified timestamp, content string, ord int, error string"

    def reader(self, schema: StructType) -> PathsReader:
        return PathsReader(dict(self.options))


def collect(spark: SparkSession, paths: list[str], **options: str) -> tuple[DataFrame, DataFrame]:
    """The files, and the errors (error) of paths that are no file or folder, or cannot be read."""
    spark.dataSource.register(PathsSource)
    rows = spark.read.format("paths").options(paths="\n".join(paths), **options).load()
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("error")
