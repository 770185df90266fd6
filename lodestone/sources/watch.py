"""A stream of the files of a folder: every file once, and again whenever it has changed.

    spark.dataSource.register(FolderSource)
    spark.readStream.format("folder").option("path", root).load()

An offset is a time of modification, in nanoseconds; a batch has the files that were modified after its start and not after its
end, so a batch that runs again has the same files but for those that have changed since, which the next one brings. A file
that has changed while a batch reads it comes with its newer content in both. Options are those of the corpus source,
without pushdown and max_files, and ``settle_ms`` (0): how old a change must be, for file systems with coarse times. Files
that vanish are not told.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .corpus import CorpusReader, Files, scan


class FolderStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.reader = CorpusReader(options)
        self.root = options["path"]
        self.settle = int(options.get("settle_ms", 0)) * 1_000_000
        self.last = -1

    def changed(self, after: int, upto: int) -> Iterator[tuple[str, int]]:
        for path in scan(self.root, **self.reader.how):
            try:
                at = os.stat(os.path.join(self.root, path)).st_mtime_ns
            except OSError:
                continue
            if after < at <= upto:
                yield path, at

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.settle
        self.last = max((at for _, at in self.changed(self.last, settled)), default=self.last)
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["at"])
        paths = [p for p, _ in self.changed(start["at"], end["at"])]
        return [Files(paths[i : i + self.reader.per]) for i in range(0, len(paths), self.reader.per)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.reader.read(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, file string, size bigint, last_modified timestamp, content string"

    def streamReader(self, schema: StructType) -> FolderStreamReader:
        return FolderStreamReader(dict(self.options))
