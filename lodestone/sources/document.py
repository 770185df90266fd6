"""A sink for one text file that many tasks write.

    spark.dataSource.register(DocumentSource)
    parts.pieces(blocks).write.format("document").mode("overwrite").save(path)

Rows are (offset, text): each task writes its texts at their byte offsets into a hidden file beside the path, which a
task that runs again overwrites with the same. Commit checks that the pieces fill the file without a gap and renames it, so
that the path holds the whole document or what it held before; abort removes the hidden file. Without ``overwrite`` an
existing path is an error. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: bytes, and where they end."""

    written: int
    end: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(f"{self.path} exists")
        folder, name = os.path.split(self.path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.part")

    def write(self, iterator: Iterator[Row]) -> Written:
        written = end = 0
        file = os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for offset, text in iterator:
                data = memoryview((text or "").encode())
                written, end, at = written + len(data), max(end, offset + len(data)), offset
                while data:
                    n = os.pwrite(file, data, at)
                    data, at = data[n:], at + n
            os.fsync(file)
        finally:
            os.close(file)
        return Written(written, end)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        written, end = sum(m.written for m in done), max((m.end for m in done), default=0)
        if written != end:
            self.abort(messages)
            raise ValueError(f"pieces of {written} bytes do not fill {end}")
        with open(self.hidden, "ab"):  # no task, no file
            pass
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "offset bigint, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)
