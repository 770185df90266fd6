"""A worker holds only a few parsed files at a time, however large its batches are."""

from __future__ import annotations

import pyarrow as pa

from lodestone import parsers
from lodestone.plans import typing
from lodestone.schemas import DistillOptions


def batches(contents):
    return iter([pa.RecordBatch.from_pydict({"file": [f"f{k}.ts" for k in range(len(contents))], "content": pa.array(contents, pa.string())})])


def test_files_are_given_on_before_the_batch_ends():
    schema, read = pa.schema([("file", pa.string())]), []
    out = parsers.read_rows(batches(["x"] * 1000 + [None]), lambda f, c: read.append((f, c)) or {"file": f}, schema)
    assert next(out).num_rows == len(read) == parsers.HELD_FILES
    assert sum(b.num_rows for b in out) == 1001 - parsers.HELD_FILES and read[-1] == ("f1000.ts", "")
    sizes = [b.num_rows for b in parsers.read_rows(batches(["x" * parsers.HELD_CHARS] * 3 + ["y"] * 2), lambda f, c: {"file": f}, schema)]
    assert sizes == [1, 1, 1, 2]


def test_batches_to_workers_are_bounded(spark):
    keys = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    files = spark.createDataFrame([("a.ts", "export const x = 1;")], "file string, content string")
    for parse in (parsers.parse_files, typing.facts):
        try:
            spark.conf.set(keys[0], "0"), spark.conf.set(keys[1], "64m")
            assert parse(files, DistillOptions()).count() == 1
            assert [spark.conf.get(k) for k in keys] == [str(parsers.BATCH_ROWS), str(parsers.BATCH_BYTES)]
        finally:
            for k, v in zip(keys, before, strict=True):
                spark.conf.set(k, v)
