"""Streams of files. Parsers look at one file at a time, so they work on streams without state; ``symbol_changes`` keeps what
each file had, to take it back when the file comes again."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..parsers import parse_files
from ..schemas import DistillOptions


def parse_stream(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """One row a symbol of each arriving file (file, content)."""
    return parse_files(files, options).select("file", F.inline("exports"))


CHANGE = "change string, file string, ord int, name string, type string, signature string, docstring string, visibility string, start_line int, members array<string>"


def symbol_changes(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """A row a symbol that a file (file, content) has lost (``-``) or gained (``+``) since it came last; a symbol at another line
    is another one. The sum of all rows so far are the symbols of the files as they are now."""
    parsed = parse_files(files, options).select("file", F.to_json(F.transform("exports", lambda e: F.struct(*[e[c].alias(c) for c in ("name", "type", "signature", "docstring", "visibility", "start_line")], F.transform(e["members"], lambda m: m["signature"]).alias("members")))).alias("symbols"))

    def rows(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [x for b in batches for x in b["symbols"]][-1]
        old = state.get[0] if state.exists else "[]"
        state.update((new,))
        told = lambda text: [(k, json.dumps(s, sort_keys=True)) for k, s in enumerate(json.loads(text))]
        before, after = told(old), told(new)
        out = [("-", *x) for x in before if x not in after] + [("+", *x) for x in after if x not in before]
        if out:
            yield pd.DataFrame([_row(change, key[0], k, json.loads(s)) for change, k, s in out])

    return parsed.groupBy("file").applyInPandasWithState(rows, CHANGE, "symbols string", "append", GroupStateTimeout.NoTimeout)


def _row(change: str, file: str, k: int, s: dict) -> dict:
    return {"change": change, "file": file, "ord": k} | {c: s.get(c) for c in ("name", "type", "signature", "docstring", "visibility", "start_line")} | {"members": s.get("members", [])}


def folder(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The files of a folder as they come and change; options as of the corpus source."""
    from ..sources.watch import FolderSource

    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").options(path=path, **options).load()
