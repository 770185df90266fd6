"""The language modules as a table function for SQL.

    register(spark)
    SELECT f.file, s.name, s.signature FROM files f, LATERAL parsed(f.file, f.content) s
    SELECT f.file, i.source FROM files f, LATERAL parsed(f.file, f.content, 'imports') i

The third argument, a constant, says what the rows are: symbols (default), imports, skipped or errors; their columns follow
from it when the query is analyzed. Rows have the ordinal that plans.distill gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from ..schemas import DistillOptions
from . import Language, as_row, parse_source, registered_languages, use

#: The columns of each part, by its name in a parsed file's row.
PARTS = {
    "symbols": ("exports", "ord int, name string, type string, signature string, docstring string, visibility string, start_line int, end_line int, members array<struct<name:string,signature:string,type:string>>"),
    "imports": ("imports", "ord int, source string, specifiers array<struct<name:string>>, line int"),
    "skipped": ("skipped", "ord int, name string, reason string, line int"),
    "errors": ("errors", "ord int, message string, line int, severity string"),
}


def table_function(options: DistillOptions | None = None, languages: list[Language] | None = None):
    """The function with its options, made in the driver's session; ``languages``: those of the driver's registry by default."""
    options, languages = replace(options or DistillOptions()), languages or registered_languages()
    schemas = {name: StructType.fromDDL(columns) for name, (_, columns) in PARTS.items()}  # the workers have no session

    class Parse:
        @staticmethod
        def analyze(file: AnalyzeArgument, content: AnalyzeArgument, part: AnalyzeArgument | None = None) -> AnalyzeResult:
            for name, given in (("file", file), ("content", content)):
                if given.dataType.simpleString() not in ("string", "void"):
                    raise ValueError(f"{name} must be a string")
            wanted = "symbols" if part is None else part.value
            if wanted not in PARTS:
                raise ValueError(f"unknown part {wanted!r}; one of {', '.join(PARTS)}")
            return AnalyzeResult(schema=schemas[wanted])

        def __init__(self) -> None:
            use(languages)

        def eval(self, file: str, content: str, part: str = "symbols") -> Iterator[tuple]:
            if file is None:
                return
            row = as_row(file, parse_source(file, content or "", options), options.compat)
            for k, item in enumerate(row[PARTS[part][0]]):
                yield (k, *item.values())

    return udtf(Parse)


def register(spark: SparkSession, name: str = "parsed", options: DistillOptions | None = None) -> None:
    spark.udtf.register(name, table_function(options))
