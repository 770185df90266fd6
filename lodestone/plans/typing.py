"""Inferred types of TypeScript files, across files.

Each file is read once, row-locally, to its symbols with holes (parsers.ts_types). All else are joins of small tables: modules
to files, passed-on names to the files that declare them, and holes to types. Types that have holes themselves are filled
round by round, as many rounds as the longest chain of imports; holes on a cycle, into packages or without a match are any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import parsers
from ..parsers import ts_lines, ts_types
from ..schemas import DistillOptions
from ..sources.tables import stored

_HOLE = pa.struct([("hole", pa.int32()), ("module", pa.string()), ("name", pa.string()), ("path", pa.string()), ("op", pa.string())])
_VALUE = pa.struct([("name", pa.string()), ("path", pa.string()), ("type", pa.string())])
_ALIAS = pa.struct([("name", pa.string()), ("module", pa.string()), ("target", pa.string())])
_FACTS = [("holes", pa.list_(_HOLE)), ("values", pa.list_(_VALUE)), ("aliases", pa.list_(_ALIAS))]
FACTS = parsers.SCHEMA + ", holes array<struct<hole:int,module:string,name:string,path:string,op:string>>, values array<struct<name:string,path:string,type:string>>, aliases array<struct<name:string,module:string,target:string>>"

EXTENSION = r"(\.d)?\.([mc]?[jt]s|[jt]sx)$"
MARK = "\x01(\\d+)\x02"


def facts(files: DataFrame, options: DistillOptions) -> DataFrame:
    """files (file, content) to a row each: parsed, with holes, values by access path and passed-on names. A source that cannot
    be followed is read by lines and gives nothing to others."""

    def read(file: str, content: str) -> dict:
        try:
            found = ts_types.facts(file, content, options)
        except Exception:  # noqa: BLE001  whatever a source holds
            found = ts_types.Facts(ts_lines.parse(content))
        return parsers.as_row(file, found.parsed, options.compat) | {"holes": found.holes, "values": found.values, "aliases": found.aliases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parsers.read_rows(batches, lambda f, c: read(f or "", c), pa.schema([("file", pa.string()), *parsers._PARTS, *_FACTS]))

    parsers.small_batches(files.sparkSession)
    return files.select("file", "content").mapInArrow(run, FACTS)


def modules(files: DataFrame) -> DataFrame:
    """(module, target): the path that an import names to the file it means; .ts before .tsx, declarations and JavaScript, and a
    file before a folder's index."""
    stem = F.regexp_replace("file", EXTENSION, "")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, (".ts", ".tsx", ".d.ts", ".js"))), F.regexp_extract("file", EXTENSION, 0)), F.lit(0)), F.lit(9))
    keys = F.array_compact(F.array(F.struct(stem.alias("module"), rank.alias("rank")), F.when(stem.rlike("(^|/)index$"), F.struct(F.regexp_replace(stem, "/?index$", "").alias("module"), (rank + 10).alias("rank")))))
    each = files.select("file", F.inline(keys))
    return each.groupBy("module").agg(F.min_by("file", F.struct("rank", "file")).alias("target"))


def origins(declared: DataFrame, passed: DataFrame) -> DataFrame:
    """(file, name, at_file, at_name) of each name that a file exports, with where it is declared. declared: (file, name);
    passed: (file, name, at, target), where the name ``*`` passes on all names but the default."""
    found = stored(declared.select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name")).distinct(), "names")
    if passed.isEmpty():
        return found
    fresh = found
    while not fresh.isEmpty():
        there = fresh.select(F.col("file").alias("at"), F.col("name").alias("there"), "at_file", "at_name")
        star = passed.where("name = '*' AND target = '*'").select("file", "at").join(there.where("there <> 'default'"), "at").select("file", F.col("there").alias("name"), "at_file", "at_name")
        named = passed.where("target <> '*'").withColumnRenamed("target", "there").join(there, ["at", "there"]).select("file", "name", "at_file", "at_name")
        more = star.unionByName(named).join(found.select("file", "name"), ["file", "name"], "left_anti")
        fresh = stored(more.groupBy("file", "name").agg(F.min(F.struct("at_file", "at_name")).alias("o")).select("file", "name", "o.*"), "names")
        found = found.unionByName(fresh)
    return found


def widened(t: Column) -> Column:
    return F.when(t.rlike(r"^-?\d[\d_.eE+-]*$"), "number").when(t.rlike("^('[^']*'|\"[^\"]*\")$"), "string").when(t.isin("true", "false"), "boolean").otherwise(t)


def filled(t: Column, fills: Column) -> Column:
    """The text with its holes filled (a map from their numbers); those without a filling are any."""
    put = F.aggregate(F.map_entries(fills), t, lambda text, e: F.replace(text, F.concat(F.lit("\x01"), e["key"].cast("string"), F.lit("\x02")), e["value"]))
    return F.regexp_replace(F.coalesce(put, t), MARK, ts_types.ANY)


def fillings(facts: DataFrame) -> DataFrame:
    """(file, hole, text) of all holes that have a type."""
    values = facts.select("file", F.inline("values"))
    target = modules(facts.select("file"))
    passed = facts.select("file", F.inline("aliases")).join(target.withColumnRenamed("target", "at"), "module")
    passed = stored(passed.select("file", "name", "at", "target"), "passed")
    names = origins(values.select("file", "name"), passed)
    holes = facts.select("file", F.inline("holes")).join(target, "module").select("file", "hole", "path", "op", F.col("target").alias("of"), "name")
    at = names.select(F.col("file").alias("of"), "name", "at_file", "at_name")
    types = values.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), "path", "type")
    links = stored(holes.join(at, ["of", "name"]).join(types, ["at_file", "at_name", "path"]).select("file", "hole", "op", "at_file", "type"), "links")
    sums = lambda t: F.when(t.isin("number", "string"), t).otherwise(ts_types.ANY)
    text = lambda t: F.when(F.col("op") == "widen", widened(t)).when(F.col("op") == "plus", sums(widened(t))).otherwise(t)
    whole = F.instr("type", "\x01") == 0
    known = fresh = stored(links.where(whole).select("file", "hole", text(F.col("type")).alias("text")), "known")
    waiting = links.where(~whole).withColumn("asks", F.array_distinct(F.regexp_extract_all("type", F.lit(MARK), F.lit(1))))
    while not fresh.isEmpty():
        given = known.select(F.col("file").alias("at_file"), F.col("hole").alias("ask"), "text")
        asked = waiting.join(known.select("file", "hole"), ["file", "hole"], "left_anti").withColumn("ask", F.explode("asks")).withColumn("ask", F.col("ask").cast("int"))
        got = asked.join(given, ["at_file", "ask"]).groupBy("file", "hole").agg(F.map_from_entries(F.collect_list(F.struct("ask", "text"))).alias("fills"), F.first("type").alias("type"), F.first("op").alias("op"), F.first(F.size("asks")).alias("n"))
        fresh = stored(got.where("size(fills) = n").select("file", "hole", text(filled(F.col("type"), F.col("fills"))).alias("text")), "known")
        known = known.unionByName(fresh)
    return known


def infer(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """TypeScript and JavaScript files (file, content) to rows like parsers.parse_files', with inferred types."""
    found = stored(facts(files, options or DistillOptions()), "facts")
    fills = fillings(found).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("hole", "text"))).alias("fills"))
    member = lambda m: m.withField("signature", filled(m["signature"], F.col("fills")))
    export = lambda e: e.withField("signature", filled(e["signature"], F.col("fills"))).withField("members", F.transform(e["members"], member))
    return found.join(fills, "file", "left").select("file", "imports", F.transform("exports", export).alias("exports"), "skipped", "errors")
