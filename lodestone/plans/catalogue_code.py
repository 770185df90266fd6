"""Queries over source files that are made from the documents' own words, and the same in SQL: declarations as they are
written, inferred types across files, snapshots with renames.

A document's words decide how many members its class and its enum have, what they are called and what its functions
return; its id, which files it imports from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots
from ..schemas import DistillOptions
from ..sources import virtual
from . import distill, parts, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def names(text: Column) -> Column:
    """The distinct ASCII words of a text in order, as names."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), F.lit(0))))
    return F.transform(words, lambda w: F.concat(F.lit("k_"), w))


NAMES = """named AS (
    SELECT doc_id, lang, list_transform(list_sort(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'))), lambda w: 'k_' || w) AS k
    FROM documents)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("id"), "lang", names(F.col("text")).alias("k"))


def joined(items: Column, each: Callable[[Column], Column], sep: str = "") -> Column:
    return F.array_join(F.transform(items, each), sep)


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module with a namespace in a namespace: an enum and a class with a member for each word, a let and a re-export."""
    method = lambda w: F.concat(F.lit("      async "), w, F.lit("(a: string, n = 1): Promise<T> { return this.x; }\n"))
    member = lambda w: F.concat(w, F.lit(" = '"), F.substring(w, 3, 100_000), F.lit("'"))
    source = F.concat(
        F.lit("import { Base } from './base';\nexport namespace Outer"), "id", F.lit(" {\n  namespace Inner {\n    export class C"), "id", F.lit("<T extends Base> extends Base implements I<T> {\n      constructor(private readonly x: T) { super(); }\n      private hidden = 1;\n"),
        joined(F.col("k"), method), F.lit("    }\n  }\n  export enum E"), "id", F.lit(" { "), joined(F.col("k"), member, ", "), F.lit(" }\n}\nexport let "), F.lit("lang"), "id", F.lit(": string = '"), "lang", F.lit("', more = 2;\nexport { C"), "id", F.lit(" as D"), "id", F.lit(" };\n"),
    )
    return documents(spark, sf_dir).select(F.concat(F.lit("src/n"), "id", F.lit(".ts")).alias("file"), source.alias("content"))


@query(f"""WITH {NAMES}, rows AS (
    SELECT doc_id, unnest([0, 1, 2, 3]) AS ord, unnest(['C', 'E', 'lang', 'D']) || doc_id AS name, unnest(['class', 'enum', 'const', 'const']) AS type,
        unnest(['class C' || doc_id || '<T extends Base> extends Base implements I<T>',
            'enum E' || doc_id || ' {{ ' || array_to_string(list_transform(k, lambda w: w || ' = ''' || w[3:] || ''''), ', ') || ' }}',
            'let lang' || doc_id || ': string = ''' || lang || '''', 'export {{ D' || doc_id || ' }}']) AS signature,
        unnest([array_to_string(['constructor(private readonly x: T)'] || list_transform(k, lambda w: 'async ' || w || '(a: string, n = 1): Promise<T>'), '; '), '', '', '']) AS members
    FROM named)
    SELECT 'src/n' || doc_id || '.ts' AS file, ord, name, type, signature, members FROM rows""")
def q_typescript_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = distill.symbols(distill.parse(nested_files(spark, sf_dir), DistillOptions(types="written")))
    return s.select("file", "ord", "name", "type", "signature", F.array_join(F.transform("members", lambda m: m["signature"]), "; ").alias("members"))


def importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth file declares values by its words: limit is a number or a string, box an object with a field for each word;
    the next three take them on, over an import, a star export and a renamed one."""
    of = F.col("id").cast("long")
    back = (of - 1).cast("string")
    fields = joined(F.col("k"), lambda w: F.concat(w, F.lit(": "), F.when(F.length(w) % 2 == 0, "1").otherwise("'s'")), ", ")
    first = F.concat(F.lit("export const limit = "), F.when(F.size("k") % 2 == 0, F.size("k").cast("string")).otherwise(F.lit("'odd'")), F.lit(";\nexport const box = { "), fields, F.lit(" };\nexport function start() { return limit; }\n"))
    second = F.concat(F.lit("import { start, box } from './i"), back, F.lit("';\nexport * from './i"), back, F.lit("';\nexport function next(n = 1) { const q = start(); return q; }\nexport const all = () => [box];\n"))
    third = F.concat(F.lit("import { next, limit as most } from './i"), back, F.lit("';\nexport { all as every } from './i"), back, F.lit("';\nexport async function more() { return next(); }\nexport const plus = () => most + 1;\n"))
    fourth = F.concat(F.lit("import { more, every } from './i"), back, F.lit("';\nimport pkg from 'pkg';\nexport async function last() { const v = await more(); return v; }\nexport const boxes = () => every();\nexport const other = () => pkg.x;\n"))
    source = F.when(of % 4 == 0, first).when(of % 4 == 1, second).when(of % 4 == 2, third).otherwise(fourth)
    return documents(spark, sf_dir).select(F.concat(F.lit("src/i"), "id", F.lit(".ts")).alias("file"), source.alias("content"))


@query(f"""WITH {NAMES}, typed AS (
        SELECT doc_id, k, CASE WHEN len(k) % 2 = 0 THEN 'number' ELSE 'string' END AS t, CASE WHEN len(k) % 2 = 0 THEN len(k)::VARCHAR ELSE '''odd''' END AS literal,
            CASE WHEN len(k) = 0 THEN '{{}}' ELSE '{{ ' || array_to_string(list_transform(k, lambda w: w || ': ' || CASE WHEN len(w) % 2 = 0 THEN 'number' ELSE 'string' END || ';'), ' ') || ' }}' END AS box,
            '{{ ' || array_to_string(list_transform(k, lambda w: w || ': ' || CASE WHEN len(w) % 2 = 0 THEN '1' ELSE '''s''' END), ', ') || ' }}' AS written
        FROM named WHERE doc_id % 4 = 0),
    d AS (SELECT n.doc_id, n.doc_id % 4 AS step, coalesce(t, 'any') AS t, literal, coalesce(box, 'any') AS box, regexp_replace(written, '\\s+', ' ', 'g') AS written
        FROM named n LEFT JOIN typed ON typed.doc_id = n.doc_id - n.doc_id % 4
            AND NOT EXISTS (SELECT 1 FROM range(1, n.doc_id % 4) r(j) WHERE n.doc_id - j NOT IN (SELECT doc_id FROM named))),
    rows AS (
        SELECT doc_id, unnest([0, 1, 2]) AS ord, unnest(['start', 'box', 'limit']) AS name, unnest(['function start(): ' || t, 'const box: ' || box || ' = ' || written, 'const limit: ' || literal || ' = ' || literal]) AS signature FROM d WHERE step = 0
        UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['next', '*', 'all']), unnest(['function next(n?: number): ' || t, 'export * from ''./i' || (doc_id - 1) || '''', 'const all: () => ' || box || '[] = () => [box]']) FROM d WHERE step = 1
        UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['more', 'every', 'plus']), unnest(['async more(): Promise<' || t || '>', 'export {{ all as every }} from ''./i' || (doc_id - 1) || '''', 'const plus: () => ' || t || ' = () => most + 1']) FROM d WHERE step = 2
        UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['last', 'boxes', 'other']), unnest(['async last(): Promise<' || t || '>', 'const boxes: () => ' || CASE WHEN box = 'any' THEN 'any' ELSE box || '[]' END || ' = () => every()', 'const other: () => any = () => pkg.x']) FROM d WHERE step = 3)
    SELECT 'src/i' || doc_id || '.ts' AS file, ord, name, signature FROM rows""")
def q_typescript_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.symbols(distill.parse(importing_files(spark, sf_dir), DistillOptions(types="inferred"))).select("file", "ord", "name", "signature")


# -- locale order


@query("""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS name FROM documents)
    SELECT row_number() OVER (ORDER BY name COLLATE de, name) - 1 AS place, name FROM words""")
def q_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts as folders of a tree: upper and lower case and accents side by side."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]+"), F.lit(0))).alias("name")).distinct()
    nodes = tree.skeleton(words.select(F.concat("name", F.lit("/f.txt")).alias("file"))).where("NOT is_file")
    return parts.numbered(nodes.select(F.col("key").alias("ord"), F.col("name").alias("block"))).select("place", F.col("block").alias("name"))


# -- snapshots


def two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents by path, before and after: by id they stay, change, go, move, or move with a line more; some are new."""
    docs = virtual.documents(spark, sf_dir)
    step, place = F.col("ord") % 5, F.col("ord").cast("string")
    file = F.when(step == 3, F.concat(F.lit("moved/"), place)).when(step == 4, F.concat(F.lit("edited/"), place)).otherwise(F.col("file"))
    text = F.when(step.isin(1, 4), F.concat("content", F.lit("\n#"), place)).otherwise(F.col("content"))
    after = docs.where(step != 2).select(file.alias("file"), text.alias("content"))
    new = docs.where("ord % 10 = 0").select(F.concat(F.lit("new/"), place).alias("file"), F.concat(F.lit("new\n"), place).alias("content"))
    return docs.select("file", "content"), after.unionByName(new)


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS step, source || '/' || lang || '/' || doc_id || '.txt' AS file, coalesce(text, '') AS t FROM documents),
    old AS (SELECT file, t, row_number() OVER (PARTITION BY t ORDER BY file) AS k FROM d WHERE step IN (2, 3, 4)),
    new AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file) AS k FROM (
        SELECT CASE step WHEN 3 THEN 'moved/' ELSE 'edited/' END || doc_id AS file, CASE WHEN step = 4 THEN t || chr(10) || '#' || doc_id ELSE t END AS t FROM d WHERE step IN (3, 4)
        UNION ALL SELECT 'new/' || doc_id, 'new' || chr(10) || doc_id FROM d WHERE doc_id % 10 = 0)),
    pairs AS (SELECT old.file AS old_file, new.file AS new_file FROM old FULL JOIN new USING (t, k))
    SELECT 'modified' AS status, file, NULL AS old_file FROM d WHERE step = 1
    UNION ALL SELECT CASE WHEN new_file IS NULL THEN 'deleted' WHEN old_file IS NULL THEN 'added' ELSE 'renamed' END, coalesce(new_file, old_file), CASE WHEN new_file IS NOT NULL THEN old_file END FROM pairs""")
def q_snapshot_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.compare(*two_snapshots(spark, sf_dir), similar=None).select("status", "file", "old_file")


def q_snapshot_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness by lines has no SQL of bearable cost; tests hold it against brute force."""
    return snapshots.compare(*two_snapshots(spark, sf_dir), similar=50)


QUERIES["q_snapshot_renames"] = q_snapshot_renames
