"""More queries of the reference's operators, and the same in SQL: documents in all formats, pickers, names and the rest.

A document is one text, so the queries make one for each hundred files (``package``). JSON documents are read back into
rows, which SQL can make, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import languages as L
from ..functions import text as T
from ..operators import changes as C
from ..operators import globs
from ..operators import selector as S
from ..schemas import CombineOptions, DistillOptions, Metadata, TreeOptions
from ..sources import virtual
from . import combine, distill, parts, render, tree
from .catalogue import CHANGES, DOCS, NAMED, PICKER, SHOWN, _picker, named, python_files, shown_changes, ts_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NL = "chr(10)"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def number_in(file: Column) -> Column:
    return F.regexp_extract(file, r"(\d+)\.[a-z.]+$", 1).cast("long")


def package(number: Column) -> Column:
    return F.floor(number / 100).cast("long").alias("package")


# -- extract


def packed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with full contents where the rule shows them, renamed files with their old names."""
    shown, _ = shown_changes(spark, sf_dir)
    old = F.when(F.col("status") == "renamed", F.concat(F.lit("old/"), "file"))
    return shown.withColumn("old_file", old).withColumn("package", package(F.col("ord")))


FORMATTED = f"array_to_string(list_transform(string_split(diff, {NL}), lambda l: CASE WHEN l[1] IN ('+', '-') THEN l[1] || ' ' || substr(l, 2) ELSE '  ' || l END), {NL})"
PACKED = f"{SHOWN}, packed AS (SELECT *, (ord // 100)::BIGINT AS package, {FORMATTED} AS formatted, CASE WHEN status = 'renamed' THEN 'old/' || file END AS old_file FROM shown)"
ESTIMATE = "ceil((sum(length(diff)) + sum(CASE WHEN is_full THEN length(content) ELSE 0 END)) / 4.0)::BIGINT"
ABOUT = Metadata("2024-01-01T00:00:00.000Z", "code", "main", "abc1234", "staged", "src/*", ["py", "ts"])


@query(f"""WITH {PACKED}, blocks AS (
        SELECT package, ord, '    <file>' || {NL} || '      <path>' || file || '</path>' || {NL} || '      <status>' || status || '</status>' || {NL}
            || '      <additions>' || additions || '</additions>' || {NL} || '      <deletions>' || deletions || '</deletions>' || {NL}
            || CASE WHEN old_file IS NOT NULL THEN '      <old_path>' || old_file || '</old_path>' || {NL} ELSE '' END
            || CASE WHEN is_full THEN '      <content language="txt">' || {NL} || '<![CDATA[' || content || ']]>' || {NL} || '      </content>' || {NL}
                    WHEN diff <> '' THEN '      <diff>' || {NL} || '<![CDATA[' || formatted || ']]>' || {NL} || '      </diff>' || {NL} ELSE '' END
            || '    </file>' AS block FROM packed)
    SELECT package, '<code_context>' || {NL} || '  <changes>' || {NL} || string_agg(block, {NL} ORDER BY ord) || {NL} || '  </changes>' || {NL} || '</code_context>' AS document FROM blocks GROUP BY package""")
def q_extract_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract_txt(packed_changes(spark, sf_dir), ["package"])


@query(f"""WITH {PACKED}, blocks AS (
        SELECT *, {NL} || '### ' || file || CASE WHEN status = 'renamed' THEN ' (renamed from ' || old_file || ')' ELSE '' END
            || CASE WHEN is_full THEN {NL} || '```txt' || {NL} || content || {NL} || '```' WHEN diff <> '' THEN {NL} || '```diff' || {NL} || formatted || {NL} || '```' ELSE '' END AS block FROM packed)
    SELECT package, '## Metadata' || {NL} || '- **Generated:** 2024-01-01T00:00:00.000Z' || {NL} || '- **Repository:** code (main)' || {NL} || '- **Commit:** abc1234' || {NL} || '- **Extraction Method:** staged'
        || {NL} || '- **Filters:**' || {NL} || '  - Path: src/*' || {NL} || '  - Types: py, ts' || {NL} || '- **Estimated Tokens:** ~' || format('{{:,}}', {ESTIMATE}) || {NL} || '- **lodestone Version:** 0.2.0' || {NL} || {NL}
        || '## Scope' || {NL} || '- **Files Changed:** ' || count(*) || {NL} || '- **Lines:** +' || sum(additions)::BIGINT || ' -' || sum(deletions)::BIGINT || {NL} || {NL}
        || '## Changes' || {NL} || string_agg(block, {NL} ORDER BY ord) AS document
    FROM blocks GROUP BY package""")
def q_extract_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, by = packed_changes(spark, sf_dir), ["package"]
    about = C.scope(shown, by).join(C.token_estimate(shown, by), by)
    return render.extract_md(shown, about, render.metadata_column(ABOUT, F.col("estimated")), by)


@query(f"""WITH {PACKED}, sums AS (SELECT package, count(*) AS files_changed, sum(additions)::BIGINT AS lines_added, {ESTIMATE} AS estimated FROM packed GROUP BY package)
    SELECT package, file, status, additions::BIGINT AS additions, deletions::BIGINT AS deletions, old_file, md5(diff) AS diff, CASE WHEN is_full THEN md5(content) END AS full_content, files_changed, lines_added, estimated, 'code main abc1234 staged src/* py,ts' AS about
    FROM packed JOIN sums USING (package)""")
def q_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, by = packed_changes(spark, sf_dir), ["package"]
    about = C.scope(shown, by).join(C.token_estimate(shown, by), by)
    documents = render.extract_json(shown, about, render.metadata_struct(ABOUT, F.col("estimated")), by)
    item = "struct<file:string,status:string,additions:bigint,deletions:bigint,oldFile:string,diff:string,fullContent:string>"
    meta = "struct<repository:struct<name:string,branch:string,commit:string>,extraction:struct<method:string,filters:struct<path:string,type:array<string>>>,tokens:struct<estimated:bigint>>"
    read = documents.select("package", F.from_json("document", f"scope struct<filesChanged:bigint,linesAdded:bigint>, changes array<{item}>, metadata {meta}").alias("d"))
    m = lambda name: F.col(f"d.metadata.{name}")
    text = F.concat_ws(" ", m("repository.name"), m("repository.branch"), m("repository.commit"), m("extraction.method"), m("extraction.filters.path"), F.array_join(m("extraction.filters.type"), ","))
    rows = read.select("package", F.explode("d.changes").alias("c"), F.col("d.scope.filesChanged").alias("files_changed"), F.col("d.scope.linesAdded").alias("lines_added"), m("tokens.estimated").alias("estimated"), text.alias("about"))
    return rows.select("package", "c.file", "c.status", "c.additions", "c.deletions", F.col("c.oldFile").alias("old_file"), F.md5("c.diff").alias("diff"), F.md5("c.fullContent").alias("full_content"), "files_changed", "lines_added", "estimated", "about")


# -- combine


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.conversations(spark, sf_dir).withColumn("ord", F.struct("turn", "role", "content"))


@query(f"""SELECT conv_id, '# Code Context' || {NL} || {NL} || string_agg('## conv/' || conv_id || '/' || turn || '_' || role || '.md' || {NL} || {NL} || '```markdown' || {NL}
        || CASE WHEN text <> '' THEN text || {NL} ELSE '' END || '```' || {NL}, {NL} ORDER BY turn, role, text) || {NL} AS document FROM conversations GROUP BY conv_id""")
def q_combine_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.combine_md(turns(spark, sf_dir), ["conv_id"])


@query(f"""WITH f AS (SELECT conv_id, 'conv/' || conv_id || '/' || turn || '_' || role || '.md' AS path, text, len(string_split(text, {NL})) AS n FROM conversations)
    SELECT conv_id, path, 'added' AS status, md5(text) AS content, n::BIGINT AS additions, count(*) OVER (PARTITION BY conv_id) AS total_files, (sum(n) OVER (PARTITION BY conv_id))::BIGINT AS total_additions FROM f""")
def q_combine_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = combine.as_changes(turns(spark, sf_dir)).withColumn("conv_id", F.regexp_extract("file", r"^conv/(\d+)/", 1).cast("long"))
    read = render.combine_json(rows, ["conv_id"]).select("conv_id", F.from_json("document", "files array<struct<path:string,status:string,content:string,additions:bigint>>, metadata struct<totalFiles:bigint,totalAdditions:bigint>").alias("d"))
    rows = read.select("conv_id", F.explode("d.files").alias("f"), F.col("d.metadata.totalFiles").alias("total_files"), F.col("d.metadata.totalAdditions").alias("total_additions"))
    return rows.select("conv_id", "f.path", "f.status", F.md5("f.content").alias("content"), "f.additions", "total_files", "total_additions")


# -- distill


def packed_python(spark: SparkSession, sf_dir: str, options: DistillOptions | None = None) -> tuple[DataFrame, DataFrame]:
    files = python_files(spark, sf_dir)
    return files, distill.parse(files, options).withColumn("package", package(number_in(F.col("file"))))


MODULE = "'src/m' || doc_id || '.py'"
IMPORTS = f"'import ''os''' || {NL} || 'import ''m' || doc_id || '''' || {NL}"


@query(f"""SELECT (doc_id // 100)::BIGINT AS package, string_agg('## ' || {MODULE} || {NL} || {NL} || '```python' || {NL} || {IMPORTS} || 'def f' || doc_id || '(p, q=2) -> int' || {NL}
        || 'LIMIT_' || doc_id || ' = ' || doc_id || {NL} || 'class C' || doc_id || '(Base, M)' || {NL} || '```', {NL} || {NL} ORDER BY {MODULE}) AS document FROM documents GROUP BY ALL""")
def q_distill_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.distill_md(packed_python(spark, sf_dir)[1], by=["package"])


SOURCE = f"""'import os' || {NL} || 'from m' || doc_id || ' import a, b as c' || {NL} || 'LIMIT_' || doc_id || ' = ' || doc_id || {NL} || '_hidden = 1' || {NL} || 'class C' || doc_id || '(Base, M):' || {NL}
    || '    def __init__(self, x):' || {NL} || '        self.x = x' || {NL} || '    def run(self, y: int = 1) -> str:' || {NL} || '        return y' || {NL} || '    async def go(self): pass' || {NL} || 'def f' || doc_id || '(p, q=2) -> int:' || {NL} || '    return p' || {NL} || 'def _g(): pass' || {NL}"""
TOKENS = f"""tokens AS (SELECT doc_id, ceil(length({SOURCE}) / 4.0)::BIGINT AS o,
    (ceil((20 + length(doc_id::VARCHAR)) / 4.0) + ceil((9 + 2 * length(doc_id::VARCHAR)) / 4.0) + ceil((16 + length(doc_id::VARCHAR)) / 4.0) + 7 + 4)::BIGINT AS d FROM documents)"""


@query(f"""WITH {TOKENS}, sums AS (SELECT doc_id // 100 AS package, count(*) AS file_count, sum(o)::BIGINT AS original_tokens, sum(d)::BIGINT AS distilled_tokens FROM tokens GROUP BY 1)
    SELECT (doc_id // 100)::BIGINT AS package, {MODULE} AS path, 'os m' || doc_id AS imports, 'f' || doc_id || ' LIMIT_' || doc_id || ' C' || doc_id AS exports, 'run go' AS members, file_count, original_tokens, distilled_tokens,
           floor((original_tokens - distilled_tokens) * 100.0 / original_tokens + 0.5)::BIGINT AS compression_ratio, file_count AS python_files
    FROM documents JOIN sums ON doc_id // 100 = package""")
def q_distill_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, parsed = packed_python(spark, sf_dir)
    documents = render.distill_json(parsed, distill.metrics(files, parsed, ["package"]), by=["package"])
    export = "struct<name:string,type:string,members:array<struct<name:string>>>"
    meta = "struct<fileCount:bigint,originalTokens:bigint,distilledTokens:bigint,compressionRatio:bigint,languages:map<string,bigint>>"
    read = documents.select("package", F.from_json("document", f"files array<struct<path:string,imports:array<string>,exports:array<{export}>>>, metadata {meta}").alias("d"))
    m = F.col("d.metadata")
    rows = read.select("package", F.explode("d.files").alias("f"), m["fileCount"].alias("file_count"), m["originalTokens"].alias("original_tokens"), m["distilledTokens"].alias("distilled_tokens"), m["compressionRatio"].alias("compression_ratio"), F.element_at(m["languages"], "python").alias("python_files"))
    names = lambda a: F.array_join(F.transform(a, lambda e: e["name"]), " ")
    members = names(F.flatten(F.filter(F.transform("f.exports", lambda e: e["members"]), lambda x: x.isNotNull())))
    return rows.select("package", "f.path", F.array_join("f.imports", " ").alias("imports"), names(F.col("f.exports")).alias("exports"), members.alias("members"), "file_count", "original_tokens", "distilled_tokens", "compression_ratio", "python_files")


@query(f"""WITH {TOKENS} SELECT count(*) AS file_count, 'src' AS directories, 'python:' || count(*) AS languages, sum(o)::BIGINT AS original_tokens, sum(d)::BIGINT AS distilled_tokens,
    floor((sum(o) - sum(d)) * 100.0 / sum(o) + 0.5)::BIGINT AS compression_ratio FROM tokens""")
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = python_files(spark, sf_dir)
    counted = F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ")
    m = distill.metrics(files, distill.parse(files))
    return m.select("file_count", F.array_join("directories", " ").alias("directories"), counted.alias("languages"), "original_tokens", "distilled_tokens", F.col("compression_ratio").cast("long").alias("compression_ratio"))


@query("SELECT unnest(['python', 'typescript']) AS language, (SELECT count(*) FROM documents) AS files")
def q_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = python_files(spark, sf_dir).unionByName(ts_files(spark, sf_dir))
    return distill.metrics(files, distill.parse(files)).select(F.explode("languages").alias("language", "files"))


@query(f"""WITH k AS (SELECT doc_id, 'K' || doc_id AS k FROM documents)
    SELECT (doc_id // 100)::BIGINT AS package, string_agg('<file path="t' || doc_id || '.ts">' || {NL} || 'import ''./m' || doc_id || '''' || {NL}
        || 'export interface I' || doc_id || ' {{' || {NL} || '    z: string;' || {NL} || '}}' || {NL}
        || 'export class ' || k || ' extends L implements I {{' || {NL} || '    constructor(x: number)' || {NL} || '    name: string;' || {NL} || '    greet(): string' || {NL} || '}}' || {NL}
        || 'export function f' || doc_id || '(a: number): void' || {NL} || 'export const N' || doc_id || ': ' || doc_id || ' = ' || doc_id || {NL} || '</file>', {NL} || {NL} ORDER BY 'src/t' || doc_id || '.ts') AS document
    FROM k GROUP BY ALL""")
def q_distill_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = distill.parse(ts_files(spark, sf_dir)).withColumn("package", package(number_in(F.col("file"))))
    return render.distill_txt(parsed, by=["package"])


@query("""WITH m AS (SELECT doc_id, unnest([{'e': 'K', 'n': 'constructor', 't': 'method'}, {'e': 'K', 'n': 'name', 't': 'property'}, {'e': 'K', 'n': 'greet', 't': 'method'}, {'e': 'I', 'n': 'z', 't': 'property'}]) AS x FROM documents)
    SELECT 'src/t' || doc_id || '.ts' AS file, x.e || doc_id AS name, x.n AS member, x.t AS kind FROM m""")
def q_member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = distill.symbols(distill.parse(ts_files(spark, sf_dir))).select("file", "name", F.explode("members").alias("m"))
    return s.select("file", "name", F.col("m.name").alias("member"), F.col("m.type").alias("kind"))


@query("""WITH n AS (SELECT doc_id, unnest(['f' || doc_id, 'LIMIT_' || doc_id, 'C' || doc_id]) AS name FROM documents)
    SELECT 'src/m' || doc_id || '.py' AS file, name, NOT (starts_with(name, 'f1') OR regexp_matches(name, '^C.$')) AS kept FROM n""")
def q_excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = distill.parse(python_files(spark, sf_dir), DistillOptions(exclude_names=["f1*", "C?"]))
    kept = distill.symbols(parsed).select("file", "name", F.lit(True).alias("kept"))
    return kept.unionByName(distill.skipped(parsed).where("reason = 'pattern'").select("file", "name", F.lit(False).alias("kept")))


@query("SELECT 'src/t' || doc_id || '.ts' AS file, unnest(['K' || doc_id, 'f' || doc_id]) AS name FROM documents")
def q_included_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.symbols(distill.parse(ts_files(spark, sf_dir), DistillOptions(include_names=["K*", "f*"]))).select("file", "name")


@query("""SELECT 'src/d' || doc_id || '.py' AS file, unnest(['f' || doc_id, 'C' || doc_id]) AS name, unnest(['Does ' || doc_id || '.' || chr(10) || 'In two lines.', NULL]) AS docstring FROM documents""")
def q_python_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord").cast("string")
    source = F.concat(F.lit("def f"), n, F.lit('(a):\n    """Does '), n, F.lit('.\n    In two lines.\n    """\n    return a\n\nclass C'), n, F.lit(':\n    """Holds '), n, F.lit('.\n    And more."""\n    x = 1\n'))
    files = virtual.documents(spark, sf_dir).select(F.concat(F.lit("src/d"), n, F.lit(".py")).alias("file"), source.alias("content"))
    return distill.symbols(distill.parse(files)).select("file", "name", "docstring")


@query(f"WITH {NAMED} SELECT file FROM named WHERE regexp_matches(file, '\\.(ts|py|js)$')")
def q_parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.parse(named(spark, sf_dir)).select("file")


@query("""SELECT 'src/m' || doc_id || '.py' AS file, unnest(['f' || doc_id, '_g', 'LIMIT_' || doc_id, 'C' || doc_id]) AS name, unnest([true, false, true, true]) AS in_document, unnest([true, false, true, true]) AS in_tree FROM documents""")
def q_visible_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = distill.parse(python_files(spark, sf_dir), DistillOptions(private=True))
    every = distill.symbols(parsed)
    shown = distill.symbols(parsed.withColumn("exports", render.visible(False))).select("file", "name", F.lit(True).alias("d"))
    treed = tree.visible(every, TreeOptions()).select("file", "name", F.lit(True).alias("t"))
    rows = every.select("file", "name").join(shown, ["file", "name"], "left").join(treed, ["file", "name"], "left")
    return rows.select("file", "name", F.coalesce("d", F.lit(False)).alias("in_document"), F.coalesce("t", F.lit(False)).alias("in_tree"))


# -- compressed files


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = distill.compress(virtual.documents(spark, sf_dir)).withColumn("ord", number_in(F.col("file")))
    return files.withColumn("package", package(F.col("ord")))


@query(f"""WITH {DOCS} SELECT (ord // 100)::BIGINT AS package, regexp_replace(string_agg('<file path="' || file || '">' || {NL} || content || {NL} || '</file>' || {NL}, {NL} ORDER BY ord), '\\s+$', '') AS document FROM docs GROUP BY ALL""")
def q_compression_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.compression_txt(packed_documents(spark, sf_dir), ["package"])


@query(f"""WITH {DOCS} SELECT (ord // 100)::BIGINT AS package, '# Compressed Files' || {NL} || {NL} || '**Total Files:** ' || count(*) || {NL} || '**Total Size:** ' || format('{{:,}}', sum(strlen(content))::BIGINT) || ' bytes' || {NL} || {NL}
        || string_agg('## ' || file || {NL} || {NL} || '```txt' || {NL} || content || {NL} || '```', {NL} || {NL} ORDER BY ord) AS document FROM docs GROUP BY ALL""")
def q_compression_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.compression_md(packed_documents(spark, sf_dir), by=["package"])


@query(f"""WITH {DOCS} SELECT (ord // 100)::BIGINT AS package, file AS path, strlen(content)::BIGINT AS size, left(sha256(content), 8) AS hash, md5(content) AS content, count(*) OVER (PARTITION BY ord // 100) AS total_files,
    (sum(strlen(content)) OVER (PARTITION BY ord // 100))::BIGINT AS total_size FROM docs""")
def q_compression_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = render.compression_json(packed_documents(spark, sf_dir), by=["package"]).select("package", F.from_json("document", "files array<struct<path:string,size:bigint,hash:string,content:string>>, metadata struct<totalFiles:bigint,totalSize:bigint>").alias("d"))
    rows = read.select("package", F.explode("d.files").alias("f"), F.col("d.metadata.totalFiles").alias("total_files"), F.col("d.metadata.totalSize").alias("total_size"))
    return rows.select("package", "f.path", "f.size", "f.hash", F.md5("f.content").alias("content"), "total_files", "total_size")


# -- trees


def packed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.symbols(distill.parse(python_files(spark, sf_dir))).withColumn("package", package(number_in(F.col("file"))))


API = f"""api AS (SELECT doc_id // 100 AS package, {MODULE} AS file, unnest(['f' || doc_id, 'LIMIT_' || doc_id, 'C' || doc_id]) AS name, unnest(['function', 'const', 'class']) AS type, unnest([1, 4, 99]) AS r, unnest([2, 3, 1]) AS g FROM documents)"""


@query(f"""WITH {API}, l AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY r DESC, type DESC, name DESC, file DESC) = 1 AS last FROM api)
    SELECT package::BIGINT AS package, 'All APIs' || {NL} || string_agg(CASE WHEN last THEN '└── ' ELSE '├── ' END || name || ' ' || file, {NL} ORDER BY r, type, name, file) AS document FROM l GROUP BY package""")
def q_tree_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_flat(packed_symbols(spark, sf_dir), by=["package"])


@query(f"""WITH {API}, l AS (SELECT *, row_number() OVER (PARTITION BY package, type ORDER BY name DESC, file DESC) = 1 AS last FROM api),
    t AS (SELECT package, type, g, CASE WHEN g = 3 THEN '└── ' ELSE '├── ' END || upper(type) || ' (' || count(*) || ')' || {NL}
        || string_agg(CASE WHEN g = 3 THEN '    ' ELSE '│   ' END || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || ' ' || file, {NL} ORDER BY name, file) || CASE WHEN g = 3 THEN '' ELSE {NL} || '│' END AS block FROM l GROUP BY package, type, g)
    SELECT package::BIGINT AS package, 'APIs by Type' || {NL} || string_agg(block, {NL} ORDER BY g) AS document FROM t GROUP BY package""")
def q_tree_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_by_type(packed_symbols(spark, sf_dir), by=["package"])


@query(f"""SELECT (doc_id // 100)::BIGINT AS package, string_agg('## ' || {MODULE} || {NL} || {NL} || '- f' || doc_id || ' def f' || doc_id || '(p, q=2) -> int' || {NL} || '- LIMIT_' || doc_id || ' LIMIT_' || doc_id || ' = ' || doc_id || {NL}
        || '- C' || doc_id || ' class C' || doc_id || '(Base, M)' || {NL}, {NL} ORDER BY {MODULE}) AS document FROM documents GROUP BY ALL""")
def q_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.outline(packed_symbols(spark, sf_dir), TreeOptions(show_types=True), ["package"])


@query(f"""WITH s AS (SELECT DISTINCT source FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR || '.py' DESC) = 1 AS last, row_number() OVER (ORDER BY source DESC) AS k FROM documents),
    last_folder AS (SELECT max(source) AS x FROM s), lines AS (
        SELECT source AS a, '' AS b, 0 AS j, CASE WHEN source = x THEN '└── ' ELSE '├── ' END || source || '/' AS line FROM s, last_folder
        UNION ALL SELECT source, doc_id::VARCHAR || '.py', 0, CASE WHEN source = x THEN '    ' ELSE '│   ' END || CASE WHEN last THEN '└── ' ELSE '├── ' END || doc_id || '.py' FROM d, last_folder
        UNION ALL SELECT source, doc_id::VARCHAR || '.py', j, CASE WHEN source = x THEN '    ' ELSE '│   ' END || CASE WHEN last THEN '    ' ELSE '│   ' END || CASE WHEN j = 2 THEN '└── B' ELSE '├── a' END || doc_id FROM d, last_folder, (SELECT unnest([1, 2]) AS j))
    SELECT row_number() OVER (ORDER BY a, b, j) - 1 AS place, line FROM lines""")
def q_tree_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of the whole table, a line a row."""
    n = F.col("ord").cast("string")
    files = virtual.documents(spark, sf_dir).select(F.concat("source", F.lit("/"), n, F.lit(".py")).alias("file"), F.concat(F.lit("def a"), n, F.lit("(): pass\nclass B"), n, F.lit(": pass\n")).alias("content"))
    return parts.numbered(tree.tree_lines(distill.symbols(distill.parse(files)))).select("place", F.col("block").alias("line"))


# -- changes and pickers


@query(f"""WITH {DOCS} SELECT file, 'added' AS status, len(string_split(content, {NL}))::BIGINT AS additions, md5('+' || replace(content, {NL}, {NL} || '+')) AS diff, make_timestamp((1700000000 + ord) * 1000000) AS last_modified FROM docs WHERE ord % 4 > 0""")
def q_selected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir).withColumn("last_modified", F.timestamp_seconds(F.col("ord") + 1_700_000_000)).withColumnRenamed("file", "path")
    rows = C.selected_changes(docs.withColumn("content", F.when(F.col("ord") % 4 > 0, F.col("content"))))
    return rows.select("file", "status", F.col("additions").cast("long").alias("additions"), F.md5("diff").alias("diff"), F.col("last_modified").cast("timestamp_ntz").alias("last_modified"))


@query(f"""WITH {DOCS} SELECT file, 'added' AS status, 0::BIGINT AS additions, 0::BIGINT AS deletions, '' AS diff, CASE WHEN ord % 3 > 0 THEN make_timestamp((1700000000 + ord) * 1000000) END AS last_modified FROM docs WHERE ord % 5 > 0""")
def q_listed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir).withColumns({"last_modified": F.when(F.col("ord") % 3 > 0, F.timestamp_seconds(F.col("ord") + 1_700_000_000)), "is_directory": F.col("ord") % 5 == 0})
    rows = C.listed_changes(docs)
    return rows.select("file", "status", *[F.col(c).cast("long").alias(c) for c in ("additions", "deletions")], "diff", F.col("last_modified").cast("timestamp_ntz").alias("last_modified"))


@query(f"WITH {CHANGES} SELECT file, status, CASE WHEN ord % 3 > 0 THEN make_timestamp((1700000000 + ord) * 1000000) END AS last_modified FROM changes")
def q_modification_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    listing = docs.where("ord % 3 > 0").select(F.col("file").alias("relative_path"), F.timestamp_seconds(F.col("ord") + 1_700_000_000).alias("last_modified"))
    return C.with_modification_times(virtual.changes(docs), listing).select("file", "status", F.col("last_modified").cast("timestamp_ntz").alias("last_modified"))


@query(f"WITH {CHANGES} SELECT file, status FROM changes WHERE status <> 'deleted' AND ord % 3 > 0")
def q_staged_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    return C.staged_existing(virtual.changes(docs), docs.where("ord % 3 > 0").select(F.col("file").alias("relative_path"))).select("file", "status")


@query(f"""WITH {CHANGES}, s AS (SELECT * FROM changes WHERE ord % 2 = 0), u AS (SELECT * FROM changes WHERE ord % 3 = 0)
    SELECT file, md5(CASE WHEN s.file IS NOT NULL AND u.file IS NOT NULL THEN s.diff || {NL} || u.diff ELSE coalesce(s.diff, u.diff) END) AS diff FROM s FULL JOIN u USING (file)""")
def q_merged_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = virtual.changes(virtual.documents(spark, sf_dir))
    return C.merge_changes(rows.where("ord % 2 = 0"), rows.where("ord % 3 = 0")).select("file", F.md5("diff").alias("diff"))


@query(f"""WITH {CHANGES} SELECT file, md5(diff) AS diff FROM changes WHERE ord % 2 = 0 UNION ALL SELECT file, md5('+' || replace(content, {NL}, {NL} || '+')) FROM docs WHERE ord % 7 = 1""")
def q_untracked_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    return C.union_untracked(virtual.changes(docs).where("ord % 2 = 0"), docs.where("ord % 7 = 1")).select("file", F.md5("diff").alias("diff"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;')) AS escaped FROM pages")
def q_escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.pages(spark, sf_dir).select(F.col("ord").alias("page_id"), F.md5(T.escape_xml(F.col("content"))).alias("escaped"))


@query("""SELECT n_nationkey, m AS method, 'lodestone.extract.' || lower(replace(replace(m || '/' || n_name, ' ', '-'), '/', '.')) || '.txt' AS name
    FROM nation, (SELECT unnest(['main..x', 'staged', 'all', 'feature-branch', 'current']) AS m)""".replace("replace(replace(m", "replace(replace(regexp_replace(m, '[.]+', '.')"))
def q_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kinds = [C.extract_method("main..x", True, False, False, False), C.extract_method(None, True, False, False, True), C.extract_method(None, False, True, False, True), C.extract_method(None, False, False, False, True), C.extract_method(None, False, False, False, False)]
    rows = nation.select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, kinds))).alias("method"))
    return rows.select("n_nationkey", "method", T.output_name("lodestone", "extract", F.concat_ws("/", "method", "n_name"), "txt").alias("name"))


@query(f"WITH {NAMED} SELECT file FROM named WHERE starts_with(file, 'src/en/') AND regexp_matches(file, '\\.(ts|css)$')")
def q_change_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_changes(named(spark, sf_dir), "src/en/*", ["ts", "css"]).select("file")


@query(f"WITH {DOCS} SELECT file FROM docs WHERE regexp_matches(file, '^src.[^/]*/e[^/]/.[^/]*7\\.txt$')")
def q_glob_scanner_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stars are one character and a run without slashes in this dialect."""
    return virtual.documents(spark, sf_dir).where(globs.any_match(F.col("file"), ["src**/e*/**7.txt"])).select("file")


PICKED = ("test.ts", "ts", "spec.js", "log", "py")


@query(f"""WITH n AS (SELECT 'src/lib/f' || doc_id || '.' || ({list(PICKED)})[doc_id % 5 + 1] AS file, doc_id FROM documents)
    SELECT 'default' AS kind, file FROM n WHERE doc_id % 5 IN (1, 3, 4) UNION ALL SELECT 'tests', file FROM n WHERE doc_id % 5 = 0 AND doc_id % 10 = 0 UNION ALL SELECT 'without', file FROM n WHERE doc_id % 5 IN (3, 4)""")
def q_distill_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, PICKED)), (F.col("ord") % 5 + 1).cast("int"))
    files = virtual.documents(spark, sf_dir).select(F.concat(F.lit("src/lib/f"), F.col("ord").cast("string"), F.lit("."), ext).alias("file"))
    kinds = {"default": DistillOptions(), "tests": DistillOptions(include=["**/*0.test.ts"]), "without": DistillOptions(exclude=["**/*.ts"])}
    parts = [distill.pick(files, o).select(F.lit(k).alias("kind"), "file") for k, o in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {DOCS} SELECT file FROM docs WHERE NOT regexp_matches(file, '9\\.txt$') ORDER BY file LIMIT 20")
def q_combine_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first max_files files."""
    return combine.pick(virtual.documents(spark, sf_dir), CombineOptions(exclude=["*9.txt"], max_files=20)).select("file")


@query(f"WITH {PICKER} SELECT file, row_number() OVER (PARTITION BY directory ORDER BY file_size DESC NULLS LAST, ord) AS by_size, row_number() OVER (PARTITION BY directory ORDER BY file, ord) AS by_name, row_number() OVER (PARTITION BY directory ORDER BY status, ord) AS by_status FROM picker")
def q_panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda by: F.row_number().over(W.partitionBy(T.directory(F.col("file"))).orderBy(*S.panel_sort_keys(by))).cast("long").alias(f"by_{by}")
    return _picker(spark, sf_dir).select("file", place("size"), place("name"), place("status"))


@query(f"""WITH {PICKER}, d AS (SELECT directory, sum(token_estimate)::BIGINT AS tokens FROM picker GROUP BY directory)
    SELECT directory, row_number() OVER (ORDER BY tokens DESC, directory) AS place FROM d""")
def q_directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.places(S.directory_metrics(_picker(spark, sf_dir)).select("directory", "tokens"), S.directory_order("size")).select("directory", "place")


# -- functions


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bin' ELSE 'txt' END AS ext, text FROM documents), b AS (
        SELECT doc_id, ext, text, list_transform(generate_series(1, least(length(text), 1024)), lambda i: text[i]) AS chars FROM d), u AS (
        SELECT doc_id, unnest(chars) AS c, generate_subscripts(chars, 1) AS i FROM b), o AS (
        SELECT doc_id, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u), n AS (
        SELECT doc_id, count(*) FILTER (regexp_matches(c, '^[ -~\\t\\n\\r]$') AND upto <= 1024) AS printable FROM o GROUP BY doc_id)
    SELECT doc_id, ext = 'txt' OR coalesce(strlen(text) > 0 AND NOT contains(left(text, 1024), chr(0)) AND printable / least(strlen(text), 1024) > 0.7, false) AS is_text FROM d LEFT JOIN n USING (doc_id)""")
def q_is_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.corpus import TEXT_EXTENSIONS

    name = F.concat(F.lit("f."), F.when(F.col("ord") % 2 == 0, "bin").otherwise("txt"))
    sniffed = T.looks_like_text(name, F.encode("content", "UTF-8"), sorted(TEXT_EXTENSIONS))
    return virtual.documents(spark, sf_dir).select(F.col("ord").alias("doc_id"), sniffed.alias("is_text"))


@query(f"""WITH {DOCS}, p AS (SELECT *, regexp_extract(file, '[^/]*$') AS base FROM docs)
    SELECT ord AS doc_id, CASE WHEN length(file) <= 14 THEN file WHEN length(base) + 7 > 14 THEN '.../' || base WHEN length(base) + 3 + length(source) + 5 > 14 THEN '.../' || lang || '/' || base ELSE '.../' || file END AS path,
           (ord % 7 + 4)::BIGINT AS indent, 'a, b: int' AS parameters, repeat('█', (ord % 11)::INT) || repeat('░', (10 - ord % 11)::INT) AS bar, CASE WHEN n >= 1000 THEN printf('%.1fk', floor(n / 100 + 0.5) / 10) ELSE n::VARCHAR END AS tokens
    FROM (SELECT *, length(content) * (ord % 30) AS n FROM p)""")
def q_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord")
    line = F.concat(F.repeat(F.lit(" "), (k % 7).cast("int")), F.lit("\tx = 1"))
    return virtual.documents(spark, sf_dir).select(
        k.alias("doc_id"), T.truncate_path(F.col("file"), 14).alias("path"), T.indent_level(line).cast("long").alias("indent"), T.clean_parameters(F.lit("self, a , b: int")).alias("parameters"),
        T.progress_bar(k % 11, F.lit(10)).alias("bar"), T.format_token_count_short(F.length("content") * (k % 30)).alias("tokens"),
    )


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts::TIMESTAMP) AS t, date_trunc('second', ts::TIMESTAMP) + to_seconds((event_id % 12) * 80000) AS now FROM events), s AS (SELECT *, date_diff('second', t, now) AS s FROM e)
    SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE WHEN s > 604800 THEN month(t) || '/' || day(t) || '/' || year(t) WHEN s >= 86400 THEN s // 86400 || 'd ago' WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE 'just now' END AS age FROM s""")
def q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    then = F.timestamp_seconds(F.unix_timestamp("ts"))
    now = F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 12) * 80000)
    return events.select("event_id", T.iso_timestamp(then).alias("iso"), T.relative_time_or_date(then, now).alias("age"))


FENCES = "WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'css' THEN 'css' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'rs' THEN 'rust' WHEN 'html' THEN 'html' WHEN 'kt' THEN 'kotlin'"


@query(f"""WITH {NAMED}, e AS (SELECT file, regexp_extract(file, '([^.]*)$', 1) AS x FROM named)
    SELECT file, CASE lower(x) {FENCES} ELSE 'txt' END AS syntax, CASE lower(x) {FENCES} ELSE x END AS fence FROM e""")
def q_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file")
    return named(spark, sf_dir).select("file", L.syntax_language(f).alias("syntax"), L.combine_fence(f).alias("fence"))
