"""Queries of the reference's operators over the driver's tables, and the same in SQL.

Documents, pages and conversations are read as virtual files; change sets are synthetic, by fixed predicates on ids,
so that SQL can make them too. Parsers and diffs get sources that are written from the documents' ids and lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators import changes as C
from ..operators import diffs, globs
from ..operators import selector as S
from ..schemas import DistillOptions
from ..sources import virtual
from . import combine, distill, render, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The virtual files in SQL.
DOCS = "docs AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file, text AS content, doc_id AS ord, lang, source FROM documents)"
CHANGES = f"""{DOCS}, changes AS (
    SELECT file, content, ord, source, (['added', 'modified', 'modified', 'deleted', 'renamed'])[ord % 5 + 1] AS status,
           len(string_split(content, chr(10))) // 2 AS additions, len(string_split(content, chr(10))) // 4 AS deletions,
           left(content, (length(content) // 2)::INT) AS diff
    FROM docs)"""
NOW = "2030-01-01 00:00:00"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def by_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.substring_index("file", "/", 1))


SHOWN = f"""{CHANGES}, shown AS (
    SELECT *, (status = 'added' AND len(string_split(content, chr(10))) < 50)
           OR (status = 'modified' AND 100.0 * (additions + deletions) / len(string_split(content, chr(10))) > 40) AS is_full
    FROM changes)"""


def shown_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = virtual.documents(spark, sf_dir)
    return C.smart_context(virtual.changes(docs), docs), docs


@query(f"""WITH {SHOWN}, sums AS (
    SELECT source, sum(ceil(length(content) / 4.0))::BIGINT AS full_file_tokens,
           sum(ceil(length(CASE WHEN is_full THEN content ELSE diff END) / 4.0))::BIGINT AS actual_tokens
    FROM shown WHERE status <> 'deleted' GROUP BY source)
    SELECT *, full_file_tokens - actual_tokens AS saved,
           CASE WHEN full_file_tokens > 0 THEN floor((full_file_tokens - actual_tokens) * 100.0 / full_file_tokens + 0.5)::BIGINT ELSE 0 END AS percent_saved
    FROM sums""")
def q_smart_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, docs = shown_changes(spark, sf_dir)
    return C.token_savings(by_source(shown), docs, ["source"])


@query(f"WITH {SHOWN} SELECT file, is_full AS shows_full FROM shown")
def q_smart_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, _ = shown_changes(spark, sf_dir)
    return shown.select("file", F.col("full_content").isNotNull().alias("shows_full"))


@query(f"WITH {SHOWN} SELECT ceil((sum(length(diff)) + sum(CASE WHEN is_full THEN length(content) ELSE 0 END)) / 4.0)::BIGINT AS estimated FROM shown")
def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_estimate(shown_changes(spark, sf_dir)[0])


@query("SELECT doc_id, left(sha256(text), 8) AS hash, strlen(text)::BIGINT AS size, NULL::VARCHAR AS language FROM documents")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = virtual.documents(spark, sf_dir)
    return distill.compress(files).select(F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "hash", "size", "language")


@query(f"""WITH {CHANGES}, s AS (SELECT * FROM changes WHERE ord % 2 = 0), u AS (SELECT * FROM changes WHERE ord % 3 = 0)
    SELECT file, coalesce(s.status, u.status) AS status, (coalesce(s.additions, 0) + coalesce(u.additions, 0))::BIGINT AS additions,
           (coalesce(s.deletions, 0) + coalesce(u.deletions, 0))::BIGINT AS deletions,
           length(CASE WHEN s.file IS NOT NULL AND u.file IS NOT NULL THEN s.diff || chr(10) || u.diff ELSE coalesce(s.diff, u.diff) END)::BIGINT AS diff_length
    FROM s FULL JOIN u USING (file)""")
def q_merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = virtual.changes(virtual.documents(spark, sf_dir))
    merged = C.merge_changes(rows.where("ord % 2 = 0"), rows.where("ord % 3 = 0"))
    return merged.select("file", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), F.length("diff").cast("long").alias("diff_length"))


@query(f"WITH {CHANGES} SELECT count(*) AS files_changed, 0::BIGINT AS functions_modified, sum(additions)::BIGINT AS lines_added, sum(deletions)::BIGINT AS lines_deleted FROM changes")
def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope(virtual.changes(virtual.documents(spark, sf_dir)))


@query(f"""WITH {CHANGES}
    SELECT file, status, additions::BIGINT AS additions, deletions::BIGINT AS deletions, length(diff)::BIGINT AS diff_length FROM changes WHERE ord % 2 = 0
    UNION ALL
    SELECT file, 'added', len(string_split(content, chr(10))), 0, length(content) + len(string_split(content, chr(10))) FROM docs WHERE ord % 7 = 1""")
def q_union_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    rows = C.union_untracked(virtual.changes(docs).where("ord % 2 = 0"), docs.where("ord % 7 = 1"))
    return rows.select("file", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), F.length("diff").cast("long").alias("diff_length"))


@query(f"WITH {CHANGES} SELECT (SELECT count(*) FROM changes WHERE ord % 2 = 0) AS total_changes, (SELECT count(*) FROM changes WHERE ord % 3 = 0) AS not_included")
def q_notice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = virtual.changes(virtual.documents(spark, sf_dir))
    return C.notice_counts(rows.where("ord % 2 = 0"), rows.where("ord % 3 = 0"))


@query(f"""WITH {CHANGES} SELECT file, strlen(content)::BIGINT AS file_size, ord % 2 = 0 AS is_staged, ord % 3 = 0 AS is_unstaged, ord % 7 = 1 AS is_untracked FROM changes""")
def q_status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picker(spark, sf_dir).select("file", "file_size", "is_staged", "is_unstaged", "is_untracked")


def _picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    rows = virtual.changes(docs)
    listing = docs.select(F.col("file").alias("relative_path"), F.octet_length("content").cast("long").alias("size"))
    files = C.enhance(rows, listing, rows.where("ord % 2 = 0"), rows.where("ord % 3 = 0"), rows.where("ord % 7 = 1"))
    hour = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("ord") * 7919 % 100_000).cast("long") * 60)
    return S.file_token_estimate(files.withColumn("last_modified", F.when(F.col("ord") % 11 > 0, hour)))


PICKER = f"""{CHANGES}, picker AS (
    SELECT *, strlen(content)::BIGINT AS file_size, ord % 2 = 0 AS is_staged, ord % 3 = 0 AS is_unstaged, ord % 7 = 1 AS is_untracked,
           CASE WHEN ord % 11 > 0 THEN make_timestamp((1700000000 + (ord * 7919 % 100000) * 60) * 1000000) END AS last_modified,
           CASE WHEN additions + deletions > 0 THEN ceil((additions + deletions) * 80 / 4.0) ELSE ceil(strlen(content) / 5.0) END::BIGINT AS token_estimate,
           regexp_replace(file, '/?[^/]*$', '') AS directory
    FROM changes)"""


@query(f"WITH {PICKER} SELECT file, row_number() OVER (ORDER BY last_modified DESC NULLS LAST, ord) AS place FROM picker")
def q_selector_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = S.sort_keys("updated", descending=True)
    return S.places(_picker(spark, sf_dir).select("file", "last_modified", "ord"), keys).select("file", "place")


@query(f"WITH {PICKER} SELECT 'staged' AS kind, file FROM picker WHERE is_staged UNION ALL SELECT 'untracked', file FROM picker WHERE is_untracked UNION ALL SELECT 'modified', file FROM picker WHERE status = 'modified'")
def q_selector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _picker(spark, sf_dir)
    parts = [files.where(S.status_filter(k)).select(F.lit(k).alias("kind"), "file") for k in ("staged", "untracked", "modified")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {PICKER}, s AS (SELECT *, CASE WHEN is_staged THEN 'staged' WHEN is_unstaged THEN 'unstaged' WHEN is_untracked THEN 'untracked' END AS state FROM picker)
    SELECT directory, count(*) AS files, sum(token_estimate)::BIGINT AS tokens, sum(file_size)::BIGINT AS bytes, max(last_modified) AS last_modified, arg_min(status, ord) AS status,
           count(*) FILTER (state = 'staged') AS staged, count(*) FILTER (state = 'unstaged') AS unstaged, count(*) FILTER (state = 'untracked') AS untracked,
           count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted
    FROM s GROUP BY directory""")
def q_directory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.directory_metrics(_picker(spark, sf_dir)).withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))


@query(f"WITH {PICKER} SELECT directory, count(*) AS files, bool_and(is_staged) AS selected, bool_or(is_staged) AND NOT bool_and(is_staged) AS mixed FROM picker GROUP BY directory")
def q_header_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.header_state(_picker(spark, sf_dir).withColumn("selected", F.col("is_staged")))


@query(f"WITH {PICKER} SELECT count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(token_estimate)::BIGINT AS tokens FROM picker WHERE is_staged")
def q_selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.selection_stats(_picker(spark, sf_dir).withColumn("selected", F.col("is_staged")))


@query(f"""WITH {PICKER} SELECT directory, NULL::VARCHAR AS file, true AS is_header, count(*) AS files, bool_and(is_staged) AS selected, bool_or(is_staged) AND NOT bool_and(is_staged) AS mixed FROM picker GROUP BY directory
    UNION ALL SELECT directory, file, false, 1, is_staged, false FROM picker""")
def q_display_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_headers(_picker(spark, sf_dir).withColumn("selected", F.col("is_staged")))


@query(f"WITH {DOCS} SELECT file FROM docs ORDER BY file LIMIT 20 OFFSET 40")
def q_page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    return S.page(docs.select("file"), [F.col("file")], cursor=50, height=20, total=docs.count())


@query(f"WITH {DOCS} SELECT file, contains(file, 'c1/e') AS by_part, regexp_matches(file, 's.*1.*n.*9') AS by_letters FROM docs WHERE contains(file, 'c1/e') OR regexp_matches(file, 's.*1.*n.*9')")
def q_search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file")
    found = virtual.documents(spark, sf_dir).where(S.search(f, "C1/E") & f.contains("c1/e") | S.search(f, "s1n9"))
    return found.select("file", f.contains("c1/e").alias("by_part"), f.rlike("s.*1.*n.*9").alias("by_letters"))


@query(f"WITH {DOCS}, d AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS directory FROM docs) SELECT file, directory, row_number() OVER (PARTITION BY directory ORDER BY file DESC) = 1 AS is_last, CASE WHEN row_number() OVER (PARTITION BY directory ORDER BY file DESC) = 1 THEN '└── ' ELSE '├── ' END AS glyph FROM d")
def q_tree_glyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = virtual.documents(spark, sf_dir).select("file", T.directory(F.col("file")).alias("directory"))
    return S.last_of(d, "directory", F.col("file")).withColumn("glyph", tree.branch(F.col("is_last")))


@query(f"""WITH {DOCS}, p AS (SELECT DISTINCT split_part(file, '/', 1) AS a, split_part(file, '/', 2) AS b, file FROM docs),
    n AS (SELECT DISTINCT a AS path, '' AS parent, a AS name, false AS is_file FROM p UNION SELECT DISTINCT a || '/' || b, a, b, false FROM p UNION SELECT file, a || '/' || b, split_part(file, '/', 3), true FROM p)
    SELECT path, parent, name, is_file, row_number() OVER (PARTITION BY parent ORDER BY is_file DESC, name DESC) = 1 AS is_last FROM n""")
def q_tree_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.skeleton(virtual.documents(spark, sf_dir)).select("path", "parent", "name", "is_file", "is_last")


@query("""SELECT conv_id, string_agg('<file path="conv/' || conv_id || '/' || turn || '_' || role || '.md">' || chr(10)
        || CASE WHEN text <> '' THEN text || chr(10) ELSE '' END || '</file>' || chr(10), chr(10) ORDER BY turn, role, text) AS document FROM (SELECT * FROM conversations) GROUP BY conv_id""")
def q_combine_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = virtual.conversations(spark, sf_dir).withColumn("ord", F.struct("turn", "role", "content"))
    return render.document(render.combine_txt_blocks(files), by=["conv_id"])


@query(f"WITH {DOCS} SELECT count(*) AS total_files, sum(len(string_split(content, chr(10))))::BIGINT AS total_additions, 0::BIGINT AS total_deletions FROM docs")
def q_combine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.totals(combine.as_changes(virtual.documents(spark, sf_dir)))


@query(f"WITH {DOCS} SELECT count(*) AS files, sum(strlen(content))::BIGINT AS bytes, sum(ceil(length(content) / 4.0))::BIGINT AS tokens, ceil(sum(ceil(length(content) / 4.0)) * 0.09)::BIGINT AS estimate, (sum(ceil(length(content) / 4.0)) - ceil(sum(ceil(length(content) / 4.0)) * 0.09))::BIGINT AS saved FROM docs")
def q_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.dry_run(virtual.documents(spark, sf_dir))


@query("SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&apos;'))::BIGINT AS n FROM pages")
def q_escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.pages(spark, sf_dir).select(F.col("ord").alias("page_id"), F.length(T.escape_xml(F.col("content"))).cast("long").alias("n"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::BIGINT AS n_imports, coalesce(array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' '), '') AS imports FROM pages")
def q_page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("content", F.lit('href="([^"]*)"'), 1)
    return virtual.pages(spark, sf_dir).select(F.col("ord").alias("page_id"), F.size(found).cast("long").alias("n_imports"), F.array_join(found, " ").alias("imports"))


@query("SELECT lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def q_language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query(f"WITH {DOCS} SELECT DISTINCT regexp_replace(file, '/?[^/]*$', '') AS directory FROM docs")
def q_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).select(T.directory(F.col("file")).alias("directory")).distinct()


@query(f"""WITH {CHANGES}, t AS (SELECT file, ceil(length(diff) / 4.0)::BIGINT AS full_tokens, ceil(length(content) / 8.0 + 10)::BIGINT AS actual FROM changes)
    SELECT file, full_tokens - actual AS saved, CASE WHEN full_tokens > 0 THEN floor((full_tokens - actual) * 100.0 / full_tokens + 0.5)::BIGINT ELSE 0 END AS percent FROM t""")
def q_savings_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    t = docs.select("file", T.estimate_tokens(F.left("content", F.floor(F.length("content") / 2).cast("int"))).alias("f"), F.ceil(F.length("content") / 8 + 10).cast("long").alias("a"))
    s = T.token_savings(F.col("f"), F.col("a"))
    return t.select("file", s["saved"].alias("saved"), T.js_round(s["percent"]).alias("percent"))


@query(f"WITH {DOCS} SELECT file, md5('+' || replace(content, chr(10), chr(10) || '+')) AS hash, len(string_split(content, chr(10)))::BIGINT AS lines FROM docs")
def q_added_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).select("file", F.md5(T.added_diff(F.col("content"))).alias("hash"), T.line_count(F.col("content")).alias("lines"))


@query(f"""WITH {DOCS}, d AS (SELECT file, string_split('+' || replace(content, chr(10), chr(10) || CASE WHEN ord % 2 = 0 THEN '-' ELSE ' ' END), chr(10)) AS x FROM docs)
    SELECT file, md5(array_to_string(list_transform(x, lambda l: CASE WHEN l[1] IN ('+', '-') THEN l[1] || ' ' || substr(l, 2) ELSE '  ' || l END), chr(10))) AS hash FROM d""")
def q_format_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("ord") % 2 == 0, "\n-").otherwise("\n ")
    diff = F.concat(F.lit("+"), F.replace(F.col("content"), F.lit("\n"), mark))
    return virtual.documents(spark, sf_dir).select("file", F.md5(T.format_diff(diff)).alias("hash"))


SIZE = "CASE WHEN n >= 1073741824 THEN printf('%.1f{0}GB', floor(n / 107374182.4 + 0.5) / 10) WHEN n >= 1048576 THEN printf('%.1f{0}MB', floor(n / 104857.6 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f{0}KB', floor(n / 102.4 + 0.5) / 10) ELSE printf('%.1f{0}B', n::DOUBLE) END"


@query(f"WITH d AS (SELECT doc_id, strlen(text) * (doc_id % 50) * (doc_id % 50) * (doc_id % 50) AS n FROM documents) SELECT doc_id, {SIZE.format(' ')} AS size, replace({SIZE.format(' ')}, '.0 ', ' ') AS trimmed FROM d")
def q_format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord") % 50
    n = F.octet_length("content") * k * k * k
    return virtual.documents(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.format_file_size(n).alias("size"), T.format_file_size_trimmed(n).alias("trimmed"))


@query("""WITH d AS (SELECT doc_id, length(text) * (doc_id % 30) AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 10000 THEN floor(n / 1000 + 0.5)::BIGINT || 'k tokens' WHEN n >= 1000 THEN printf('%.1fk tokens', floor(n / 100 + 0.5) / 10) ELSE n || ' tokens' END AS v1,
           CASE WHEN n >= 1000 THEN floor(n / 1000 + 0.5)::BIGINT || 'k tokens' ELSE n || ' tokens' END AS v2,
           CASE WHEN n >= 1000 THEN printf('%.1fK', floor(n / 100 + 0.5) / 10) ELSE n::VARCHAR END AS v3 FROM d""")
def q_format_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("content") * (F.col("ord") % 30)
    return virtual.documents(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.format_token_count(n).alias("v1"), T.format_token_count_rounded(n).alias("v2"), T.format_token_count_short(n, "K").alias("v3"))


EXTENSIONS = ("ts", "py", "min.js", "min.css", "css", "md", "json", "rs", "tar", "html", "kt", "MD")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under names with many extensions."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("ord") % len(EXTENSIONS) + 1).cast("int"))
    return virtual.documents(spark, sf_dir).withColumn("file", F.concat(F.lit("src/"), "lang", F.lit("/f"), F.col("ord").cast("string"), F.lit("."), ext))


NAMED = f"named AS (SELECT 'src/' || lang || '/f' || doc_id || '.' || ({list(EXTENSIONS)})[doc_id % {len(EXTENSIONS)} + 1] AS file, text AS content, doc_id AS ord, lang FROM documents)"
MULTIPLIER = "CASE WHEN regexp_matches(lower(file), '\\.min\\.(js|css)$') THEN 2.5 WHEN lower(file[-3:]) IN ('.ts', '.py', '.rs') THEN 3.5 WHEN regexp_matches(lower(file), '\\.(json|html)$') THEN 4.5 WHEN lower(file[-3:]) = '.md' THEN 5.0 ELSE 4.0 END"


@query(f"WITH {NAMED} SELECT file, ({MULTIPLIER})::DOUBLE AS multiplier, ceil(strlen(content) / ({MULTIPLIER}))::BIGINT AS tokens FROM named")
def q_token_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("file")
    return named(spark, sf_dir).select("file", T.token_multiplier(f).alias("multiplier"), T.file_tokens(f, F.octet_length("content"), F.lit(0), F.lit(0)).alias("tokens"))


@query(f"""WITH {NAMED} SELECT file, CASE lower(regexp_extract(file, '([^.]*)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'css' THEN 'css' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'rs' THEN 'rust' WHEN 'html' THEN 'html' WHEN 'kt' THEN 'kotlin' END AS language,
    CASE regexp_extract(file, '([^.]*)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' WHEN 'rs' THEN 'rust' WHEN 'kt' THEN 'kotlin' ELSE regexp_extract(file, '([^.]*)$', 1) END AS fence FROM named""")
def q_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("file", L.detect_language(F.col("file")).alias("language"), L.extract_fence(F.col("file")).alias("fence"))


@query(f"WITH {NAMED} SELECT file, substr(file, 5) AS cleaned, lower(regexp_replace(replace(file, '/', '.'), '[.]+', '.', 'g')) AS context FROM named")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("file", T.clean_path(F.col("file")).alias("cleaned"), T.sanitize_context(F.col("file")).alias("context"))


@query(f"WITH {DOCS} SELECT file FROM docs WHERE regexp_matches(file, '^src1[^/]*/en/[^/]*\\.txt$') OR regexp_matches(regexp_extract(file, '[^/]*$'), '^src1[^/]*/en/[^/]*\\.txt$')")
def q_glob_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).where(globs.any_match(F.col("file"), ["src1*/en/*.txt"])).select("file")


@query(f"WITH {DOCS} SELECT file FROM docs WHERE regexp_matches(file, '/[^/]*7\\.txt$')")
def q_glob_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).where(globs.any_match(F.col("file"), ["*7.txt"], "base")).select("file")


@query(f"WITH {DOCS} SELECT file FROM docs WHERE (starts_with(file, 'src2/') OR lang IN ('de', 'fr')) AND NOT regexp_matches(file, '/[0-9]5\\.txt$')")
def q_glob_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = globs.path_filter(F.col("file"), ["src2/**", "**/{de,fr}/*"], ["**/?5.txt"], "full")
    return virtual.documents(spark, sf_dir).where(kept).select("file")


@query(f"WITH {DOCS} SELECT file FROM docs ORDER BY file LIMIT 100")
def q_limit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).orderBy("file").limit(100).select("file")


@query("SELECT CASE WHEN quality = 1 THEN 'class' ELSE 'mixin' END AS type, count(*) AS n, min(doc_id) AS first FROM labels GROUP BY 1")
def q_type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("type", F.when(F.col("quality") == 1, "class").otherwise("mixin"))
    return labels.groupBy("type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(tree.rank(tree.GROUP_ORDER), "type")


@query("SELECT doc_id, length(regexp_replace(left(text, 1024), '[^ -~\\t\\n\\r]', '', 'g'))::DOUBLE / length(left(text, 1024)) > 0.95 AS is_text FROM documents")
def q_text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.left("content", F.lit(1024))
    return virtual.documents(spark, sf_dir).select(F.col("ord").alias("doc_id"), (F.length(F.regexp_replace(sample, r"[^ -~\t\n\r]", "")) / F.length(sample) > 0.95).alias("is_text"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM documents")
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.documents(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.preview(F.col("content"), 80).alias("preview"))


@query(f"""WITH e AS (SELECT event_id, date_diff('second', date_trunc('second', ts::TIMESTAMP), TIMESTAMP '{NOW}') % ((event_id % 5) * 40000 + 50) AS s FROM events)
    SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd ago' WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE 'just now' END AS age FROM e""")
def q_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = (F.unix_timestamp(now) - F.unix_timestamp("ts")) % ((F.col("event_id") % 5) * 40000 + 50)
    return events.select("event_id", T.relative_time(F.timestamp_seconds(F.unix_timestamp(now) - s), now).alias("age"))


def _diff_text(file: Column, content: Column, number: Column) -> Column:
    head = F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n"))
    kind = F.when(number % 3 == 0, "new file mode 100644\n").when(number % 3 == 1, "deleted file mode 100644\n").otherwise("index 1..2\n")
    sign = F.when(number % 3 == 1, "-").otherwise("+")
    body = F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1 +1 @@\n"), sign, F.replace(content, F.lit("\n"), F.concat(F.lit("\n"), sign)), F.lit("\n same\n"))
    return F.concat(head, kind, body)


@query(f"""WITH {DOCS} SELECT file, (['added', 'deleted', 'modified'])[ord % 3 + 1] AS status,
    (CASE WHEN ord % 3 = 1 THEN 0 ELSE len(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(x, '++'))) END)::BIGINT AS additions,
    (CASE WHEN ord % 3 = 1 THEN len(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(x, '--'))) ELSE 0 END)::BIGINT AS deletions FROM docs""")
def q_diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    text = docs.select(_diff_text(F.col("file"), F.col("content"), F.col("ord")).alias("diff_text"))
    return diffs.parse_diff(text).select("file", "status", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    n = F.col("ord").cast("string")
    source = F.concat(F.lit("import os\nfrom m"), n, F.lit(" import a, b as c\nLIMIT_"), n, F.lit(" = "), n, F.lit("\n_hidden = 1\nclass C"), n, F.lit("(Base, M):\n    def __init__(self, x):\n        self.x = x\n    def run(self, y: int = 1) -> str:\n        return y\n    async def go(self): pass\ndef f"), n, F.lit("(p, q=2) -> int:\n    return p\ndef _g(): pass\n"))
    return docs.select(F.concat(F.lit("src/m"), n, F.lit(".py")).alias("file"), source.alias("content"))


@query("""SELECT 'src/m' || doc_id || '.py' AS file, unnest([0, 1, 2]) AS ord, unnest(['f' || doc_id, 'LIMIT_' || doc_id, 'C' || doc_id]) AS name, unnest(['function', 'const', 'class']) AS type,
    unnest(['def f' || doc_id || '(p, q=2) -> int', 'LIMIT_' || doc_id || ' = ' || doc_id, 'class C' || doc_id || '(Base, M)']) AS signature, unnest([11, 3, 5]) AS start_line,
    unnest(['', '', 'def run(y: int = 1) -> str; async def go()']) AS members FROM documents""")
def q_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = distill.symbols(distill.parse(python_files(spark, sf_dir)))
    return s.select("file", "ord", "name", "type", "signature", "start_line", F.array_join(F.transform("members", lambda m: m["signature"]), "; ").alias("members"))


@query("SELECT 'src/m' || doc_id || '.py' AS file, unnest(['os', 'm' || doc_id]) AS source, unnest(['os', 'a c']) AS names, unnest([1, 2]) AS line FROM documents")
def q_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = distill.imports(distill.parse(python_files(spark, sf_dir)))
    return i.select("file", "source", F.array_join(F.transform("specifiers", lambda s: s["name"]), " ").alias("names"), "line")


@query("SELECT 'src/m' || doc_id || '.py' AS file, unnest(['_hidden', '__init__', '_g']) AS name, 'private' AS reason, unnest([4, 6, 13]) AS line FROM documents WHERE true")
def q_python_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = python_files(spark, sf_dir).withColumn("content", F.replace(F.col("content"), F.lit("_hidden = 1"), F.lit("_hidden: int = 1")))
    return distill.skipped(distill.parse(source))


@query("SELECT 'src/m' || doc_id || '.py' AS file, 'os m' || doc_id AS imports, 'f' || doc_id || ' LIMIT_' || doc_id || ' C' || doc_id AS exports FROM documents")
def q_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distill.dependencies(distill.parse(python_files(spark, sf_dir)))
    return d.select("file", F.array_join("imports", " ").alias("imports"), F.array_join("exports", " ").alias("exports"))


def ts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = virtual.documents(spark, sf_dir)
    n = F.col("ord").cast("string")
    source = F.concat(F.lit("import d, { a as b } from './m"), n, F.lit("';\nexport class K"), n, F.lit(" extends L implements I {\n  private h = 1;\n  name: string = 'x';\n  constructor(x: number) { this.h = x; }\n  greet() { return 'Hi ' + this.name; }\n}\nexport const N"), n, F.lit(" = "), n, F.lit(";\nexport interface I"), n, F.lit(" { z: string }\nexport function f"), n, F.lit("(a: number): void {}\n"))
    return docs.select(F.concat(F.lit("src/t"), n, F.lit(".ts")).alias("file"), source.alias("content"))


@query("""SELECT 'src/t' || doc_id || '.ts' AS file, unnest([0, 1, 2, 3]) AS ord, unnest(['I' || doc_id, 'K' || doc_id, 'f' || doc_id, 'N' || doc_id]) AS name, unnest(['interface', 'class', 'function', 'const']) AS type,
    unnest(['interface I' || doc_id, 'class K' || doc_id || ' extends L implements I', 'function f' || doc_id || '(a: number): void', 'const N' || doc_id || ': ' || doc_id || ' = ' || doc_id]) AS signature,
    unnest(['z: string', 'constructor(x: number); name: string; greet(): string', '', '']) AS members FROM documents""")
def q_typescript_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = distill.symbols(distill.parse(ts_files(spark, sf_dir)))
    return s.select("file", "ord", "name", "type", "signature", F.array_join(F.transform("members", lambda m: m["signature"]), "; ").alias("members"))


@query("""WITH p AS (SELECT doc_id, length(doc_id::VARCHAR) AS k FROM documents), t AS (
        SELECT (ceil((20 + k) / 4.0) + ceil((9 + 2 * k) / 4.0) + ceil((16 + k) / 4.0) + 7 + 4)::BIGINT AS d FROM p)
    SELECT count(*) AS file_count, sum(d)::BIGINT AS distilled_tokens FROM t""")
def q_distill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = python_files(spark, sf_dir)
    return distill.metrics(files, distill.parse(files)).select("file_count", "distilled_tokens")


@query("""SELECT (doc_id // 100)::BIGINT AS package, string_agg('<file path="m' || doc_id || '.py">' || chr(10) || 'import ''os''' || chr(10) || 'import ''m' || doc_id || '''' || chr(10)
        || 'export class C' || doc_id || ' {' || chr(10) || '    def run(y: int = 1) -> str' || chr(10) || '    async def go()' || chr(10) || '}' || chr(10)
        || 'export def f' || doc_id || '(p, q=2) -> int' || chr(10) || 'export LIMIT_' || doc_id || ' = ' || doc_id || chr(10) || '</file>', chr(10) || chr(10) ORDER BY 'src/m' || doc_id || '.py') AS document
    FROM documents GROUP BY ALL""")
def q_distill_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files, a document for each hundred: one text for all would grow with the table."""
    options = DistillOptions()
    parsed = distill.parse(distill.pick(python_files(spark, sf_dir), options), options)
    package = F.floor(F.regexp_extract("file", r"(\d+)", 1).cast("long") / 100).alias("package")
    return render.distill_txt(parsed.select("*", package), options.private, options.docstrings, by=["package"])
