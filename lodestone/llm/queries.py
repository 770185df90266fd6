"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, jaccard, licenses, licensetexts, linededup, merkle, pieces, resampling, rules, sharding, simhash, tokenfile, urls
from .common import scratch_path, table

URL_RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]
#: The block list of the query: these names under each of the registries.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = tuple(f"{name}.example.{end}" for name in BLOCKED_NAMES for end in ("com", "net", "org"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def piece_settings() -> pieces.Settings:
    return pieces.Settings(tokenizer_path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), piece_settings())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[f"judged.{n}" for n in names])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts="lines")
    return kept.select("doc_id", "lines.*", "text")


def op4_line_dedup_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as op4_line_dedup, from when that one left lines of 1 to 4 words alone."""
    return op4_line_dedup(spark, sf_dir)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = lambda: tokenfile.byte_level_encoder(tokenizer_path("byte_bpe_50k.json"))
    written = tokenfile.write_tokens(docs, scratch_path(spark, "tokens"), encoder, vocabulary=50_257, end_id=2)
    return tokenfile.read_tokens(spark, written)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")


def op6_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole notices in order, versions and variants apart."""
    return licensetexts.scan_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_texts.*")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES, BLOCKED_DOMAINS).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = {"text": F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    docs = docs.withColumn("altered", merkle.leaf(*[tampered.get(f, F.col(f)) for f in merkle.FIELDS]))
    proofs = merkle.proofs(spark, merkle.build(docs, carry=("altered",)))
    folded = merkle.fold(F.col("proof"), F.col("altered"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _url_sql() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest)
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS)
    return f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        )
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
        FROM parts"""


def _license_sql(threshold: float = 0.8) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def starts(phrase: str) -> str:
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        return f"list_filter(generate_series(1, len(w) - {len(parts) - 1}), lambda i: {same})"

    templates = ", ".join(f"('{label}', {licenses.template_words(text)})" for label, text in licenses.TEMPLATES.items())
    each = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.PHRASES.values()))
    every = " || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))
    return f"""
        WITH templates(label, t) AS (VALUES {templates}),
        low AS (SELECT doc_id, {lower} AS s FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(s, '{pattern}') AS w FROM low),
        base AS (SELECT doc_id, len(w) AS n_words, {", ".join(f"{starts(p)} AS p{k}" for k, p in enumerate(licenses.PHRASES))} FROM d),
        lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(s, chr(10))), '{pattern}')) AS b FROM low),
        hits AS (
            SELECT doc_id, label, len(list_intersect(b, t)) * 1.0 / len(t) AS score FROM lines, templates
            WHERE len(list_intersect(b, t)) >= {threshold} * len(t) - 1e-9
        ),
        found AS (SELECT doc_id, list(label) AS labels, max(score) AS score FROM hits GROUP BY doc_id),
        places AS (SELECT *, {every} AS p, list_filter([{each}], lambda x: x IS NOT NULL) AS b FROM base)
        SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, (list_min(p) - 1)::BIGINT AS first_word, (list_max(p) - 1)::BIGINT AS last_word,
               coalesce(array_to_string(list_sort(list_distinct(b)), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(b || coalesce(labels, []))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM places LEFT JOIN found USING (doc_id)"""


def _leak_sql(percent: int = 80) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def worded(key: str, source: str) -> str:
        lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"(SELECT row_number() OVER () AS k, {key}, regexp_extract_all({lower}, '{pattern}') AS w FROM {source})"

    def runs(n: str) -> str:
        return f"unnest(list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS s"

    return f"""
        WITH dw AS {worded("doc_id", "documents")}, bw AS {worded("item_id", "benchmark")},
        lengths AS (SELECT DISTINCT len(w) AS m FROM bw WHERE len(w) BETWEEN 1 AND 4),
        d AS (SELECT DISTINCT k, doc_id, {runs("5")} FROM dw WHERE len(w) >= 5 UNION ALL SELECT DISTINCT k, doc_id, {runs("m")} FROM dw, lengths WHERE len(w) >= m),
        b AS (SELECT DISTINCT k, item_id, {runs("least(len(w), 5)")} FROM bw WHERE len(w) > 0),
        sizes AS (SELECT k, count(*) AS n_item FROM b GROUP BY k),
        common AS (SELECT d.k AS dk, doc_id, b.k AS bk, item_id, count(*) AS n_common FROM d JOIN b USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_common::BIGINT AS n_common, n_common / n_item AS containment
        FROM common JOIN sizes ON bk = k WHERE 100 * n_common >= {percent} * n_item"""


def _word_sql(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x20\x09-\x0D]+')"


SHINGLE_SQL = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))"


def _line_sql(percent: int = 80) -> str:
    shingles = f"CASE WHEN len(w) >= 5 THEN {SHINGLE_SQL} ELSE [k] END"
    return f"""
        WITH lines AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        words AS (SELECT doc_id, t, line, {_word_sql("t")} AS w FROM lines),
        keyed AS (SELECT doc_id, t, line, w, array_to_string(w, ' ') AS k FROM words),
        sets AS (SELECT k, min({{'d': doc_id, 'l': line}}) AS first, any_value(w) AS w FROM keyed WHERE len(w) > 0 GROUP BY k),
        tokens AS (SELECT k, unnest({shingles}) AS s FROM sets),
        sizes AS (SELECT k, count(*) AS n FROM tokens GROUP BY k),
        common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM tokens a JOIN tokens b USING (s) GROUP BY ALL),
        earliest AS (
            SELECT a AS k, min(first) AS first FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b JOIN sets ON sets.k = b
            WHERE 100 * c >= {percent} * (x.n + y.n - c) GROUP BY a
        ),
        judged AS (SELECT doc_id, line, t, coalesce(first < {{'d': doc_id, 'l': line}}, false) AS gone FROM keyed LEFT JOIN earliest USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text
        FROM judged GROUP BY doc_id"""


def _jaccard_sql(percent: int = 80) -> str:
    return f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_word_sql("coalesce(text, '')")} AS w FROM documents),
        tokens AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN {SHINGLE_SQL} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(b)) AS component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op4_line_dedup_short": op4_line_dedup_short,
    "op5_token_files": op5_token_files,
    "op6_license_scan": op6_license_scan,
    "op6_license_texts": op6_license_texts,
    "op7_html_text": op7_html_text,
    "op8_shards": op8_shards,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}

SQL = {
    "op1_decontamination": _leak_sql(),
    "op4_line_dedup": _line_sql(),
    "op4_line_dedup_short": _line_sql(),
    "op6_license_scan": _license_sql(),
    "op6_license_texts": licensetexts.texts_sql(),
    "op9_jaccard_join": _jaccard_sql(),
    "op10_url_filter": _url_sql(),
}
