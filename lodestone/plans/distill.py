"""Distill: files to their public interface, with what it saves."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import parsers
from ..functions import text as T
from ..functions.languages import detect_language
from ..operators import globs
from ..schemas import DistillOptions
from ..sources.tables import stored
from . import parts, render, typing


def compress(files: DataFrame) -> DataFrame:
    """Content with its size in bytes, fingerprint and language."""
    return files.select("file", F.octet_length("content").cast("long").alias("size"), T.fingerprint(F.col("content")).alias("hash"), "content", detect_language(F.col("file")).alias("language"))


def pick(files: DataFrame, options: DistillOptions) -> DataFrame:
    exclude = globs.distill_excludes(include_tests=globs.wants_tests(options.include)) + options.exclude
    return files.where(globs.path_filter(F.col("file"), options.include, exclude, "full"))


def parse(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """Files of a known language, parsed; others are left out."""
    known = {name: parsers._languages[name].extensions for name in parsers.registered()}
    ext = F.concat(F.lit("."), F.lower(F.substring_index("file", ".", -1)))
    of = lambda *names: files.where(ext.isin([e for n in names for e in known[n]]))
    if options is None or options.types != "inferred" or "typescript" not in known:
        return parsers.parse_files(of(*known), options)
    others = parsers.parse_files(of(*[n for n in known if n != "typescript"]), options)
    return typing.infer(of("typescript"), options).unionByName(others)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("exports").alias("ord", "e")).select("file", "ord", "e.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.posexplode("imports").alias("ord", "i")).select("file", "ord", "i.*")


def skipped(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("skipped"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("errors"))


def dependencies(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.transform("imports", lambda i: i["source"]).alias("imports"), F.transform("exports", lambda e: e["name"]).alias("exports"))


def metrics(files: DataFrame, parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each group of ``by``, columns of both): file count, directories, languages, tokens before and after,
    and the ratio. Failed files count as files, not as tokens. Of the files only their lengths are joined with what
    was parsed, and the parsed rows are read once."""
    tokens = lambda x: F.ceil(F.length(x) / 4).cast("long")
    add = lambda a, b: a + b
    zero, by = F.lit(0).cast("long"), by or []
    one = lambda e: tokens(e["signature"]) + F.coalesce(tokens(e["docstring"]), zero) + F.aggregate(F.transform(e["members"], lambda m: tokens(m["signature"])), zero, add)
    sizes = files.select("file", tokens(F.col("content")).alias("tokens"))
    small = parsed.select("file", *by, (F.size("errors") > 0).alias("failed"), F.aggregate(F.transform("exports", one), zero, add).alias("distilled"))
    per = sizes.join(small, "file").select(
        *by, F.when(F.col("failed"), 0).otherwise(F.col("tokens")).alias("original"), "distilled", detect_language(F.col("file")).alias("language"), T.directory(F.col("file")).alias("directory")
    )
    # by language first, so that one aggregate of few rows gives all
    grouped = per.groupBy(*by, "language").agg(
        F.count("*").alias("n"), F.collect_set(F.nullif("directory", F.lit(""))).alias("folders"), F.sum("original").alias("original"), F.sum("distilled").alias("distilled")
    )
    counted = F.array_sort(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n"))))
    totals = grouped.groupBy(*by).agg(
        F.coalesce(F.sum("n"), zero).alias("file_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("folders")))).alias("directories"),
        F.coalesce(F.sum("original"), zero).cast("long").alias("original_tokens"),
        F.coalesce(F.sum("distilled"), zero).cast("long").alias("distilled_tokens"),
        F.map_from_entries(counted).alias("languages"),
    )
    o, d = F.col("original_tokens"), F.col("distilled_tokens")
    return totals.withColumn("compression_ratio", F.when(o > 0, T.js_round((o - d) * 100.0 / o)).otherwise(0))


def dry_run(files: DataFrame, share: float = 0.09) -> DataFrame:
    """What distilling would give: files, bytes, tokens and the estimate."""
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(T.estimate_tokens(F.col("content"))), F.lit(0)).cast("long").alias("tokens"))
    return out.withColumn("estimate", F.ceil(F.col("tokens") * share).cast("long")).withColumn("saved", F.col("tokens") - F.col("estimate"))


def distill(files: DataFrame, options: DistillOptions | None = None) -> DataFrame:
    """One row: the document."""
    options = options or DistillOptions()
    picked = pick(files, options)
    parsed = parse(picked, options)
    renderer = FORMATS.get(options.format) or FORMATS.default()
    return renderer(picked, parsed, options)


def write(files: DataFrame, path: str, options: DistillOptions | None = None) -> str:
    """Writes the document of distill to a file that all executors see, over many tasks but for JSON; returns its whole path."""
    options, path = options or DistillOptions(), os.path.abspath(path)
    if options.format not in ("txt", "md"):
        with open(path, "w", encoding="utf-8") as f:
            f.write(distill(files, options).first().document)
        return path
    parsed = stored(parse(pick(files, options), options), "parsed")
    blocks = render.distill_md_blocks(parsed, options.private) if options.format == "md" else render.distill_txt_blocks(parsed, options.private, options.docstrings)
    return parts.write(parts.pieces(blocks, separator="\n\n"), path)


def distill_path(spark: SparkSession, path: str, options: DistillOptions | None = None) -> DataFrame:
    """The document of a folder or file; also written to options.output, if given."""
    options = options or DistillOptions()
    files = scan(spark, path, options).select("file", "content")
    if options.output:
        write(files, options.output, options)
    return distill(files, options)


#: What distill can write; more can be registered as (files, parsed, options) -> documents.
FORMATS = render.Formats(default="txt")
FORMATS.register("txt", lambda files, parsed, o: render.distill_txt(parsed, o.private, o.docstrings))
FORMATS.register("md", lambda files, parsed, o: render.distill_md(parsed, o.private))
FORMATS.register("json", lambda files, parsed, o: render.distill_json(parsed, metrics(files, parsed), o.private, o.docstrings))


def scan(spark: SparkSession, path: str, options: DistillOptions | None = None) -> DataFrame:
    """The files of a folder that distill works on, or the one file: all depths, dotfiles and whatever .gitignore says
    included; only the patterns and the default excludes count."""
    options = options or DistillOptions()
    exclude = globs.distill_excludes(include_tests=globs.wants_tests(options.include)) + options.exclude
    plain = [p for p in exclude if not p.startswith("!")]
    return corpus(spark, path, dialect="full", include=",".join(options.include), exclude=",".join(plain), gitignore="false", text_only="false", follow_links="true", max_depth="1000000")


def corpus(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The scanner of combine: .gitignore, a look at the text and a greatest depth, unless options say otherwise. Where the
    session has spark.sql.python.filterPushdown.enabled, conditions on file, size and last_modified reach the scanner."""
    from ..sources.corpus import CorpusSource

    spark.dataSource.register(CorpusSource)
    options.setdefault("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return spark.read.format("corpus").options(path=path, **options).load()
