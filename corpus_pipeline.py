"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's documents.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents; n_chars
follows the text where a stage changes it. Quality rules drop what they reject, line dedup takes repeated lines out
of the texts and drops documents of which nothing is left, the Jaccard join leaves of each group of linked documents the
one with the smallest doc_id, decontamination drops documents that hold a benchmark item, and the last stage turns texts
into SentencePiece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, jaccard, linededup, pieces, queries, rules
from lodestone.llm.common import delete, fresh, scratch_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.judge(docs, table(spark, sf_dir, "labels"), name="_judged").where(F.col("_judged.kept")).drop("_judged")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document all of whose lines with words stand in earlier ones goes."""
    lines = fresh(docs, "lines")
    kept = linededup.dedup_lines(docs, counts=lines)
    emptied = (F.col(lines)["n_removed"] > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = kept.where(~F.coalesce(emptied, F.lit(False))).drop(lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_linked(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces; the text is what the ids decode to."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), queries.piece_settings()).drop("text")
    return coded.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: The learned decision list and the seeded merge-dropout have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
