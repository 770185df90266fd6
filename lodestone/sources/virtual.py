"""The driver's tables as virtual files: (file, content, ord) for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file"), F.col("text").alias("content"), F.col("doc_id").alias("ord"), "lang", "source")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return d.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("content"), F.col("page_id").alias("ord"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.select(F.format_string("conv/%d/%d_%s.md", "conv_id", "turn", "role").alias("file"), F.col("text").alias("content"), "conv_id", "turn", "role")


def changes(docs: DataFrame) -> DataFrame:
    """A synthetic change set: the status by doc_id modulo 5, the diff the first half of the text."""
    status = F.element_at(F.array(*map(F.lit, ("added", "modified", "modified", "deleted", "renamed"))), (F.col("ord") % 5 + 1).cast("int"))
    lines = F.size(F.split("content", "\n"))
    return docs.select("file", status.alias("status"), F.floor(lines / 2).cast("int").alias("additions"), F.floor(lines / 4).cast("int").alias("deletions"), F.left("content", F.floor(F.length("content") / 2).cast("int")).alias("diff"), F.lit(None).cast("string").alias("old_file"), "ord")
