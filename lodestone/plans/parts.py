"""Documents over many tasks: blocks in order as numbered rows, or as pieces of text with their places in the whole.

The blocks are cut into ranges of their order and sorted within each; a range's rows and bytes are counted, and the sums
of the ranges before it give each row its number and each piece its offset. No task and no row holds more than a range or a
piece, and only the ranges' sums meet in one place. A file of the pieces is written by ``write``: every task puts its own at
their offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import stored

#: Bytes of a piece, if no block is longer.
PIECE = 1 << 20


def ranges(blocks: DataFrame) -> DataFrame:
    """blocks (ord, block) in sorted ranges, with ``part`` and the row's rising number ``mid``. Null blocks are left out."""
    cut = blocks.where("block IS NOT NULL").repartitionByRange("ord").sortWithinPartitions("ord")
    return cut.withColumn("mid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mid", 33))


def before(sums: DataFrame, of: str) -> DataFrame:
    """sums (part, ...), one row a range, with what the ranges before it have of a column, as ``base``."""
    return sums.withColumn("base", F.sum(of).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(of))


def numbered(blocks: DataFrame) -> DataFrame:
    """(place, block): each block with its number in the whole order, from 0."""
    cut = stored(ranges(blocks).select("part", "mid", "block"), "ranges")
    starts = before(cut.groupBy("part").agg(F.count("*").alias("n"), F.min("mid").alias("first")), "n")
    return cut.join(starts, "part").select((F.col("base") + F.col("mid") - F.col("first")).alias("place"), "block")


def pieces(blocks: DataFrame, head: str = "", foot: str = "", separator: str = "\n", size: int = PIECE) -> DataFrame:
    """(offset, text): the document of render.framed, or of render.document without head and foot, in pieces of about ``size``
    bytes; offsets count bytes of UTF-8. A framed document without any text in its blocks is head and foot."""
    spark = blocks.sparkSession
    schema = pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("bytes", pa.int64()), ("text", pa.string())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        n, piece, part = 0, 0, None

        def out() -> pa.RecordBatch:
            text = "".join(separator + b for b in held)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([piece], pa.int64()), pa.array([len(text.encode())], pa.int64()), pa.array([text])], schema=schema)

        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n >= size:
                    yield out()
                    held, n, piece = [], 0, piece + 1
                held.append(block)
                n, part = n + len(block), p
        if held:
            yield out()

    made = stored(ranges(blocks).select("part", "block").mapInArrow(gather, "part long, piece long, bytes long, text string"), "pieces")
    starts = before(made.groupBy("part").agg(F.sum("bytes").alias("n")), "n").select("part", "base")
    inside = F.sum("bytes").over(W.partitionBy("part").orderBy("piece").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bytes")
    whole = made.join(starts, "part").withColumn("at", F.col("base") + inside)
    lead, cut = len(head.encode()), len(separator.encode())
    text = F.when(F.col("at") == 0, F.substring("text", len(separator) + 1, 1 << 30)).otherwise(F.col("text"))
    body = whole.select((F.greatest(F.col("at") - cut, F.lit(0)) + lead).alias("offset"), text.alias("text"))
    if not head and not foot:
        return body
    first = spark.range(1).select(F.lit(0).cast("long").alias("offset"), F.lit(head).alias("text"))
    last = made.agg(F.sum("bytes").alias("n")).select((F.lit(lead) + F.coalesce(F.col("n") - cut, F.lit(0))).alias("offset"), F.when(F.col("n") > cut, "\n").otherwise("").alias("gap"))
    return first.unionByName(body).unionByName(last.select("offset", F.concat("gap", F.lit(foot)).alias("text"))).where("text <> ''")


def write(pieces: DataFrame, path: str) -> str:
    """Writes pieces (offset, text) to one file on a folder that driver and executors share; returns its path. The file
    appears whole, when all tasks have ended well."""
    from ..sources.document import DocumentSource

    pieces.sparkSession.dataSource.register(DocumentSource)
    pieces.select("offset", "text").write.format("document").mode("overwrite").save(path)
    return path
