"""Connected components by contraction, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, stored

#: Rows of a file, where the number of edges is known.
ROWS_A_FILE = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> tuple[DataFrame, str]:
    """(node, root) of every node of the edges, root the smallest node that it reaches; and the path of the table.

    Each round every root hooks to its smallest neighbour, pointers jump twice, and the edges are rewritten to roots;
    those inside a component vanish. Only tables on shared storage pass from round to round. Nothing is collected but
    whether edges are left. A node with very many neighbours costs a partial aggregation, not a gathered list. Nodes
    should be hashes, as those of the operators here are: a long chain of rising numbers sheds but three nodes a round.
    With the number of edges as ``rows``, the tables are written in as many files as that number asks for.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        return stored(df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE))), name)

    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left, left_path = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, labels_path = kept(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks, hooks_path = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("child"), F.least("a", "m").alias("parent")), "hooks")
        once = _jump(hooks, hooks)
        twice, twice_path = kept(_jump(once, hooks), "jumps")
        moved = labels.join(twice, labels["root"] == twice["child"], "left").select("node", F.coalesce("parent", "root").alias("root"))
        new_labels, new_labels_path = kept(moved, "labels")
        p, q = twice.select(F.col("child").alias("a"), F.col("parent").alias("pa")), twice.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        rewritten = left.join(p, "a").join(q, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        new_left, new_left_path = kept(rewritten, "edges")
        for path in (left_path, labels_path, hooks_path, twice_path):
            delete(spark, path)
        left, left_path, labels, labels_path = new_left, new_left_path, new_labels, new_labels_path
    delete(spark, left_path)
    return labels, labels_path


def _jump(pointers: DataFrame, hooks: DataFrame) -> DataFrame:
    nxt = hooks.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    return pointers.join(nxt, pointers["parent"] == nxt["_c"], "left").select("child", F.coalesce("_p", "parent").alias("parent"))
