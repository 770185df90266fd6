"""Merkle manifest of a dataset, in an external-memory store of nodes.

Every row is a leaf: the sha256 of its fields, each with its length. Leaves are sorted by range into runs, group by group
(of sources), and numbered by the runs' counts: a leaf's coordinate is its tree and its place there. A pass reads one
level in the order of the coordinates, block by block of ARITY ** height nodes, and streams the next ``height`` levels out, each
made from the one before, into Parquet partitioned by level; the next pass starts at the last of them. So a table of N
rows takes log(N) / log(ARITY ** height) passes, a block is all that a task holds, and no block is larger than another,
whatever a group's share of the rows. The trees' roots are the leaves of one more tree.

Proofs are found from the top: the stored levels and the leaves, sorted by coordinate, are merged in one scan for each
pass, which adds to the path of a block the siblings inside the block. A proof is an array of steps from the leaf to the
root, each with the digests left and right of the own one; ``fold`` is a Spark expression that recomputes the root.

A null field is ``-``; null, empty and white-space texts so differ. A null group is a tree of its own, the first. Rows with
a null key come first in their tree. Rows with the same key are ordered by leaf, so that equal rows may stand for each
other. A group of one row has the leaf itself as its root, one group alone its own root as the whole root; no rows
give no proofs. Columns that are not fields do not matter; their names may be anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import scratch_path, stored
from .ordering import by_key, run_offsets, sorted_runs

ARITY = 3
#: Levels a pass.
HEIGHT = 6

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


def fold(proof: Column, start: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    steps = F.transform(proof, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


def parents(nodes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(nodes), ARITY)]


class Manifest(NamedTuple):
    """Paths of a store: leaves (tree, place, size, leaf, key, group, further columns), nodes (tree, place, size, node, level)
    of the groups' trees and of the tree over their roots."""

    leaves: str
    nodes: str
    top_leaves: str
    top: str
    columns: tuple[str, ...]
    height: int

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        """``leaves`` or ``nodes``, of all trees; ``top_leaves`` or ``top``."""
        path = getattr(self, part)
        if part.endswith("leaves"):
            return spark.read.parquet(path)
        return spark.read.schema("tree long, place long, size long, node string, level int").parquet(path)


def _blocks(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows (tree, block, ...) with those of a block together, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _climb(batches: Iterator[pa.RecordBatch], base: int, height: int) -> Iterator[pa.RecordBatch]:
    names = ["tree", "place", "size", "node", "level"]
    for table in by_key(batches, 2):
        tree, block, size = (table.column(c)[0].as_py() for c in ("tree", "block", "size"))
        nodes, width = table.column("node").to_pylist(), ARITY**height
        for level in range(base + 1, base + height + 1):
            if size == 1:
                break
            nodes, size, width = parents(nodes), -(-size // ARITY), width // ARITY
            n = len(nodes)
            place = np.arange(n, dtype=np.int64) + block * width
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, tree, np.int64)), pa.array(place), pa.array(np.full(n, size, np.int64)), pa.array(nodes), pa.array(np.full(n, level, np.int32))], names=names
            )


def grow(nodes: DataFrame, path: str, height: int) -> None:
    """Writes all levels above the nodes (tree, place, size, node) below ``path``, partitioned by level."""
    spark, level = nodes.sparkSession, 0
    out = "tree long, place long, size long, node string, level int"
    while not nodes.where("size > 1").isEmpty():
        blocks = _blocks(nodes.where("size > 1").select("tree", F.expr(f"place div {ARITY**height}").alias("block"), "place", "size", "node"), F.col("place"))
        blocks.mapInArrow(lambda b, base=level: _climb(b, base, height), out).write.partitionBy("level").mode("append").parquet(path)
        level += height
        nodes = spark.read.schema(out).parquet(path).where(f"level = {level}")
    if level == 0:  # trees of single nodes
        spark.createDataFrame([], out).write.partitionBy("level").mode("append").parquet(path)


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = (), path: str | None = None, height: int = HEIGHT) -> Manifest:
    """Writes the store of docs below ``path`` (a scratch folder if None). ``carry``: columns to keep beside the leaves."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "merkle")
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf(*map(F.col, fields)).alias("leaf"), *[F.col(c).alias(f"with_{c}") for c in carry])
    rows, _ = stored(rows, "leaves")
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())  # spreads rows that are equal over the runs
    runs, _ = sorted_runs(numbered, [F.col(c) for c in ("group", "key", "leaf", "tie")], "runs")
    groups, _ = stored(run_offsets(runs, "group"), "groups")
    tops, _ = sorted_runs(groups.select("group").distinct().withColumn("all", F.lit(0)), [F.col("group")], "trees")
    trees = tops.join(run_offsets(tops, "all").drop("all"), "run").select("group", (F.col("offset") + F.col("mid")).alias("tree"), F.col("size").alias("trees"))
    trees, _ = stored(trees, "trees")
    places = groups.join(trees, groups["group"].eqNullSafe(trees["group"])).select(groups["group"].alias("of_group"), F.col("run").alias("of_run"), "offset", "size", "tree")
    found = runs.join(places, (F.col("run") == F.col("of_run")) & F.col("group").eqNullSafe(F.col("of_group")))
    found = found.select("tree", (F.col("offset") + F.col("mid")).alias("place"), "size", "leaf", "key", "group", *[f"with_{c}" for c in carry])
    store = Manifest(*(f"{path}/{part}" for part in ("leaves", "nodes", "top_leaves", "top")), (key, group, *carry), height)
    found.write.parquet(store.leaves)
    leaves = spark.read.schema(found.schema).parquet(store.leaves)
    grow(leaves.select("tree", "place", "size", F.col("leaf").alias("node")), store.nodes, height)
    roots = leaves.where("size = 1").select("tree", F.col("leaf").alias("node")).unionByName(store.read(spark, "nodes").where("size = 1").select("tree", "node"))
    roots = roots.join(trees, "tree").select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("size"), "node")
    roots.write.parquet(store.top_leaves)
    grow(spark.read.schema(roots.schema).parquet(store.top_leaves), store.top, height)
    return store


def _steps(levels: list[list[str]]) -> list[list[dict]]:
    """For each level of a block, each node's step."""
    out = []
    for nodes in levels:
        steps = []
        for i in range(0, len(nodes), ARITY):
            run = nodes[i : i + ARITY]
            steps += [{"left": "".join(run[:k]), "right": "".join(run[k + 1 :])} for k in range(len(run))]
        out.append(steps)
    return out


STEP_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch], names: list[str], out: pa.Schema, height: int, part: int = 500) -> Iterator[pa.RecordBatch]:
    """Of each block: the path above it, its nodes by level from above, then the rows below."""
    for table in by_key(batches, 2):
        level = table.column("level").to_numpy()
        size = table.column("size")[-1].as_py()
        depth = 0
        while size > 1 and depth < height:
            size, depth = -(-size // ARITY), depth + 1
        node = table.column("node")
        levels = [node.filter(pa.array(level == k)).to_pylist() for k in range(depth)]
        steps = _steps(levels)
        above = next((x for x in table.column("above")[:1].to_pylist() if x is not None), [])
        root, subroot = table.column("root")[0], table.column("subroot")[0]
        rows = table.filter(pa.array(level == 0)).select(names)
        for i in range(0, rows.num_rows, part):
            some = rows.slice(i, part).combine_chunks()
            paths = [[s[p // ARITY**k] for k, s in enumerate(steps)] + above for p in range(i, i + some.num_rows)]
            columns = [*(c.combine_chunks() for c in some.columns), pa.array(paths, STEP_TYPE), *(pa.array([x.as_py()] * some.num_rows, pa.string()) for x in (subroot, root))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def _descend(rows: DataFrame, nodes: DataFrame, above: DataFrame, base: int, height: int) -> DataFrame:
    """rows (tree, place, size, node, ...) of level ``base`` with proof, subroot and root. nodes: the levels above; above:
    (tree, block, above, subroot, root), the path of each block's own root."""
    names = rows.columns
    inner = nodes.where(f"level > {base} AND level < {base + height}").withColumn("level", F.col("level") - base)
    inner = inner.select("tree", "place", "node", "level", F.expr(f"place div cast(power({ARITY}, {height} - level) as bigint)").alias("block"))
    heads = above.withColumn("level", F.lit(height + 1)).withColumn("place", F.lit(0).cast("long"))
    mine = rows.withColumn("level", F.lit(0)).withColumn("block", F.expr(f"place div {ARITY**height}"))
    both = heads.unionByName(inner, allowMissingColumns=True).unionByName(mine, allowMissingColumns=True)
    both = both.select("tree", "block", "level", "above", "subroot", "root", *names[1:])
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"proof {STEPS}, subroot string, root string").fields])
    out = to_arrow_schema(schema)
    return _blocks(both, F.desc("level"), F.col("place")).mapInArrow(lambda b: _scan(b, names, out, height), schema)


def _paths(rows: DataFrame, nodes: DataFrame, ends: DataFrame, height: int) -> DataFrame:
    """rows (tree, place, size, node, ...) of level 0 with proof, subroot and root; ends: (tree, above, subroot, root), the
    path of each tree's root."""
    most = nodes.agg(F.max("level")).first()[0] or 0
    above = ends.withColumn("block", F.lit(0).cast("long"))
    for base in range((max(0, most - 1) // height) * height, 0, -height):
        # roots of the blocks below; trees that end further down have their path already
        found, _ = stored(_descend(nodes.where(f"level = {base} AND size > 1").select("tree", "place", "size", "node"), nodes, _taller(above, nodes, base), base, height), "paths")
        lower = found.select("tree", F.col("place").alias("block"), F.col("proof").alias("above"), "subroot", "root")
        tall = found.select("tree").distinct()
        above = above.join(tall, "tree", "left_anti").unionByName(lower)
    return _descend(rows, nodes, above, 0, height)


def _taller(above: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """Of the paths, those of trees that go beyond level ``base``."""
    return above.join(nodes.where(f"level = {base} AND size > 1").select("tree").distinct(), "tree", "left_semi")


def proofs(spark: SparkSession, store: Manifest) -> DataFrame:
    """For each leaf: the key, the group and further columns under their own names, leaf, tree, place, proof, subroot, root."""
    none = F.array().cast(STEPS)
    top_leaves, top = store.read(spark, "top_leaves"), store.read(spark, "top")
    whole = top.where("size = 1").select("node").unionByName(top_leaves.where("size = 1").select("node"))
    root = whole.select(F.lit(-1).cast("long").alias("tree"), none.alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    ends = _paths(top_leaves, top, root, store.height).select(F.col("place").alias("tree"), F.col("proof").alias("above"), F.col("node").alias("subroot"), "root")
    ends, _ = stored(ends, "ends")
    leaves = store.read(spark, "leaves").withColumnRenamed("leaf", "node")
    found = _paths(leaves, store.read(spark, "nodes"), ends, store.height)
    names = [F.col(c).alias(n) for c, n in zip(("key", "group", *[f"with_{c}" for c in store.columns[2:]]), store.columns, strict=True)]
    return found.select(*names, F.col("node").alias("leaf"), "tree", "place", "proof", "subroot", "root")
