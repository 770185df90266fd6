"""Two snapshots of files compared: added, modified, deleted and renamed ones.

Files are matched by path first. Of those left, equal contents are renames, the first of the deleted by name to the first
of the added, and so on. What is still left is matched by likeness: the share of lines that two files have in common (as
multisets) in the longer one. Only pairs that may reach ``similar`` percent are looked at: both must have one of their
rarest lines in common (of n lines as many as a partner cannot all miss), and be of a fitting length. The likest pair is a
rename first, then the likest of what is left; ties go by old, then new path. All of it are joins: in each round the pairs
that are the best for both of their files are taken, until no pairs are left. Where all of some old files are equally like all
of some new ones, and none of them is liker to any other, all of them are paired at once, by their places among the paths.

Lists of files grow with the snapshots, so all joins are by sorting: none of these lists passes through the driver.

Rows without a path are no files. A null content equals an empty one. Of rows with the same path in one snapshot, the
one with the smallest hash counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import stored


def snapshot(files: DataFrame) -> DataFrame:
    """files (file, content) as (file, hash, content), one row a path."""
    text = F.coalesce("content", F.lit(""))
    rows = files.where("file IS NOT NULL").select("file", F.sha2(text, 256).alias("hash"), text.alias("content"))
    return rows.groupBy("file").agg(F.min(F.struct("hash", "content")).alias("x")).select("file", "x.*")


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of which no side is broadcast."""
    return left.join(right.hint("merge"), on, how)


def ranks(df: DataFrame, group: str, order: str, name: str = "rank") -> DataFrame:
    """df with the row's number (from 0) in its group. Groups are cut over sorted ranges, so that one of any size is no task's
    alone."""
    cut = df.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("mid", F.monotonically_increasing_id())
    cut = stored(cut.withColumn("run", F.shiftright("mid", 33)), "runs")
    counts = cut.groupBy(group, "run").agg(F.count("*").alias("c"), F.min("mid").alias("first"))
    before = F.sum("c").over(W.partitionBy(group).orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c") - F.col("first")
    return joined(cut, counts.select(group, "run", before.alias("before")), [group, "run"]).select(*df.columns, (F.col("before") + F.col("mid")).alias(name))


def moved(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """(old_file, file) of equal contents; both (file, hash)."""
    old = ranks(deleted.select(F.col("file").alias("old_file"), "hash"), "hash", "old_file")
    return stored(joined(old, ranks(added.select("file", "hash"), "hash", "file"), ["hash", "rank"]).select("old_file", "file"), "moved")


def line_sets(files: DataFrame) -> DataFrame:
    """(file, side, n, lines): each file's lines as hashes, the k-th equal one a hash of its own, rarest first."""
    lines = files.select("file", "side", F.explode(F.split("content", "\n")).alias("line")).groupBy("file", "side", F.xxhash64("line").alias("line")).count()
    each = lines.select("file", "side", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.xxhash64("line", k))).alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    sets = joined(each, often, "token").groupBy("file", "side").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("s"))
    return sets.select("file", "side", F.size("s").alias("n"), F.transform("s", lambda x: x["token"]).alias("lines"))


def alike(deleted: DataFrame, added: DataFrame, similar: int) -> DataFrame:
    """(old_file, file, similarity) of all pairs that reach ``similar`` percent; both (file, content)."""
    both = deleted.select("file", "content", F.lit("old").alias("side")).unionByName(added.select("file", "content", F.lit("new").alias("side")))
    sets = stored(line_sets(both), "line-sets")
    first = F.slice("lines", F.lit(1), F.col("n") - F.ceil(F.col("n") * similar / 100).cast("int") + 1)
    postings = sets.select("file", "side", "n", F.explode(first).alias("token"))
    old = postings.where("side = 'old'").select("token", F.col("file").alias("old_file"), F.col("n").alias("old_n"))
    new = postings.where("side = 'new'").select("token", "file", "n")
    near = joined(old, new, "token").where(f"100 * least(n, old_n) >= {similar} * greatest(n, old_n)").select("old_file", "file").distinct()
    left = sets.where("side = 'old'").select(F.col("file").alias("old_file"), F.col("n").alias("old_n"), F.col("lines").alias("old_lines"))
    right = sets.where("side = 'new'").select("file", "n", "lines")
    common = F.size(F.array_intersect("old_lines", "lines"))
    likeness = F.floor(100 * common / F.greatest("n", "old_n")).cast("int")
    return joined(joined(near, left, "old_file"), right, "file").where(100 * common >= similar * F.greatest("n", "old_n")).select("old_file", "file", likeness.alias("similarity"), (common / F.greatest("n", "old_n")).alias("exact"))


def best(pairs: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """For each ``one``: its greatest likeness, and of the others at that likeness their number, two hashes and the first."""
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(other)).alias("a"), F.bit_xor(F.xxhash64(other, F.lit(1))).alias("b"))
    each = pairs.groupBy(one, "exact").agg(sign.alias("sign"), F.min(other).alias("first"))
    return each.groupBy(one).agg(F.max_by(F.struct("exact", "sign", "first"), "exact").alias(name))


def assigned(pairs: DataFrame) -> DataFrame:
    """(old_file, file, similarity): likest first, each file once."""
    left, found = stored(pairs, "pairs"), None
    while not left.isEmpty():
        for_old, for_new = best(left, "old_file", "file", "o"), best(left, "file", "old_file", "f")
        tops = joined(joined(left, for_old, "old_file"), for_new, "file").where("exact = o.exact AND exact = f.exact")
        tops = stored(tops.withColumn("block", F.sha2(F.to_json(F.struct("exact", "o.sign", F.col("f.sign").alias("f"))), 256)), "tops")
        taken = tops.where("o.first = file AND f.first = old_file").select("old_file", "file", "similarity")
        # a block has as many pairs as its files' numbers of partners multiply to only if it is whole
        whole = tops.groupBy("block", F.col("o.sign.n").alias("news"), F.col("f.sign.n").alias("olds")).agg(F.count("*").alias("c"), F.min("similarity").alias("similarity"))
        blocks = stored(whole.where("c = news * olds AND c > 1").select("block", "similarity"), "blocks")
        if not blocks.isEmpty():
            member = joined(tops.select("block", "old_file", "file"), blocks.select("block"), "block", "left_semi")
            old, new = (ranks(member.select("block", x).distinct(), "block", x) for x in ("old_file", "file"))
            taken = taken.unionByName(joined(joined(old, new, ["block", "rank"]), blocks, "block").select("old_file", "file", "similarity")).distinct()
        taken = stored(taken, "taken")
        found = taken if found is None else found.unionByName(taken)
        left = stored(joined(joined(left, taken.select("old_file"), "old_file", "left_anti"), taken.select("file"), "file", "left_anti"), "pairs")
    return pairs.select("old_file", "file", "similarity").where("false") if found is None else found


def compare(before: DataFrame, after: DataFrame, similar: int | None = 50) -> DataFrame:
    """(status, file, old_file, similarity) of all files that differ; similarity (percent) of renamed ones. Without ``similar``
    only equal contents are renames."""
    if similar is not None and not 0 < similar <= 100:
        raise ValueError("similar is a percentage above 0")
    b = snapshot(before).select("file", F.col("hash").alias("old_hash"), F.col("content").alias("old_content"))
    both = stored(joined(b, snapshot(after), "file", "full").where("NOT hash <=> old_hash"), "both")
    deleted = both.where("hash IS NULL").select("file", F.col("old_hash").alias("hash"), F.col("old_content").alias("content"))
    added = both.where("old_hash IS NULL").select("file", "hash", "content")
    renamed = moved(deleted, added).withColumn("similarity", F.lit(100))
    without = lambda df, names, column: joined(df, names.select(F.col(column).alias("file")), "file", "left_anti")
    if similar is not None:
        likest = assigned(alike(without(deleted, renamed, "old_file"), without(added, renamed, "file"), similar))
        renamed = renamed.unionByName(likest)
    row = lambda df, status: df.select(F.lit(status).alias("status"), "file", _none("old_file"), F.lit(None).cast("int").alias("similarity"))
    changed = row(both.where("hash IS NOT NULL AND old_hash IS NOT NULL"), "modified")
    gone, new = row(without(deleted, renamed, "old_file"), "deleted"), row(without(added, renamed, "file"), "added")
    return changed.unionByName(gone).unionByName(new).unionByName(renamed.select(F.lit("renamed").alias("status"), "file", "old_file", "similarity"))


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)
