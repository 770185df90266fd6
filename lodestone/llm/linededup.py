"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct ``width``-word shingles (words between white space, A-Z lower-cased). A line of fewer
words has one token, all its words in a row; with ``short=False`` it has none and always stays. Lines without words
always stay. A line is removed if any line before it, in the order of (doc_id, text hash,
line number), has a Jaccard similarity of at least ``percent`` / 100 to it. Whether that earlier line itself stays
does not matter, so the result does not depend on an order of work.

1. One pass: every line's set size, signature and position, and a count sketch of all tokens, of fixed size. Rarity
   order: tokens whose count does not stand out come first, then the frequent ones by rising count, each by hash.
2. A second pass: the first n - need + 1 tokens of each set by rarity (prefix filter, need = ceil(percent * n /
   100)), packed by hash bucket; buckets drop tokens that one set alone has. Equal sets are one set.
3. A set's first line goes if one earlier set matches it; one witness is enough. So each set is first tested against
   the earliest set that has its most shared token; those still open are tested against every earlier set that shares
   one of them and passes the length and positional filters. Tests are exact Jaccard similarities.
4. Removed lines are gathered by document and taken out of the texts.

Tokens are 64-bit hashes of whole words. Sets are equal if 128 bits of two independent hashes of their shingles are; the
first 64 (sig) go through the joins, and sets that agree in these alone get ids of their own. Positions are compared by
(doc_id, text hash, line number) as they are.

Null texts stay null, and texts without any removed line stay as they are, byte for byte. Rows of the same doc_id and
text are one document, treated alike, and one row among the sets. Null doc_ids come first (as the doc_id -2**63 does). Other
columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U
from .common import delete, fresh, release, slices, small_batches, stored
from .jaccard import CHUNK_BITS, _batch, bits_of, compatible, frequency_classes, map_bits, marked, reachable, shared_shingles
from .shingling import Shingling, distinct, first_shingles, only_first, token_lists


def measure_lines(docs: DataFrame, kind: Shingling, sketch_bits: int) -> tuple[DataFrame, str]:
    """A table of kind 0: a line's (doc_id, tie, line, n, sig, chk, again), again if an earlier line of the same text
    has the same set; kind 1: a part of a task's count sketch, n its number."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("sig", pa.int64()), ("chk", pa.int64()), ("again", pa.bool_()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            cells = (np.concatenate(waiting) >> U(64 - sketch_bits)).astype(np.int64)
            np.add(sketch, np.bincount(cells, minlength=len(sketch)).astype(np.uint32), out=sketch)
            waiting.clear()

        for part in slices(batches):
            x = kind.sets(part.column(0).to_pylist())
            k = len(x.first)
            if not k:
                continue
            waiting.append(x.tokens)
            if sum(map(len, waiting)) > 1 << 20:
                count()
            order = np.lexsort((x.line, x.check, x.sig, x.text))
            t, g, c = x.text[order], x.sig[order], x.check[order]
            again = np.zeros(k, bool)
            again[order[1:]] = (t[1:] == t[:-1]) & (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            at = pa.array(x.text)
            ids, ties = part.column(1).take(at), part.column(2).take(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), ids, ties, *[pa.array(v.astype(np.int32)) for v in (x.line, x.counts)], pa.array(x.sig), pa.array(x.check), pa.array(again), pa.nulls(k, pa.binary())], schema=schema
            )
        if waiting:
            count()
        size = 1 << min(CHUNK_BITS, sketch_bits)
        parts = [sketch[c * size : (c + 1) * size] for c in range(len(sketch) // size)]
        rows = [(1, None, None, None, c, None, None, None, zlib.compress(p.tobytes(), 1)) for c, p in enumerate(parts) if p.any()]
        if rows:
            yield _batch(rows, schema)

    return stored(docs.mapInArrow(run, "kind int, doc_id long, tie long, line int, n int, sig long, chk long, again boolean, counts binary"), "lines")


def fetch_lines(docs: DataFrame, wanted: DataFrame, kind: Shingling) -> tuple[DataFrame, str]:
    """(id, tokens) of the wanted (id, sig, chk, doc_id), one row each. Bitmaps of documents and of lines only spare work;
    what they let through besides, or twice, goes by a join."""
    context, bits = docs.sparkSession.sparkContext, map_bits(wanted.count())
    doc_marks, line_marks = context.broadcast(bits_of(wanted, "doc_id", bits)), context.broadcast(bits_of(wanted, "sig", bits, hashed=True))
    release(docs.sparkSession)
    schema = pa.schema([("sig", pa.int64()), ("chk", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(marked(doc_marks.value, batch.column(1).to_numpy(zero_copy_only=False)))
            for part in slices([batch.take(pa.array(hit))]):
                x = kind.sets(part.column(0).to_pylist())
                mine = only_first(x, np.flatnonzero(marked(line_marks.value, x.sig & (bits - 1))))
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(x.sig[mine]), pa.array(x.check[mine]), token_lists(x, mine)], schema=schema)

    made = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")).mapInArrow(run, "sig long, chk long, tokens binary")
    made = made.join(wanted.select("id", "sig", "chk"), ["sig", "chk"]).dropDuplicates(["sig", "chk"])
    return stored(made.select("id", "tokens"), "tokens")


def overlaps(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of token sets: both sizes and how many tokens they share, which sorting puts side by side."""
    na, nb = (np.array([len(x) // 8 for x in side], np.int64) for side in (a, b))
    tokens = np.frombuffer(b"".join([*a, *b]), U)
    if not len(tokens):
        return na, nb, np.zeros(len(a), np.int64)
    pair = np.repeat(np.concatenate([np.arange(len(a)), np.arange(len(b))]), np.concatenate([na, nb]))
    alone = np.zeros(len(tokens), np.int64)
    twice, _, left = distinct(tokens, alone, pair)
    return na, nb, na + nb - np.bincount(left, minlength=len(a))


def matching(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], 2):
                na, nb, common = overlaps(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns[:2], schema=schema).filter(pa.array(100 * common >= percent * (na + nb - common)))

    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


#: A null doc_id comes first.
NULL_ID = -(1 << 63)


def before(a: str, b: str) -> str:
    """Whether the position in the columns d, tie and line of prefix a is before that of prefix b."""
    d, tie, line = ((f"{a}{x}", f"{b}{x}") for x in ("d", "tie", "line"))
    return f"({d[0]} < {d[1]} OR ({d[0]} = {d[1]} AND ({tie[0]} < {tie[1]} OR ({tie[0]} = {tie[1]} AND {line[0]} < {line[1]}))))"


def set_table(lines: DataFrame, *key: str) -> DataFrame:
    """Of each set: size, number of lines with it (one for each text), and the position of the first."""
    aggs = [F.min("n").alias("n"), F.count("*").alias("copies"), F.min("chk").alias("chk"), F.max("chk").alias("other")]
    several = lines.groupBy("d").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a <> b")
    if several.isEmpty():  # d alone tells the document
        at = [F.min("d").alias("d"), F.min_by("tie", "d").alias("tie"), F.min_by("line", "d").alias("line")]
        return lines.groupBy(*key).agg(*aggs, *at)
    found = lines.groupBy(*key).agg(*aggs, F.min(F.struct("d", "tie", "line")).alias("at"))
    return found.select(*key, "n", "copies", "chk", "other", "at.*")


def removed_lines(docs: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = 20, short: bool = True, sig_bits: int = 64) -> tuple[DataFrame, str]:
    """(doc_id, tie, lines): by document, the numbers (from 0) of its lines that an earlier line matches; stored."""
    spark, kind = docs.sparkSession, Shingling(width, short, True, sig_bits)
    small_batches(spark)
    docs = docs.select("text", "doc_id", F.xxhash64("text").alias("tie"))
    measured, measured_path = measure_lines(docs, kind, sketch_bits)
    lines = measured.where("kind = 0").select("sig", "chk", "n", F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "doc_id", "tie", "line", "again")
    total = lines.agg(F.sum("n")).first()[0] or 0
    classes = frequency_classes(measured, sketch_bits, total)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 8_000_000))
    shared, shared_path = shared_shingles(docs.select("text"), classes, first_shingles(classes, kind, percent), partitions, percent)
    release(spark)
    once = lines.where("NOT again")
    sigs, sigs_path = stored(set_table(once, "sig").withColumn("id", F.col("sig")), "signatures")
    clash = sigs.where("chk <> other").select("sig")
    if not clash.isEmpty():  # different sets of one signature: ids of both hashes for these
        told = once.join(clash, "sig", "left_semi")
        told = set_table(told.withColumn("part", F.col("chk")), "sig", "part").drop("part").withColumn("id", F.xxhash64("sig", "chk"))
        single, single_path = stored(sigs.where("chk = other").unionByName(told), "signatures")
        delete(spark, sigs_path)
        sigs, sigs_path = single, single_path
    lists, lists_path = stored(shared.join(sigs.select("sig", "id", "d", "tie", "line"), "sig").drop("sig"), "lists")

    # one witness for each set: the earliest set of its most shared token
    leader = [F.min_by(c, "d").alias(f"l_{c}") for c in ("id", "n", "place", "tie", "line")]
    leaders = lists.groupBy("token").agg(F.min("d").alias("l_d"), *leader, F.count("*").alias("size")).where("size > 1")
    key = lists.join(leaders, "token").where(f"{before('l_', '')} AND {compatible('n', 'l_n', percent)} AND {reachable('n', 'place', 'l_n', 'l_place', percent)}")
    star = key.groupBy(F.col("id").alias("a")).agg(F.max_by("l_id", "size").alias("b"))
    star, star_path = stored(star, "star")
    wanted = lists.select("id").distinct().join(sigs.select("id", "sig", "chk", F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id")), "id")
    wanted, wanted_path = stored(wanted, "wanted")
    sets, sets_path = fetch_lines(docs, wanted, kind)
    late, late_path = stored(matching(star, sets, percent).select(F.col("a").alias("id")), "late")

    # every earlier set for those still open
    q = lists.join(late, "id", "left_anti").select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), *[F.col(c).alias(f"a_{c}") for c in ("d", "tie", "line")])
    m = lists.select(F.col("token").alias("t"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in ("d", "tie", "line")])
    near = q.join(m, (q["token"] == m["t"]) & F.expr(f"{before('b_', 'a_')} AND {compatible('na', 'nb', percent)} AND {reachable('na', 'pa', 'nb', 'pb', percent)}"))
    pairs, pairs_path = stored(near.select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    more = matching(pairs, sets, percent).select(F.col("a").alias("id"))
    late = late.unionByName(more).distinct().withColumn("late", F.lit(True))

    # a line goes if its set has an earlier line or an earlier match
    verdict = sigs.join(late, "id", "left").where("late OR copies > 1").select("sig", "chk", *[F.col(c).alias(f"f_{c}") for c in ("d", "tie", "line")], F.coalesce("late", F.lit(False)).alias("late"))
    release(spark)
    verdict, verdict_path = stored(verdict, "verdict")  # so that a line which very many documents have is a skewed join, which Spark splits
    gone = once.join(verdict, ["sig", "chk"]).where(f"late OR {before('f_', '')}").select("doc_id", "tie", "line").unionByName(lines.where("again").select("doc_id", "tie", "line"))
    out = gone.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    kept = stored(out, "removed")
    for path in (measured_path, shared_path, sigs_path, lists_path, star_path, wanted_path, late_path, pairs_path, sets_path, verdict_path):
        delete(spark, path)
    return kept


def dedup_lines(docs: DataFrame, width: int = 5, percent: int = 80, counts: str | None = None, short: bool = True) -> DataFrame:
    """docs' columns in their order, text without its removed lines; with ``counts``, a struct of that name with
    n_lines and n_removed after them."""
    removed, _ = removed_lines(docs, width, percent, short=short)
    key, tie, gone, mine = (fresh(docs, c) for c in ("gone_id", "gone_tie", "gone_lines", "text_tie"))
    removed = removed.select(F.col("doc_id").alias(key), F.col("tie").alias(tie), F.col("lines").alias(gone))
    lines = F.split("text", "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # the numbers that stay, by hash, so that a text of many lines is rebuilt in linear time
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(F.array(F.struct(lines.alias("l"), stay.alias("s"))), lambda v: F.array_join(F.transform(v["s"], lambda i: F.get(v["l"], i)), "\n")), "")
    joined = docs.withColumn(mine, F.xxhash64("text")).join(removed, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(tie)), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")
    more = [F.struct(F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")).alias(counts)] if counts else []
    return joined.select(*[text if c == "text" else F.col(c) for c in docs.columns], *more)
