"""N-gram Jaccard join by a token-group matrix, exact.

Two documents link when the Jaccard similarity of their shingle sets is at least ``percent`` / 100. Equal sets are one
set from the start (a set's signature stands for it), so exact copies cost nothing. A set of n shingles that has a
partner shares at least need = ceil(percent * n / 100) shingles with it; hence, in any order of all shingles that all
sets keep to, the first n - need + 1 of both have one in common. Steps:

1. One pass over the texts: every set's size and signature, and a count sketch of all shingles, of fixed size. The
   order puts shingles first whose count does not stand out, then the frequent ones by rising count, each by hash.
2. A second pass: each set's first shingles, packed by hash bucket; buckets drop the shingles that one set alone has.
3. Groups: each set is tested against the leader of its most shared shingle (the set for which that shingle comes
   first, so the one with the least of its own); sets that link form a group. Large families of near copies fall into
   one group or few that way, by one test a set.
4. The token-group matrix: for each shingle the groups whose union has it, with their range of sizes and places. A
   query set is bounded against a whole group: from the first shingle on that both have, no more can be common than
   the shorter rest. Only groups that reach the bound are opened, and only members that pass the length and positional
   filters become pairs.
5. Pairs are verified: an upper bound of the overlap by a bitmap first, then the exact overlap. Links give components.

Steps 3 to 5 work on the shingles and sets left by step 2; nothing is collected but the sketch, of fixed size, and bitmaps
sized by the sets to be fetched, 32 MB at most. Shingles are 64-bit hashes of whole words. Sets are equal if 128 bits of two
independent hashes of their shingles are; the first 64 (sig) go through the joins, and sets that agree in these alone
get ids of their own.

Null and empty texts, and texts of white space, have an empty set and link with nothing. Repeated rows are equal
sets. A row without doc_id counts in no component's smallest doc_id, and has a null component if it is alone. Other
columns of documents are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U, scramble
from .common import delete, fresh, release, slices, small_batches, stored
from .components import components
from .shingling import Shingling, first_shingles, only_first, token_lists

def _rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


CHUNK_BITS = 14


def measure(docs: DataFrame, kind: Shingling, sketch_bits: int) -> tuple[DataFrame, str]:
    """A table of kind 0: (doc_id, n, sig, chk) of each document; kind 1: a part of a task's count sketch."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("chk", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << sketch_bits, np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            np.add(sketch, np.bincount((np.concatenate(waiting) >> U(64 - sketch_bits)).astype(np.int64), minlength=len(sketch)).astype(np.uint32), out=sketch)
            waiting.clear()

        for part in slices(batches, 1):
            x = kind.sets(part.column(1).to_pylist())
            n, sig, chk = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            n[x.text], sig[x.text], chk[x.text] = x.counts, x.sig, x.check
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, np.int32)), part.column(0), *map(pa.array, (n, sig, chk)), pa.nulls(part.num_rows, pa.binary())], schema=schema)
            waiting.append(x.tokens)
            if sum(map(len, waiting)) > 1 << 20:
                count()
        if waiting:
            count()
        size = 1 << min(CHUNK_BITS, sketch_bits)
        parts = [sketch[c * size : (c + 1) * size] for c in range(len(sketch) // size)]
        rows = [(1, None, c, None, None, zlib.compress(p.tobytes(), 1)) for c, p in enumerate(parts) if p.any()]
        if rows:
            yield _batch(rows, schema)

    return stored(docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, sig long, chk long, counts binary"), "sets")


def frequency_classes(measured: DataFrame, sketch_bits: int, total: int) -> np.ndarray:
    """For each cell of the sketch: 0, or 1 + the bits of its count if that stands out from the mean."""
    size = 1 << min(CHUNK_BITS, sketch_bits)

    def add(key: tuple, parts: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
        whole = np.zeros(size, np.uint64)
        for x in parts.column("counts").to_pylist():
            whole += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([whole.tobytes()], pa.binary())})

    rows = measured.where("kind = 1").select(F.col("n").alias("c"), "counts").groupBy("c").applyInArrow(add, "c long, counts binary").collect()  # the sketch: fixed size
    counts = np.zeros(1 << sketch_bits, np.uint64)
    for c, x in rows:
        counts[c * size : (c + 1) * size] = np.frombuffer(x, np.uint64)
    mean = total / (1 << sketch_bits)
    hot = counts > mean + max(64, 6 * mean**0.5)
    return np.where(hot, 1 + np.ceil(np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def may_link(n: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n shingles, with one at place p, could link at that shingle with any set that has lo to hi
    shingles and this one at place ``first`` or later: length and positional filter against a whole list."""
    left = np.minimum(n - p, hi - first)
    return (100 * n >= percent * lo) & (100 * hi >= percent * n) & (left * (100 * (100 + percent)) >= percent * (100 * n + np.maximum(100 * lo, percent * n)))


def shared_shingles(docs: DataFrame, classes: np.ndarray, firsts: Callable, partitions: int, percent: int, hot_class: int = 17) -> tuple[DataFrame, str]:
    """(token, sig, place, n) for the first shingles of every set that another set's first shingles have, too, and at
    which the two might link by their sizes and places.

    ``firsts`` turns record batches of docs into arrays (shingle, signature, place, size, class). A bucket's shingles are
    sorted in one task; those of a class from ``hot_class`` (counts over 2**16) are spread by signature and kept
    without a test, so no task gathers all sets of a hot shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    shift = 64 - (len(classes) - 1).bit_length()
    buckets = 8 * partitions
    packed = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("sigs", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t, g, p, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
            key = scramble(np.where(c >= hot_class, t ^ scramble(g.view(U)), t))
            b = (key % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            t, g, p, n, b = t[order], g[order], p[order], n[order], b[order]
            cuts = np.flatnonzero(np.diff(b)) + 1
            rows = [(int(b[i]), t[i:j].tobytes(), g[i:j].tobytes(), p[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True)]
            return _batch(rows, packed)

        for arrays in firsts(batches):
            if len(arrays[0]):
                held.append(arrays)
                size += len(arrays[0])
            if size > 1_000_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    found = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], [], [], []]
        for batch in batches:
            for k, kind in enumerate((U, np.int64, np.int32, np.int32)):
                parts[k] += [np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist()]
        if not parts[0]:
            return
        t, g, p, n = (np.concatenate(x) for x in parts)
        parts.clear()
        order = np.argsort(t)
        t = t[order]
        same = np.concatenate([[False], t[1:] == t[:-1], [False]])
        often = same[1:] | same[:-1] | (shared.value[(t >> U(shift)).astype(np.int64)] >= hot_class)
        t, order = t[often], order[often]  # most shingles are in one set alone
        g, p, n = g[order], p[order].astype(np.int64), n[order].astype(np.int64)
        order = np.lexsort((p, n, g, t))
        t, g, p, n = t[order], g[order], p[order], n[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1]) | (p[1:] != p[:-1])])  # equal sets of other tasks
        t, g, p, n = t[new[: len(t)]], g[new[: len(t)]], p[new[: len(t)]], n[new[: len(t)]]
        if not len(t):
            return
        for _ in range(2):  # once more, as lists may have lost entries
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(starts, len(t)))
            each = lambda x: np.repeat(x, size)  # noqa: B023, E731
            lo, hi, first = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts), np.minimum.reduceat(p, starts)
            live = (each(size) > 1) & may_link(n, p, each(lo), each(hi), each(first), percent)
            live |= shared.value[(t >> U(shift)).astype(np.int64)] >= hot_class
            t, g, p, n = t[live], g[live], p[live], n[live]
            if not len(t):
                return
        for i in range(0, len(t), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in (t.view(np.int64), g, p.astype(np.int32), n)], schema=found)

    blobs = docs.mapInArrow(pack, "bucket int, tokens binary, sigs binary, places binary, sizes binary")
    rows = blobs.repartition(partitions, "bucket").mapInArrow(keep, "token long, sig long, place int, n long")
    return stored(rows, "shared")


def map_bits(n: int) -> int:
    """The bits of a bitmap for n values, a power of two. Beyond 2**28 (32 MB) bitmaps stop growing, and spare less work."""
    return 1 << min(28, max(16, (16 * n).bit_length()))


def bits_of(values: DataFrame, column: str, bits: int, hashed: bool = False) -> np.ndarray:
    """A bitmap of values, by a hash unless they are ``hashed`` already, aggregated; at most bits / 64 words of 16 bytes come
    to the driver, in Arrow batches, as rows of Python take twenty times as much."""
    p = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(bits))
    found = values.select(p.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    for batch in found.to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return words.view(np.uint8)


def bitmap(s: np.ndarray) -> np.ndarray:
    """8 bits a shingle, one of them set for each."""
    size = max(64, 8 * len(s))
    out = np.zeros(size, np.uint8)
    out[(s % U(size)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def may_overlap(a: np.ndarray, map_b: bytes, n_b: int) -> int:
    """At least the overlap of a with the set of the bitmap."""
    size = max(64, 8 * n_b)
    at = (a % U(size)).astype(np.int64)
    return int(((np.frombuffer(map_b, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).sum())


def marked(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places of a bitmap are set."""
    return ((words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def fetch_sets(docs: DataFrame, wanted: DataFrame, kind: Shingling) -> tuple[DataFrame, str]:
    """(id, n, tokens, map) of the wanted (id, sig, chk, doc_id), one row each. A bitmap of doc_ids only spares work; what
    it lets through besides, or twice, goes by a join."""
    bits = map_bits(wanted.count())
    marks = docs.sparkSession.sparkContext.broadcast(bits_of(wanted, "doc_id", bits))
    release(docs.sparkSession)
    schema = pa.schema([("sig", pa.int64()), ("chk", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("map", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(marked(marks.value, batch.column(1).to_numpy(zero_copy_only=False)))
            for part in slices([batch.take(pa.array(hit))]):
                x = kind.sets(part.column(0).to_pylist())
                mine = only_first(x, np.arange(len(x.first)))
                if len(mine):
                    maps = pa.array([bitmap(x.tokens[i : i + n]).tobytes() for i, n in zip(x.first[mine].tolist(), x.counts[mine].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x.sig[mine]), pa.array(x.check[mine]), pa.array(x.counts[mine]), token_lists(x, mine), maps], schema=schema)

    made = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")).mapInArrow(run, "sig long, chk long, n long, tokens binary, map binary")
    made = made.join(wanted.select("id", "sig", "chk"), ["sig", "chk"]).dropDuplicates(["sig", "chk"])
    return stored(made.select("id", "n", "tokens", "map"), "tokens")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the similarity."""
    flow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ta", pa.binary())])
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b, n_b, map_b, ta in _rows(batches):
            s = np.frombuffer(ta, U)
            if may_overlap(s, map_b, n_b) * (100 + percent) >= percent * (len(s) + n_b):
                out.append((a, b, ta))
            if len(out) >= 256:
                yield _batch(out, flow)
                out.clear()
        if out:
            yield _batch(out, flow)

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b, ta, tb in _rows(batches):
            x, y = np.frombuffer(ta, U), np.frombuffer(tb, U)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                out.append((a, b))
        if out:
            yield _batch(out, pair)

    maps = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "map")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    likely = pairs.join(maps, "b").join(left, "a").select("a", "b", "n_b", "map", "ta").mapInArrow(possible, "a long, b long, ta binary")
    return likely.join(right, "b").select("a", "b", "ta", "tb").mapInArrow(certain, "a long, b long")


def compatible(na: str, nb: str, percent: int) -> str:
    """Length filter."""
    return f"(100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}))"


def reachable(na: str, pa_: str, nb: str, pb: str, percent: int) -> str:
    """Positional filter: if this is the first shingle that both have, no more than what stands from it on can be
    common. A pair that links passes at its first common shingle."""
    return f"(least({na} - {pa_}, {nb} - {pb}) * {100 + percent} >= {percent} * ({na} + {nb}))"


def link(docs: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = 20, sig_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text)."""
    spark, kind = docs.sparkSession, Shingling(width, sig_bits=sig_bits)
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    measured, measured_path = measure(docs, kind, sketch_bits)
    rows = measured.where("kind = 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = frequency_classes(measured, sketch_bits, total)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 8_000_000))
    lists, lists_path = shared_shingles(docs.select("text"), classes, first_shingles(classes, kind, percent), partitions, percent)
    release(spark)
    one = [F.min("chk").alias("chk"), F.max("chk").alias("other"), F.min("n").alias("n"), F.min("doc_id").alias("doc_id")]
    sigs, sigs_path = stored(rows.where("n > 0").groupBy("sig").agg(*one).withColumn("id", F.col("sig")), "signatures")
    clash = sigs.where("chk <> other").select("sig")
    if not clash.isEmpty():  # different sets of one signature: ids of both hashes for these
        told = rows.where("n > 0").join(clash, "sig", "left_semi").withColumn("part", F.col("chk")).groupBy("sig", "part").agg(*one).drop("part")
        sigs, told_path = stored(sigs.where("chk = other").unionByName(told.withColumn("id", F.xxhash64("sig", "chk"))), "signatures")
        lists, told_lists_path = stored(lists.join(sigs.select("sig", "id"), "sig").drop("sig"), "shared")
        delete(spark, sigs_path), delete(spark, lists_path)
        sigs_path, lists_path = told_path, told_lists_path
    else:
        lists = lists.withColumnRenamed("sig", "id")

    # groups: one test against a leader for each set
    leaders = lists.groupBy("token").agg(F.min("place").alias("l_place"), F.min_by("id", "place").alias("l_id"), F.min_by("n", "place").alias("l_n"), F.count("*").alias("size")).where("size > 1")
    key = lists.join(leaders, "token").where(f"id <> l_id AND {compatible('n', 'l_n', percent)} AND {reachable('n', 'place', 'l_n', 'l_place', percent)}")
    key = key.groupBy("id").agg(F.max_by("l_id", "size").alias("leader"))
    star = key.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    star, star_path = stored(star, "star")
    wanted = ends(star).join(sigs, "id")
    sets, sets_path = fetch_sets(docs, wanted, kind)
    links, links_path = stored(verify(star, sets, percent), "links")
    delete(spark, sets_path)
    release(spark)
    groups, groups_path = components(links)

    # the token-group matrix, and the groups that queries open
    entries = lists.join(groups, lists["id"] == groups["node"], "left").select("token", "id", "n", "place", F.coalesce("root", "id").alias("grp"))
    entries, entries_path = stored(entries, "entries")
    matrix = entries.groupBy("token", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("place").alias("first"))
    several = matrix.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    matrix = matrix.join(several, "token").withColumnRenamed("grp", "g")
    queries = entries.join(several, "token", "left_semi")
    # overlap with the group's union, seen from their first common shingle, against what its smallest fitting member asks for
    bound = f"least(n - place, hi - first) * {100 * (100 + percent)} >= {percent} * (100 * n + greatest(100 * lo, {percent} * n))"
    fits = queries.join(matrix, (queries["token"] == matrix["token"]) & F.expr(f"grp < g AND 100 * n >= {percent} * lo AND 100 * hi >= {percent} * n AND {bound}"))
    opened, opened_path = stored(fits.select("id", "g").distinct(), "opened")
    q = entries.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    q = q.join(opened.select(F.col("id").alias("a"), "g"), "a")
    members = entries.select(F.col("token").alias("t"), F.col("grp").alias("mg"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    near = q.join(members, (q["token"] == members["t"]) & (q["g"] == members["mg"]) & F.expr(f"{compatible('na', 'nb', percent)} AND {reachable('na', 'pa', 'nb', 'pb', percent)}"))
    pairs = near.select("a", "b").distinct()
    pairs, pairs_path = stored(pairs, "pairs")
    wanted = ends(pairs).join(sigs, "id")
    sets, sets_path = fetch_sets(docs, wanted, kind)
    more, more_path = stored(verify(pairs, sets, percent), "links")
    delete(spark, sets_path)
    release(spark)
    roots, roots_path = components(links.unionByName(more))

    labelled = sigs.join(roots, sigs["id"] == roots["node"], "left").select("sig", "chk", "doc_id", F.coalesce("root", "id").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final, _ = stored(labelled.join(smallest, "root").select(F.col("sig").alias("_sig"), F.col("chk").alias("_chk"), "component_id"), "components")
    out = rows.join(final, (rows["sig"] == final["_sig"]) & (rows["chk"] == final["_chk"]) & (rows["n"] > 0), "left")
    for path in (sigs_path, lists_path, star_path, links_path, groups_path, entries_path, opened_path, pairs_path, more_path, roots_path):
        delete(spark, path)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows without those that are linked, over however many links, with a smaller doc_id. Rows without doc_id
    stay; of rows with the same doc_id and text one stays."""
    linked, _ = stored(link(docs, width, percent), "linked")
    key = fresh(docs, "gone_id")
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    out = docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    twice = linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    if not twice.isEmpty():
        single = out.join(twice, F.col("doc_id") == F.col(key), "left_anti")
        out = single.unionByName(out.join(twice, F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
