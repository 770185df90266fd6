"""SimHash near-dedup by a byte-position inverted index with count filtering, exact.

A fingerprint has 64 bits; a bit is set if it is in more than half of the hashes of the text's shingles, repeats included.
Fingerprints that differ in at most ``distance`` bits differ in at most so many of their eight bytes: they share at least
``least`` = 8 - distance bytes at the same positions. Steps:

1. Equal fingerprints are one fingerprint; all rows that have it are one class from the start.
2. The index: postings of fingerprints under ``m`` positional bytes at once. The sets of m positions are so chosen that
   any ``least`` of the eight positions hold one of them whole; so whatever bytes a pair shares, it meets in some list. m
   grows with the number of fingerprints, so that lists of spread fingerprints stay short; single bytes would put each
   256th of all fingerprints into one list.
3. A list of more than ``longest`` postings is keyed by one more byte, each fingerprint under any five of the bytes left (a
   pair that shares ``least`` in all misses at most four of those). Lists that are still long under ``least`` bytes are
   dealt into parts, and any two parts are compared in a task of their own.
4. In a list the positional bytes that a pair shares are tallied; pairs that reach ``least`` are verified by the bits that
   differ. Of the links inside a list only a forest is put out, never all pairs.
5. Links give components; each row gets the smallest doc_id of its fingerprint's component.

Null, empty and white-space texts have the fingerprint zero, which links like any other. Fewer words than a shingle's are
one shingle. A row without doc_id counts in no component's smallest doc_id, and has a null component if none of its component
has one. Repeated rows get the same component. Other columns of documents are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import U
from .common import delete, slices, small_batches, stored
from .components import components
from .ordering import by_key
from .shingling import LOWER

BYTES = 8
#: Postings that are compared in one list.
LONGEST = 2048
#: Lists of up to so many postings are compared together, many lists at a time.
SHORT = 32
#: The postings that a list of spread fingerprints has on average, at most.
MEAN = 64


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, in order; fewer words than ``width`` are one shingle."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not line:
        return np.zeros(0, U)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(spaces) < width - 1:
        return np.array([digest(line, 42)], U)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    return np.fromiter([digest(line[i:j], 42) for i, j in zip(starts, ends[width - 1 :], strict=False)], U, len(ends) - width + 1)


#: Four bits of a hash as four 16-bit counters in one integer.
LANES = np.array([sum((v >> b & 1) << 16 * b for b in range(4)) for v in range(16)], U)
LANE_MAX = (1 << 16) - 1


def fingerprints(texts: list[str | None], width: int = 4) -> np.ndarray:
    each = [hashes(t, width) for t in texts]
    n = np.array([len(x) for x in each], np.int64)
    out = np.zeros(len(texts), U)
    if not n.sum():
        return out
    h = np.concatenate(each)
    # counters hold LANE_MAX at most, so longer texts are counted in pieces
    starts = np.concatenate([np.arange(s, s + k, LANE_MAX) for s, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True)])
    text = np.repeat(np.arange(len(n)), -(-n // LANE_MAX))
    for four in range(16):
        sums = np.add.reduceat(LANES[(h >> U(4 * four) & U(15)).astype(np.int64)], starts)
        for b in range(4):
            count = np.bincount(text, (sums >> U(16 * b) & U(LANE_MAX)).astype(np.float64), len(n)).astype(np.int64)
            out |= (2 * count > n).astype(U) << U(4 * four + b)
    return out


def covering(m: int, least: int) -> list[tuple[int, ...]]:
    """Sets of m of the eight positions, such that any ``least`` positions hold one of them whole: the positions fall into
    least - 1 parts for m = 2 (two of any ``least`` are in one part), and for other m each set is taken that a plain
    greedy choice needs."""
    if m == least:
        return list(itertools.combinations(range(BYTES), m))
    if m == 1:
        return [(p,) for p in range(BYTES - least + 1)]
    open_sets = set(itertools.combinations(range(BYTES), least))
    out = []
    while open_sets:
        best = max(itertools.combinations(range(BYTES), m), key=lambda c: sum(set(c) <= set(x) for x in open_sets))
        out.append(best)
        open_sets = {x for x in open_sets if not set(best) <= set(x)}
    return out


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def posting_key(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at the positions, and which positions they are."""
    mask = sum(255 << 8 * p for p in positions)
    which = sum(1 << p for p in positions)
    return F.xxhash64(F.lit(which), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def postings(fps: DataFrame, m: int, least: int) -> DataFrame:
    """(which, key, fp): which positions, as bits, and a hash of these and their bytes; two keys that agree by chance only
    make a list longer."""
    each = [F.struct(F.lit(sum(1 << p for p in c)).alias("which"), posting_key(F.col("fp"), c).alias("key")) for c in covering(m, least)]
    return fps.select("fp", F.explode(F.array(*each)).alias("p")).select("p.which", "p.key", "fp")


def longer(long: DataFrame, m: int, least: int) -> DataFrame:
    """Postings of long lists under one more byte, each under five: of the bytes left, a pair misses BYTES - least at most."""
    taken = lambda p: F.col("which").bitwiseAND(F.lit(1 << p)) != 0
    mask = F.col("mask")
    free = F.slice(F.filter(F.array(*[F.when(~taken(p), F.lit(p)) for p in range(BYTES)]), lambda p: p.isNotNull()), 1, BYTES - least + 1)
    masks = F.array(*[F.lit((255 << 8 * p) - (1 << 64) if p == BYTES - 1 else 255 << 8 * p) for p in range(BYTES)])
    out = long.select("fp", "which", F.explode(free).alias("p"))
    out = out.withColumn("which", F.col("which") + F.element_at(F.array(*[F.lit(1 << p) for p in range(BYTES)]), F.col("p") + 1))
    bits = [F.when(taken(p), F.element_at(masks, p + 1)).otherwise(F.lit(0)) for p in range(BYTES)]
    whole = bits[0]
    for b in bits[1:]:
        whole = whole.bitwiseOR(b)
    out = out.withColumn("mask", whole)
    return out.select("which", F.xxhash64("which", F.col("fp").bitwiseAND(mask)).alias("key"), "fp").distinct()


def tally(x: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, by their difference."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then the bits themselves."""
    x = a ^ b
    out = tally(x) >= BYTES - distance
    out[out] = np.bitwise_count(x[out]) <= distance
    return out


def short_links(fp: np.ndarray, key: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists, which come one after the other: each posting with the d-th after it, for rising d."""
    found, at, d = [], np.arange(len(fp)), 1
    while len(at):
        at = at[at + d < len(fp)]
        at = at[key[at] == key[at + d]]
        hit = at[linked(fp[at], fp[at + d], distance)]
        if len(hit):
            found.append((fp[hit], fp[hit + d]))
        d += 1
    if not found:
        return fp[:0], fp[:0]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of a and b (b may be a): from each fingerprint not yet reached,
    all that can be reached, step by step."""
    n = len(a)
    nodes = a if a is b else np.concatenate([a, b])
    left, out_a, out_b = np.ones(len(nodes), bool), [], []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            others = np.flatnonzero(left) if a is b else np.flatnonzero(left[n:]) + n if i < n else np.flatnonzero(left[:n])
            hit = others[linked(nodes[others], np.broadcast_to(nodes[i], len(others)), distance)] if len(others) else others
            left[hit] = False
            front += hit.tolist()
            out_a.append(np.full(len(hit), nodes[i], U))
            out_b.append(nodes[hit])
    return np.concatenate(out_a), np.concatenate(out_b)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=PAIR)


def _list_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of whole lists (key, fp), sorted by key, each of LONGEST postings at most."""

    def work(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        few = np.repeat(size <= SHORT, size)
        a, b = short_links(fp[few], key[few], distance)
        if len(a):
            yield _pairs(a, b)
        for i, n in zip(starts[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            mine = fp[i : i + n]
            a, b = forest(mine, mine, distance)
            if len(a):
                yield _pairs(a, b)

    key, fp = np.zeros(0, np.int64), np.zeros(0, U)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(U)])
        cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
        if cut:
            yield from work(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield from work(key, fp)


def list_links(lists: DataFrame, distance: int) -> DataFrame:
    return lists.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _list_links(b, distance), "a long, b long")


def part_links(long: DataFrame, sizes: DataFrame, distance: int, longest: int) -> DataFrame:
    """Links of lists (key, fp) of any size: dealt into parts of about ``longest`` postings, every two parts in a task."""
    dealt = long.join(sizes.select("key", (F.expr(f"size div {longest}") + 1).alias("parts")), "key")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    cells = dealt.withColumn("other", other).select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, 3):
            p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
            part, fp = table.column("part").to_numpy(), table.column("fp").to_numpy().view(U)
            a = fp[part == p]
            b = a if p == q else fp[part == q]
            if len(a) and len(b):
                x, y = forest(a, b, distance)
                if len(x):
                    yield _pairs(x, y)

    return cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = 4, longest: int = LONGEST, mean: int = MEAN) -> DataFrame:
    """Links (a, b) of the distinct fingerprints fps (fp), with the same components as all links."""
    least = BYTES - distance
    if not 0 <= distance < BYTES:
        raise ValueError("fingerprints of eight bytes must share one")
    total, m = fps.count(), 1
    while m < least and total > mean << 8 * m:
        m += 1
    lists, out = postings(fps, m, least), []
    while True:
        sizes, _ = stored(lists.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > longest), "long-lists")
        if sizes.isEmpty():
            out.append(list_links(lists, distance))
            break
        out.append(list_links(lists.join(sizes, "key", "left_anti"), distance))
        long, _ = stored(lists.join(sizes.select("key"), "key", "left_semi"), "long")
        if m == least:
            out.append(part_links(long, sizes, distance, longest))
            break
        lists, m = longer(long, m, least), m + 1
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, longest: int = LONGEST, mean: int = MEAN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1).to_pylist(), width).view(np.int64))], schema=schema)

    rows, _ = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long"), "fingerprints")
    fps, fps_path = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found, links_path = stored(links(fps.select("fp"), distance, longest, mean), "links")
    roots, roots_path = components(found, rows=found.count())
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final, _ = stored(labelled.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    for path in (fps_path, links_path, roots_path):
        delete(docs.sparkSession, path)
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(final, rows["fp"] == final["of"], "left").select("doc_id", fingerprint, "component_id")
