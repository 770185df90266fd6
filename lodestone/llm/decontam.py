"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is found in a document when at least ``percent`` of the item's distinct shingles (``width`` words in a row,
words of letters and digits, A-Z lower-cased) are in the document. An item of fewer words is one shingle of its own length,
and found where its words stand in a row; documents have shingles of such lengths only where the benchmark has such items.

Items are partitioned by size: partition j holds items of 2**j to 2**(j + 1) - 1 shingles. Of each item a sketch of hashes is
kept, those of the shingles that fewest items have and of these the smallest, so that a prompt which many items share brings
no candidates together: the first k, k = u - ceil(percent * u / 100) + 1 for the partition's upper size u (all of
them if it has fewer). An item of n shingles may lack n - ceil(percent * n / 100) of them in a document that contains
it, so at least k minus that many sketch values, one or more, are among the document's shingles: the search misses
nothing, however long the document. Documents are first tested in place against one Bloom filter of all sketch
values; those that hold some are joined with the sketches and partitions they are large enough for; candidates are
verified by the exact overlap.

Everything is built-in expressions and joins; no text is shuffled. The filter's size follows the sketches' and is
bounded by ``max_bits``; a benchmark beyond that makes it pass more documents on, not fewer.

Null and empty texts have no shingles and are neither found nor find. Repeated rows of documents are each reported,
items of the same text or id are reported each for itself, items without an id as null. Other columns are not looked at. An empty benchmark or an
empty corpus gives no rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, delete, fresh, stored
from .licenses import words
from .urls import Level, positions


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """array<bigint>, one hash a place; repeats stay."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))

    return F.get(F.transform(F.array(words(ascii_lower(F.coalesce(text, F.lit(""))))), of), 0)


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, text, n_words) of items (item_id, text); item tells rows apart."""
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text", F.size(words(ascii_lower(F.coalesce("text", F.lit(""))))).alias("n_words"))


def sketches(items: DataFrame, percent: int, width: int) -> DataFrame:
    """(item, item_id, shingles, n, partition, sketch, needed) of item_words."""
    n, u = F.col("n"), F.expr("shiftleft(2, partition) - 1")
    need = lambda x: F.floor((x * percent + 99) / 100)
    each = items.select("item", "item_id", F.explode(F.array_distinct(shingle_hashes(F.col("text"), width))).alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = each.join(often, "shingle").groupBy("item").agg(F.first("item_id").alias("item_id"), F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    sized = ordered.select("item", "item_id", F.transform("s", lambda x: x["shingle"]).alias("shingles")).withColumn("n", F.size("shingles"))
    sized = sized.withColumn("partition", F.floor(F.log2("n") + 1e-9).cast("int"))
    k = F.least(n, u - need(u) + 1).cast("int")
    return sized.withColumn("sketch", F.slice("shingles", F.lit(1), k)).withColumn("needed", F.size("sketch") - (n - need(n)))


def document_hashes(text: Column, width: int, short: list[int]) -> Column:
    """The hashes of a text's shingles, and of its runs of each of the short lengths."""
    if not short:
        return shingle_hashes(text, width)

    def runs(w: Column, m: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: i + m <= F.size(w))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(m)]))

    def of(w: Column) -> Column:
        return F.concat(*[runs(w, m) for m in short])

    return F.concat(shingle_hashes(text, width), F.get(F.transform(F.array(words(ascii_lower(F.coalesce(text, F.lit(""))))), of), 0))


def bloom(values: DataFrame, max_bits: int) -> Level | None:
    """A Bloom filter of (key bigint): 64 bits and 4 hashes a key, up to max_bits."""
    n = values.count()
    if not n:
        return None
    bits = min(max_bits, 1 << (64 * n - 1).bit_length())
    p = F.col("p")
    rows = (
        values.select(F.explode(F.array(*positions(F.col("key"), 0, bits, 4))).alias("p")).groupBy(F.shiftright(p, 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).collect()
    )
    filled = [0] * (bits // 64)
    for w, b in rows:
        filled[w] = b
    return Level(bits, 4, filled)


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, width: int = 5, max_bits: int = 1 << 24) -> DataFrame:
    """doc_id, text_hash (xxhash64, to tell rows of one doc_id apart), item_id, n_item, n_common, containment of every
    document (doc_id, text) and every item (item_id, text) found in it."""
    given, given_path = stored(item_words(benchmark), "benchmark")
    short = sorted(r.n_words for r in given.where(F.col("n_words").between(1, width - 1)).select("n_words").distinct().collect())  # width - 1 rows at most
    items, items_path = stored(sketches(given, percent, width), "items")
    values = items.select("item", "n", "needed", F.explode("sketch").alias("key"))
    level = bloom(values.select("key").distinct(), max_bits)
    hashes = document_hashes(F.col("text"), width, short)
    seen = docs.select("doc_id", "text").where(F.exists(hashes, lambda x: level.holds(x, 0)) if level else F.lit(False))
    held, held_path = stored(seen.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.array_distinct(hashes).alias("h")), "held")
    places = held.select("_row", F.size("h").alias("n_doc"), F.explode("h").alias("key"))
    met = places.join(values, "key").where(f"100 * n_doc >= {percent} * n")  # as many shingles as the item must have
    candidates = met.groupBy("_row", "item").agg(F.count("*").alias("hits"), F.first("needed").alias("needed")).where("hits >= needed").select("_row", "item")
    both = candidates.join(held, "_row").join(items.select("item", "item_id", "shingles", F.col("n").alias("n_item")), "item")
    common = F.size(F.array_intersect("h", "shingles")).cast("long")
    found = both.select("doc_id", "text_hash", "item_id", F.col("n_item").cast("long").alias("n_item"), common.alias("n_common")).where(f"100 * n_common >= {percent} * n_item")
    out, _ = stored(found.withColumn("containment", F.col("n_common") / F.col("n_item")), "leaks")
    for path in (given_path, items_path, held_path):
        delete(docs.sparkSession, path)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the documents in which an item is found."""
    key, tie = fresh(docs, "leak_id"), fresh(docs, "leak_hash")
    leaks = find_leaks(docs, benchmark, percent, width).select(F.col("doc_id").alias(key), F.col("text_hash").alias(tie)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tie)), "left_anti")
