"""Importance resampling towards a target distribution, by bucket-partitioned inverted postings.

Features are the runs of 1 to ``grams`` words of a text, hashed (crc32) into buckets; a bucket's gain is the log ratio of
its smoothed shares in the target and in the corpus, and a document's weight the sum of its features' gains. Documents are
drawn without replacement by Gumbel noise: the highest scores of weight plus noise. Steps:

1. One pass over the texts makes postings (bucket, document, count), packed for each bucket and block of documents, and a
   header for each block. They are shuffled by bucket range and block, and stored: every file holds whole rows of some
   buckets. Blocks salt the buckets: a bucket that all documents have is as many rows as there are blocks, spread over
   all partitions.
2. The target's counts, already summed by bucket, meet the corpus's, which are sums over the stored rows' counts alone;
   where a bucket's totals of both corpora come together its gain is computed. There are ``buckets`` gains, a fixed number.
3. The postings are read bucket range by bucket range with their gains and give contributions, summed for each block's
   documents in a vector; the vectors of a block are added up, and its header turns them into rows by document.
4. Scores of documents with at least ``least_words`` words are ranked in sorted runs; the first ``percent`` / 100 are drawn.

A null text has no words. A document without features has weight 0. Documents without doc_id have no noise, so a null
score and no rank, and do not count as candidates. Rows with the same doc_id are documents of their own, with the same
noise; equal scores of one doc_id are ordered by weight and number of features. An empty target or corpus leaves its counts
at 0; no documents give no rows. Other columns of documents and of the target are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, release, slices, small_batches, stored
from .ordering import placed

#: Of the bytes that are no word's, all are a space to the words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Features and documents of a block, unless one text has more.
BLOCK_FEATURES = 3_000_000
BLOCK_DOCS = 1 << 16
#: Ranges of buckets, each a row of partitions.
RANGES = 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()
#: Words of more bytes are appended one by one.
LONG = 64


def _zeros_tables() -> np.ndarray:
    """For each length, what so many bytes of zero make of a crc, by each of its four bytes: a crc is linear in these."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    tables = np.zeros((LONG + 2, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for n in range(LONG + 2):
        for k in range(4):
            for bit in range(8):
                tables[n, k] ^= np.where(values >> np.uint32(bit) & np.uint32(1), basis[8 * k + bit], np.uint32(0))
        basis = CRC[basis & np.uint32(255)] ^ (basis >> np.uint32(8))
    return tables


ZEROS = _zeros_tables()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], a byte of all spans at a time."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    n = ends - starts
    rest, at = np.flatnonzero(n <= LONG), 0
    while len(rest):
        rest = rest[n[rest] > at]
        c = crc[rest]
        crc[rest] = CRC[(c ^ data[starts[rest] + at]) & np.uint32(255)] ^ (c >> np.uint32(8))
        at += 1
    crc = ~crc
    for k in np.flatnonzero(n > LONG).tolist():
        crc[k] = zlib.crc32(data[starts[k] : ends[k]])
    return crc


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two strings one after the other, from theirs and the second's length."""
    out = second.copy()
    short = np.minimum(length, LONG + 1)
    for k in range(4):
        out ^= ZEROS[short, k, (first >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
    for i in np.flatnonzero(length > LONG + 1).tolist():
        crc, left = int(first[i]), int(length[i])
        while left:
            step = min(left, LONG + 1)
            crc = int(ZEROS[step, 0, crc & 255] ^ ZEROS[step, 1, crc >> 8 & 255] ^ ZEROS[step, 2, crc >> 16 & 255] ^ ZEROS[step, 3, crc >> 24])
            left -= step
        out[i] = second[i] ^ np.uint32(crc)
    return out


def features(texts: list[str | None], grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each text's words; of each feature, its text and its bucket."""
    coded = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS) for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    space = np.concatenate([[True], data == 32])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(x) + 1 for x in coded])
    text = np.searchsorted(bounds, starts, "right")
    n_words = np.bincount(text, minlength=len(texts)).astype(np.int64)
    length = ends - starts
    word = span_crcs(data, starts, ends)
    spaced = joined(np.full(len(word), zlib.crc32(b" "), np.uint32), word, length)  # with the space before it
    run, found, owners = word, [word], [text]
    for k in range(1, grams):
        run = joined(run[:-1], spaced[k:], length[k:] + 1) if len(word) > k else word[:0]
        whole = text[k:] == text[: len(text) - k] if len(word) > k else np.zeros(0, bool)
        found.append(run[whole])
        owners.append(text[k:][whole] if len(word) > k else text[:0])
    return n_words, np.concatenate(owners), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


STORE = "bucket int, block long, n long, at binary, counts binary, doc_ids binary, no_id binary, n_words binary, n_features binary"
STORE_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("at", "counts", "doc_ids", "no_id", "n_words", "n_features")]
)


def _sliced(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binaries data[offset:next offset], without a copy."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def block_rows(block: int, ids: list[int | None], n_words: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's header (bucket -1) and its postings, a row for each bucket: places of the documents in the block and counts; a
    count of over 255 is several."""
    n_features = np.bincount(owner, minlength=len(ids)).astype(np.int64)
    no_id = np.array([x is None for x in ids], np.uint8)
    doc_ids = np.array([x or 0 for x in ids], np.int64)
    head = [[-1], [block], [0], None, None, [doc_ids.tobytes()], [no_id.tobytes()], [n_words.tobytes()], [n_features.tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if x else pa.nulls(1, f.type) for x, f in zip(head, STORE_SCHEMA, strict=True)], schema=STORE_SCHEMA)
    if not len(owner):
        return
    key = np.sort(bucket << 16 | owner)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count, key = np.diff(np.append(new, len(key))), key[new]
    if (count > 255).any():
        pieces = -(-count // 255)
        last = np.cumsum(pieces) - 1
        key, rest = np.repeat(key, pieces), count - 255 * (pieces - 1)
        count = np.full(len(key), 255)
        count[last] = rest
    b = key >> 16
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    offsets = np.append(starts, len(b))
    sums = np.add.reduceat(count, starts)
    at, count = (key & 0xFFFF).astype(np.uint16), count.astype(np.uint8)
    step = 4096
    for i in range(0, len(starts), step):
        o = offsets[i : i + step + 1]
        k = len(o) - 1
        lists = [_sliced(x[o[0] : o[-1]], o - o[0]) for x in (at, count)]
        columns = [pa.array(b[starts[i : i + step]].astype(np.int32)), pa.array(np.full(k, block, np.int64)), pa.array(sums[i : i + step]), *lists, *(pa.nulls(k, pa.binary()) for _ in range(4))]
        yield pa.RecordBatch.from_arrays(columns, schema=STORE_SCHEMA)


def postings(docs: DataFrame, grams: int, buckets: int, ranges: int, block_features: int = BLOCK_FEATURES) -> tuple[DataFrame, str]:
    """The stored postings and headers of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n_words, owner, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return block_rows(number, ids, n_words, owner, bucket)

        for part in slices(batches, 1):
            n_words, owner, bucket = features(part.column(1).to_pylist(), grams, buckets)
            if ids and (size + len(owner) > block_features or len(ids) + part.num_rows > BLOCK_DOCS):
                yield from flush()
                ids, size, number = [], 0, number + 1
            held.append((n_words, (owner + len(ids)).astype(np.int32), bucket.astype(np.int32)))
            ids += part.column(0).to_pylist()
            size += len(owner)
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORE).withColumn("range", F.pmod("bucket", F.lit(ranges)))
    return stored(rows.repartition("range", "block").sortWithinPartitions("block", "bucket"), "postings")


def target_counts(target: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(bucket, t) of target (text), summed in the tasks first."""
    schema = pa.schema([("bucket", pa.int32()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for part in slices(batches):
            sums += np.bincount(features(part.column(0).to_pylist(), grams, buckets)[2], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], schema=schema)

    return target.select("text").mapInArrow(run, "bucket int, t long").groupBy("bucket").agg(F.sum("t").alias("t"))


def gains(store: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket that a document has; target: (bucket, t)."""
    corpus = store.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("s"))
    both = corpus.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both, _ = stored(both, "bucket-totals")  # at most ``buckets`` rows
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    number = lambda c: F.col(c).cast("double")
    ratio = (number("t") + 1) * (number("all_s") + buckets) / ((number("s") + 1) * (number("all_t") + buckets))
    return both.join(total, how="cross").where("s > 0").select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (block, gain, at, counts) with a block's one after the other: for each block, its documents' sums as a
    vector."""
    schema = pa.schema([("block", pa.int64()), ("sums", pa.binary())])
    block, sums = None, np.zeros(0, np.int64)

    def add(sums: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        more = np.bincount(at, value, len(sums)).astype(np.int64)  # doubles are exact for these sums
        more[: len(sums)] += sums
        return more

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(0).to_numpy()
        gain = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if block is not None and blocks[i] != block:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums.tobytes()], pa.binary())], schema=schema)
                sums = np.zeros(0, np.int64)
            block = int(blocks[i])
            at, counts = (np.concatenate([np.frombuffer(x, kind) for x in batch.column(c).slice(i, j - i).to_pylist()]) for c, kind in ((2, np.uint16), (3, np.uint8)))
            lengths = np.array([len(x) for x in batch.column(3).slice(i, j - i).to_pylist()])
            sums = add(sums, at, np.repeat(gain[i:j], lengths) * counts.astype(np.float64))
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums.tobytes()], pa.binary())], schema=schema)


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])


def _documents(table: pa.Table) -> pa.Table:
    """The documents of one block, from its header and its vectors, of which there are as many as ranges at most."""
    head = table.filter(table.column("sums").is_null())
    ids, no_id, n_words, n_features = (np.frombuffer(head.column(c)[0].as_py(), kind) for c, kind in (("doc_ids", np.int64), ("no_id", np.uint8), ("n_words", np.int64), ("n_features", np.int64)))
    weight = np.zeros(len(ids), np.int64)
    for x in table.column("sums").to_pylist():
        if x is not None:
            v = np.frombuffer(x, np.int64)
            weight[: len(v)] += v
    return pa.table([pa.array(ids, mask=no_id.astype(bool)), pa.array(n_features), pa.array(n_words), pa.array(weight)], schema=DOCUMENT)


def weights(docs: DataFrame, target: DataFrame, grams: int = 3, buckets: int = 10_000, ranges: int = RANGES, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row of docs (doc_id, text), towards target (text); stored."""
    small_batches(docs.sparkSession)
    store, path = postings(docs, grams, buckets, ranges, block_features)
    release(docs.sparkSession)
    gain, gain_path = stored(gains(store, target_counts(target, grams, buckets), buckets), "gains")
    # the gains are ``buckets`` rows of two numbers, whatever the tables' sizes
    used = store.where("bucket >= 0").join(F.broadcast(gain), "bucket").select("block", "gain", "at", "counts")
    heads = store.where("bucket < 0").select("block", F.lit(None).cast("binary").alias("sums"), "doc_ids", "no_id", "n_words", "n_features")
    both = used.mapInArrow(_contributions, "block long, sums binary").unionByName(heads, allowMissingColumns=True)
    out, _ = stored(both.groupBy("block").applyInArrow(_documents, "doc_id long, n_features long, n_words long, weight long"), "weights")
    delete(docs.sparkSession, path)
    delete(docs.sparkSession, gain_path)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, grams: int = 3, buckets: int = 10_000, ranges: int = RANGES, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank (from 1; null if not drawn) of every row of docs."""
    rows = weights(docs, target, grams, buckets, ranges, block_features)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored, _ = stored(rows.withColumn("score", F.col("weight") + noise), "scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    ranked = placed(scored.where(able), [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features")], "ranked")
    rank = F.when(F.col("place") < F.expr(f"{percent} * size div 100"), F.col("place") + 1).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.where(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
