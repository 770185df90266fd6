"""Token ids in files of fixed-width bit packing.

Documents are put into ascending doc_id order by a range shuffle; each range is encoded and written as one file or
more, never more than ``file_ids`` ids (and one document) at a time in memory. A file holds

    magic "LSTK", then little-endian uint32 version, bits, block_ids and uint64 n_docs, n_ids
    int64  doc ids [n_docs]          uint8 null marks [n_docs]
    uint64 starts  [n_docs + 1]      first id of each document, counted from the file's first id
    uint64 offsets [n_blocks + 1]    where each block begins, in bytes from the payload's begin
    payload: blocks of block_ids ids, each id in ``bits`` bits, lowest bit first, each block padded to a whole byte

so any id is found by its block's offset, and a block is unpacked by a few numpy calls.

A task writes files under names of their own and returns their names; only files so returned count, so a task that
runs again after a lost executor leaves no trace in the result. Null texts are empty texts; each document still has
its end id. Equal doc_ids stand in the order of their texts' hashes, null doc_ids come first. An empty table gives
no file and no row.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import Remembering, Spelling, span_hashes
from .common import slices, small_batches

HEADER = struct.Struct("<4sIIIQQ")
MAGIC, VERSION = b"LSTK", 1


#: Hadoop's names of file systems that pyarrow names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def arrow_uri(uri: str) -> str:
    scheme, colon, rest = uri.partition("://")
    return SCHEMES.get(scheme, scheme) + colon + rest


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a Hadoop URI, and the path in it. Workers need that file system's credentials as pyarrow
    finds them (for s3: the environment or the instance's role)."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):  # the same layout, byte by byte
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def file_bytes(docs: list[int | None], counts: list[int], ids: np.ndarray, bits: int, block_ids: int) -> list[bytes]:
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    named = np.array([d or 0 for d in docs], "<i8")
    nulls = np.array([d is None for d in docs], np.uint8)
    return [HEADER.pack(MAGIC, VERSION, bits, block_ids, len(docs), len(ids)), named.tobytes(), nulls.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks]


class TokenFile:
    """Random access to one file, by document or by id position."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        magic, version, self.bits, self.block_ids, self.n_docs, self.n_ids = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token file")
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(self.file.read(self.n_docs), np.uint8)
        self.starts = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(self.file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.base = self.file.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (not included); only their blocks are read."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(self.base + int(self.offsets[first]))
        data = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            at = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[at : at + int(self.offsets[b + 1] - self.offsets[b])], self.bits, n))
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


#: Texts with other white space than ASCII's are encoded as a whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 characters stand for themselves,
    the characters from 256 on for the other bytes in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevelEncoder:
    """Ids of texts by the tokenizers library.

    A byte-level tokenizer splits a text before white space that follows anything else, so a text's ids are those of
    its chunks (white space and what follows it) one after the other. Chunks return; each is encoded once by the
    library and remembered under a 64-bit hash of its bytes. A whole slice of texts is cut, hashed and looked up at
    once in arrays. Ids found so are held against the chunk's bytes, which they spell; a chunk that only has another's
    hash is encoded by itself.
    """

    def __init__(self, path: str, bits: int = 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        byte = byte_alphabet()
        token = lambda i: bytes(map(byte.__getitem__, self.tokenizer.id_to_token(i) or ""))
        self.spelling = Spelling([added[i] if i in added else token(i) for i in range(self.tokenizer.get_vocab_size())])
        self.width = self.spelling.width
        self.known = Remembering(bits)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _each(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks. Those that begin with white space and do not end with it are encoded by one call, as one
        text, whose ids are cut where a chunk's bytes end."""
        out: list[np.ndarray | None] = [None] * len(chunks)
        joined = [k for k, c in enumerate(chunks) if SPACE[c[0]] and not SPACE[c[-1]]]
        if joined:
            ids = self._whole(b"".join([chunks[k] for k in joined]).decode())
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(chunks[k]) for k in joined])) + 1
            for k, x in zip(joined, np.split(ids, ends[:-1]), strict=True):
                out[k] = x
        return [self._whole(chunks[k].decode()) if x is None else x for k, x in enumerate(out)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [self._whole(t) if ODD_SPACE.search(t) else None for t in texts]
        plain = [k for k, x in enumerate(out) if x is None]
        coded = [texts[k].encode() for k in plain]
        bounds = np.cumsum([0, *map(len, coded)])
        whole = b"".join(coded)
        data = np.frombuffer(whole, np.uint8)
        space = SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ids, counts = self.known.ids(span_hashes(data, starts, ends), lambda at: self._each([whole[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        wrong = self.spelling.wrong(ids, counts, data, starts, ends)
        if len(wrong):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in zip(wrong.tolist(), self._each([whole[starts[k] : ends[k]] for k in wrong.tolist()]), strict=True):
                parts[k] = x
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]
        for k, i, j in zip(plain, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            out[k] = ids[i:j]
        return out


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One encoder a worker process, kept from task to task."""
    return ByteLevelEncoder(path)


@dataclass(frozen=True)
class Written:
    files: list[tuple[str, int, int]]
    """(file, ids in all files before it, documents), in order."""
    bits: int


def write_tokens(docs: DataFrame, path: str, encoder: Callable[[], object], vocabulary: int, end_id: int, block_ids: int = 4096, file_ids: int = 1 << 23) -> Written:
    """Encodes docs (doc_id, text) and writes token files under ``path``, a URI that executors reach (the shared
    folder). ``encoder`` makes, on each worker, an object with encode(texts) -> arrays of ids."""
    small_batches(docs.sparkSession)
    bits = bits_for(vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        made = encoder()
        part, seq, out = TaskContext.get().partitionId(), 0, []
        names: list = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> None:
            nonlocal seq, total
            name = f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.lstk"
            with fs.open_output_stream(f"{folder}/{name}") as f:
                for piece in file_bytes(names, counts, np.frombuffer(b"".join(held), "<u4"), bits, block_ids):
                    f.write(piece)
            out.append((part, seq, name, total, len(names)))
            names.clear(), counts.clear(), held.clear()
            seq, total = seq + 1, 0

        for part_ in slices(batches, 1):
            texts = [t or "" for t in part_.column(1).to_pylist()]
            for doc_id, ids in zip(part_.column(0).to_pylist(), made.encode(texts), strict=True):
                names.append(doc_id), counts.append(len(ids) + 1), held.append(ids.astype("<u4").tobytes() + end)
                total += counts[-1]
                if total >= file_ids:
                    flush()
        if names:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "file", "n_ids", "n_docs"])

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = sorted(map(tuple, ordered.mapInArrow(write, "part long, seq long, file string, n_ids long, n_docs long").collect()))  # one row a file
    files, before = [], 0
    for _, _, name, n_ids, n_docs in rows:
        files.append((f"{path}/{name}", before, n_docs))
        before += n_ids
    return Written(files, bits)


def read_tokens(spark: SparkSession, written: Written) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(*texts_of_all(batch), strict=True):
                f = TokenFile(uri)
                ids = f.ids(0, f.n_ids).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]
                docs = pa.array(f.doc_ids, mask=f.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([docs, pa.array(f.starts[:-1] + before), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                f.close()

    rows = [(f, b) for f, b, _ in written.files]
    files = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def texts_of_all(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()
