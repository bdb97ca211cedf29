"""Documents as blocks of words, and counts that blocks ask for.

A block holds whole documents of BLOCK_WORDS words or so: the hashes of its distinct words, and for
each place the index of its word. It is one row, compressed, in a written table.

What a block wants to know of keys (n-grams, seeds) it asks for once: its distinct keys, sorted, are
cut into packs by range, one pack for each bucket. A bucket gets the packs of all blocks and answers
each of them in the order of its keys, so that no key has to travel back. A key that stands
everywhere costs one ask a block, however often it occurs: there is no hot key, and nothing is
gathered in one place but a bucket's packs, whose number of keys is bounded by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch, texts, written

BLOCK_WORDS = 1 << 20
#: Words of all documents for each bucket.
BUCKET_WORDS = 1 << 20
KEY_BITS = 48

_BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("ids", pa.binary())])


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space."""
    return text.encode().lower().split()


def squeezed(values: np.ndarray) -> bytes:
    """Integers from 0 on, compressed: the first bytes of all, then the second ones and so on."""
    values = np.ascontiguousarray(values, "<i8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _make(batches):
    ids, docs, parts, size, count = _Ids(), [], [], 0, 0
    part = TaskContext.get().partitionId() << 32

    def made() -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        every = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = np.array([len(p) for p in parts], np.int64)
        return batch(_BLOCKS, [part + count], [size], [docs], [squeezed(lengths)], [zstandard.ZstdCompressor(level=1).compress(hashes.tobytes())], [squeezed(every)])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            words = words_of(text)
            docs.append(doc)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield made()
                ids, docs, parts, size, count = _Ids(), [], [], 0, count + 1
    if docs:
        yield made()


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of all rows (doc_id, text), written; null text counts as empty."""
    kinds = "block long, size long, docs array<long>, lengths binary, words binary, ids binary"
    return written(rows.select("doc_id", "text").mapInArrow(_make, kinds), "blocks")


class Block:
    """A row of blocks()."""

    def __init__(self, table: pa.Table):
        row = table.slice(0, 1).to_pylist()[0]
        self.block: int = row["block"]
        self.docs: list[int | None] = row["docs"]
        self.lengths = unsqueezed(row["lengths"])
        self.hashes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["words"]), np.uint64)
        self.ids = unsqueezed(row["ids"])


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """KEY_BITS well mixed bits of each hash."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(64 - KEY_BITS)


def packs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, span) of sorted keys."""
    of = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]).tolist() if len(keys) else []
    for s, e in zip(edges, edges[1:]):
        yield int(of[s]), slice(s, e)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return squeezed(np.diff(keys.astype(np.int64), prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(data))


def buckets_for(table: DataFrame) -> int:
    """The number of buckets for a table of blocks; it grows with the words in it."""
    from pyspark.sql import functions as F

    return max(1, (table.agg(F.sum("size")).first()[0] or 0) // BUCKET_WORDS)
