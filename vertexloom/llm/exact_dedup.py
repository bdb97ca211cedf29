"""Exact deduplication against immutable snapshots through static binary-fuse filters.

A snapshot keeps one row per distinct digest, split into buckets by digest, and one binary-fuse
filter per bucket, built once. Digests of an incoming batch are first grouped among themselves;
each distinct one probes its bucket's filter. Negatives are new for certain. Positives join the
snapshot's exact bucket, and texts of equal digest are compared byte by byte.

Every shuffle before the last carries distinct digests only, so a group of copies that holds a
third of all rows is one row there; the last join, from rows to their group, is one that adaptive
execution can split.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, numbered, texts, tuned, written

#: Bytes that do not count when texts are compared.
IGNORED = b" \t\n\x0b\x0c\r"
#: Distinct digests that one filter is meant to hold.
BUCKET_KEYS = 65_536

_DIGESTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("sha", pa.binary()), ("cp", pa.int64())])


# ---------------------------------------------------------------- binary-fuse filter

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


@dataclass
class FuseFilter:
    """A three-wise binary-fuse filter of 16-bit fingerprints: no false negative, one false positive in 65,536."""

    seed: int
    segment: int
    segments: int
    table: np.ndarray

    @staticmethod
    def build(keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        size = max(n, 2)
        segment = 1 << max(2, min(18, int(math.log(size) / math.log(3.33) + 2.25)))
        room = size * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(size))
        segments = max(1, math.ceil(room / segment) - 2)
        length = (segments + 2) * segment
        for seed in range(1000):
            h = _mix(keys, seed)
            where = _slots(h, segment, segments)
            count = np.bincount(where.ravel(), minlength=length)
            owner = np.zeros(length, np.int64)
            for j in range(3):
                np.bitwise_xor.at(owner, where[:, j], np.arange(n))
            rounds, done = [], 0
            while len(single := np.flatnonzero(count == 1)):
                ids, at = np.unique(owner[single], return_index=True)
                rounds.append((ids, single[at]))
                done += len(ids)
                for j in range(3):
                    np.subtract.at(count, where[ids, j], 1)
                    np.bitwise_xor.at(owner, where[ids, j], ids)
            if done == n:
                break
        else:
            raise RuntimeError("no seed gives a filter")
        table, prints = np.zeros(length, np.uint16), _prints(h)
        for ids, slot in reversed(rounds):  # a slot is still zero when it is set
            a, b, c = where[ids].T
            table[slot] = prints[ids] ^ table[a] ^ table[b] ^ table[c]
        return FuseFilter(seed, segment, segments, table)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = _slots(h, self.segment, self.segments).T
        return _prints(h) == self.table[a] ^ self.table[b] ^ self.table[c]


def _keys(shas) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(s)[8:16] for s in shas), np.uint64)


# ---------------------------------------------------------------- digests and snapshots

def normalised(text: str) -> bytes:
    return text.encode().translate(None, IGNORED)


def _digest(batches):
    for b in batches:
        rows = texts(b.column(3))
        yield batch(_DIGESTS, b.column(0), b.column(1), b.column(2), [hashlib.sha256(normalised(t)).digest() for t in rows], [len(t) for t in rows])


def digests(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, held, text) with sha (of the normalised text) and cp (code points of the original) instead of the text."""
    return rows.select("row", "doc_id", "held", "text").mapInArrow(_digest, "row long, doc_id long, held boolean, sha binary, cp long")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: best holds the row that stays (most code points, then smallest doc_id, null last)."""
    best = F.struct("cp", F.bitwise_not(F.col("doc_id")).alias("inv"), F.bitwise_not(F.col("row")).alias("inv_row"))
    return rows.groupBy("sha").agg(F.max(best).alias("best"), F.count("*").alias("n"))


@dataclass
class Snapshot:
    """Immutable: exact has (sha, bucket, best, n), filters has one row per bucket."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_keys(pdf["sha"]))
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1].to_numpy(), "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.table.tobytes()]})


def build_snapshot(rows: DataFrame, name: str = "snapshot") -> Snapshot:
    """rows: sha, cp, doc_id, row."""
    exact = written(_grouped(rows), name)
    buckets = max(1, math.ceil(exact.count() / BUCKET_KEYS))
    exact = exact.withColumn("bucket", _bucket(buckets))
    filters = exact.select("bucket", "sha").groupBy("bucket").applyInPandas(_build, "bucket int, seed int, segment int, segments int, cells binary")
    return Snapshot(exact, written(filters, f"{name}-filters"), buckets)


def _probe(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if len(filters) and len(pdf):
        f = filters.iloc[0]
        hit = FuseFilter(int(f.seed), int(f.segment), int(f.segments), np.frombuffer(f.cells, np.uint16)).contains(_keys(pdf["sha"]))
    else:
        hit = np.zeros(len(pdf), bool)
    return pd.DataFrame({"sha": pdf["sha"], "hit": hit})


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """sha, hit for every distinct digest of a batch: hit is false only where the snapshot lacks it."""
    probes = groups.select("sha", _bucket(snapshot.buckets).alias("bucket"))
    return probes.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(_probe, "sha binary, hit boolean")


def _plain(batches):
    """A doc_id may stand on rows of several texts: only those of the digest count."""
    for b in batches:
        rows = [(s, normalised(t)) for s, t in zip(b.column(0).to_pylist(), texts(b.column(1)))]
        rows = [(s, t) for s, t in rows if hashlib.sha256(t).digest() == s]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], names=["sha", "plain"])


def _same_bytes(positives: DataFrame, docs: DataFrame) -> DataFrame:
    """sha, same: whether the two texts behind a digest, one of either side, are equal byte by byte.

    positives: sha, doc_id (two rows a digest).
    """
    held = positives.join(docs.select("doc_id", "text").hint("merge"), "doc_id").select("sha", "text")
    plain = held.mapInArrow(_plain, "sha binary, plain binary")
    return plain.groupBy("sha").agg((F.min("plain") == F.max("plain")).alias("same"))


def _half(doc_id: Column) -> Column:
    """Whether a row is in the snapshot if nothing else is said: about half of all ids are."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(2)) == 0


def _decided(rows: DataFrame) -> DataFrame:
    """row, sha, held, best, n for every row of rows (row, doc_id, text, held): the group's row that stays, and its size."""
    every = written(digests(rows), "digests")
    snapshot = build_snapshot(every.where("held"))
    groups = written(_grouped(every.where("not held")), "batch")
    hits = written(screen(groups, snapshot).where("hit").select("sha"), "hits")
    found = hits.join(groups, "sha").select("sha", F.col("best").alias("b_best"), F.col("n").alias("b_n")).join(snapshot.exact, "sha")
    found = written(found.select("sha", "b_best", "b_n", "best", "n"), "positives")
    sides = found.select("sha", F.explode(F.array("best.inv", "b_best.inv")).alias("inv")).select("sha", F.bitwise_not(F.col("inv")).alias("doc_id"))
    differ = _same_bytes(sides, rows).where(~F.col("same")).select("sha")
    merged = found.join(differ, "sha", "left_anti").select("sha", F.greatest("best", "b_best").alias("m_best"), (F.col("n") + F.col("b_n")).alias("m_n"))
    sized = snapshot.exact.select("sha", "best", "n", F.lit(True).alias("held")).unionByName(groups.withColumn("held", F.lit(False)))
    sized = sized.join(merged, "sha", "left").select("sha", "held", F.coalesce("m_best", "best").alias("best"), F.coalesce("m_n", "n").alias("n"))
    sized = written(sized, "groups")  # so that both sides of the next join are plain shuffles, which can be split
    return every.join(sized, ["sha", "held"])


def exact_dedup(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Duplicate groups over all of docs (doc_id, text): rows where held is true form the snapshot, the others the incoming batch.

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row. Null text counts as
    empty; empty texts are equal to each other. Of equal texts the row with the most code points
    stays, then the smallest doc_id (null last); of rows that are the same in both, one stays.
    An empty table gives an empty result. Other columns are ignored.
    """
    tuned(docs.sparkSession)
    held = _half(docs["doc_id"]) if held is None else held
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    return _decided(rows).select(
        "doc_id",
        F.bitwise_not(F.col("best.inv")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.bitwise_not(F.col("row")) == F.col("best.inv_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the one that exact_dedup() keeps, in all its columns.

    Decided row by row: a doc_id may be null or stand on rows of several texts, and columns may be
    called anything. Null text counts as empty. An empty table gives an empty result.
    """
    tuned(docs.sparkSession)
    rows = numbered(docs)
    doc_id = rows["doc.doc_id"].cast("long")
    decided = _decided(rows.select("row", doc_id.alias("doc_id"), rows["doc.text"].alias("text"), _half(doc_id).alias("held")))
    dropped = written(decided.where(F.bitwise_not(F.col("row")) != F.col("best.inv_row")).select("row"), "copies")
    return rows.hint("merge").join(dropped, "row", "left_anti").select("doc.*")


SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from n window w as (partition by text_sha256 order by cp desc, doc_id)
"""
