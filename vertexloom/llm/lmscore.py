"""Scoring documents by cross-entropy difference of matched n-gram models.

Two bigram models, of a target domain and of the background, share one vocabulary, one order and
one smoothing. A document's score is the mean over its tokens of the loss under the background
model less the loss under the target model: higher means closer to the target.

Nothing is pruned and the models are never gathered: every word and bigram of every document is
counted, and each block of documents asks for the counts of just its own (see blocks.py). What is
gathered grows with the corpus, and no worker or driver holds more than a block's or a bucket's part.

A document's own words don't count for its own score: what it adds to a model is taken off before,
so that a text is as likely as the rest of the corpus makes it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, buckets_for, mixed_bits, packed_keys, packs, squeezed, unpacked_keys, unsqueezed
from .common import tuned, written

#: Counts that the word's probability adds to those after a context, and that each word of the vocabulary adds to its own.
PAIR_PRIOR, WORD_PRIOR = 4.0, 0.5
#: What stands before and after each document's words.
EDGE = xxhash.xxh64_intdigest(b" ")

_ASKS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("t", pa.binary()), ("b", pa.binary()), ("target", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("t", pa.binary()), ("b", pa.binary()), ("target", pa.binary()), ("words", pa.int64()), ("t_size", pa.int64()), ("b_size", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
_ANSWER_KINDS = "block long, bucket int, t binary, b binary, target binary, words long, t_size long, b_size long"


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


class Grams:
    """A block's tokens (the words of each document with words, then the edge), the words before them, and their distinct pairs."""

    def __init__(self, block: Block):
        self.full = np.flatnonzero(block.lengths)
        lengths = block.lengths[self.full]
        ends, edge = np.cumsum(lengths), len(block.hashes)
        self.hashes = np.append(block.hashes, np.uint64(EDGE))
        self.size = len(self.hashes)
        self.word = np.insert(block.ids, ends, edge)
        self.before = np.insert(block.ids, ends - lengths, edge)
        self.owner = np.repeat(np.arange(len(self.full)), lengths + 1)
        self.pairs, self.pair = np.unique(self.before * self.size + self.word, return_inverse=True)
        # keys of words are odd, those of pairs even
        word_keys = mixed_bits(self.hashes) | np.uint64(1)
        pair_keys = mixed_bits(self.hashes[self.pairs // self.size] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.pairs % self.size]) & ~np.uint64(1)
        if not len(self.full):
            word_keys = word_keys[:0]
        self.keys = np.concatenate([word_keys, pair_keys])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, weight: np.ndarray | None = None) -> np.ndarray:
        """Of all keys, in their own order; weight: of each token."""
        if not len(self.full):
            return np.zeros(0, np.int64)
        return np.concatenate([np.bincount(self.word, weight, self.size), np.bincount(self.pair, weight, len(self.pairs))]).astype(np.int64)

    def own(self, of: np.ndarray, size: int) -> np.ndarray:
        """For each token how often its document has what of says."""
        _, at, n = np.unique(self.owner * size + of, return_inverse=True, return_counts=True)
        return n[at]


def _ask(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    if not left.num_rows:
        return _table(_ASKS, [])
    block = Block(left)
    grams = Grams(block)
    target = np.zeros(len(block.docs), bool)
    target[right.column("at").to_numpy()] = True
    b, t = grams.counts()[grams.order], grams.counts(target[grams.full][grams.owner])[grams.order]
    rows = []
    for bucket, span in packs(grams.keys[grams.order], buckets):
        flags = None if rows else np.packbits(target).tobytes()  # comes back with the first answer
        rows.append((bucket, block.block, packed_keys(grams.keys[grams.order][span]), squeezed(t[span]), squeezed(b[span]), flags))
    return _table(_ASKS, rows)


def _count(asks: pa.Table) -> pa.Table:
    """Adds up a bucket's counts and answers each pack; one more row has the bucket's words and sizes."""
    keys = [unpacked_keys(k) for k in asks.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    t, b = (np.bincount(at, np.concatenate([unsqueezed(x) for x in asks.column(c).to_pylist()]), len(distinct)).astype(np.int64) for c in ("t", "b"))
    bucket, odd = asks.column("bucket")[0].as_py(), distinct % 2 == 1
    rows = [(-1, bucket, None, None, None, int(odd.sum()), int(t[odd].sum()), int(b[odd].sum()))]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    for block, flags, s, e in zip(asks.column("block").to_pylist(), asks.column("target").to_pylist(), [0, *ends], ends):
        rows.append((block, bucket, squeezed(t[at[s:e]]), squeezed(b[at[s:e]]), flags, None, None, None))
    return _table(_ANSWERS, rows)


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """In nats, from counts of the pair, of the word before, of the word, and of all words."""
    p = (word + WORD_PRIOR) / (total + WORD_PRIOR * vocabulary)
    return -np.log((pair + PAIR_PRIOR * p) / (before + PAIR_PRIOR))


def _score(left: pa.Table, right: pa.Table, vocabulary: int, t_size: int, b_size: int) -> pa.Table:
    if not left.num_rows:
        return _table(_OUT, [])
    block = Block(left)
    grams = Grams(block)
    out = {"t": np.zeros(len(block.docs)), "b": np.zeros(len(block.docs))}
    if len(grams.full):
        right = right.sort_by("bucket")
        target = np.unpackbits(np.frombuffer(next(f for f in right.column("target").to_pylist() if f), np.uint8))[grams.full].astype(bool)
        first = np.r_[True, grams.owner[1:] != grams.owner[:-1]]
        own_word, own_pair = grams.own(grams.word, grams.size), grams.own(grams.pair, len(grams.pairs))
        own_before = np.where(first, 1, np.roll(own_word, 1))
        own_size = np.bincount(grams.owner)
        for side, size in (("t", t_size), ("b", b_size)):
            counts = np.empty(len(grams.keys))
            counts[grams.order] = np.concatenate([unsqueezed(x) for x in right.column(side).to_pylist()])
            words, pairs = counts[: grams.size], counts[grams.size :]
            off = (target if side == "t" else np.ones(len(target), bool))[grams.owner]
            loss = losses(pairs[grams.pair] - off * own_pair, words[grams.before] - off * own_before, words[grams.word] - off * own_word, size - off * own_size[grams.owner], vocabulary)
            out[side][grams.full] = np.bincount(grams.owner, loss) / own_size
    t, b = np.round(out["t"], 9), np.round(out["b"], 9)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((block.docs, block.lengths, t, b, np.round(b - t, 9)), _OUT)], schema=_OUT)


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled as good and never as toxic."""
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, target_loss, background_loss, score for every row of docs (doc_id, text); labels: doc_id, quality, toxic.

    The target model is of the labelled rows (all rows of a doc_id), the background model of all
    rows; both predict each word and the end of each text. Losses are means over these, in nats; a
    text without words, or null, has 0 in all of them. Repeated rows are rows of their own, each part
    of what the other is measured by. Without target documents the target model is uniform over the
    shared vocabulary. Null doc_ids are never targets. An empty table gives an empty result. Other
    columns are ignored.
    """
    tuned(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    table = blocks(rows)
    flags = table.select("block", F.posexplode("docs").alias("at", "doc_id")).join(target_ids(labels).hint("merge"), "doc_id").select(F.col("block").alias("of"), "at")
    asks = table.groupBy("block").cogroup(flags.groupBy("of")).applyInArrow(functools.partial(_ask, buckets=buckets_for(table)), "bucket int, block long, keys binary, t binary, b binary, target binary")
    answers = written(asks.groupBy("bucket").applyInArrow(_count, _ANSWER_KINDS), "counts")
    totals = answers.where("block < 0").agg(F.sum("words"), F.sum("t_size"), F.sum("b_size")).first()
    vocabulary, t_size, b_size = (x or 0 for x in totals)
    solve = functools.partial(_score, vocabulary=vocabulary, t_size=t_size, b_size=b_size)
    told = answers.where("block >= 0").select("block", "bucket", "t", "b", "target")
    return table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(solve, "doc_id long, tokens long, target_loss double, background_loss double, score double")
