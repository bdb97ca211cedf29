"""Packing tokenised documents into sequences by first-fit decreasing.

A document's ids are cut into full sequences and one rest. Rests are dealt at random into groups
of bounded size; each group is packed on its own, longest first, every piece into the first
sequence with room, found by a tournament tree over the sequences' free room. Groups are dealt by
a hash of a row number that the written table fixes, so that no document or copy makes one
group large, and what is lost can be computed again with the same result.
"""

from __future__ import annotations

import functools
import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, per_worker, texts, tuned, written

CAPACITY = 2048
#: The id that ends each document.
END_ID = 1
#: Rests in a group, on average.
GROUP_PIECES = 2048
#: Words that a worker keeps with their ids.
CACHE_WORDS = 250_000
#: How the vocabulary marks a token that ends a word.
WORD_END = "</w>"
VOCABULARY = "word_bpe_49k.json"

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(kind: str, end: int = 0x250) -> str:
    return "".join(f"\\u{c:04x}" for c in range(end) if unicodedata.category(chr(c))[0] == kind)


class Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class WordIds:
    """Ids of whole texts as little-endian 32-bit numbers, equal to the tokenizer's encode(text, add_special_tokens=False).

    The vocabulary merges within words only and marks the last token of each, so texts of plain
    characters are split into words by the tokenizer's own rule, the distinct new words of a batch
    are encoded together, and known ones are kept. A text with characters whose case or normal
    form depends on their neighbours, or with "<|", goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        letters, numbers = _ranges("L"), _ranges("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ \t\n\r{letters}{numbers}]+").findall
        self.odd = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\\|").search
        self._forget()

    def _forget(self) -> None:
        self.places = Places()
        self.flat = np.zeros(0, "<u4")  # the ids of all known words, in order of their places
        self.ends = np.zeros(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self) -> None:
        words, flat, held = self.places.new, [self.flat], [self.ends]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            held.append(held[-1][-1] + ends)
            flat.append(ids)
        self.flat, self.ends = np.concatenate(flat), np.concatenate(held)
        words.clear()

    def __call__(self, rows: list[str]) -> list[np.ndarray]:
        if len(self.places) > CACHE_WORDS:
            self._forget()
        get, split = self.places.__getitem__, []
        for t in rows:
            words = None if self.odd(t) else self.words(t.lower())
            split.append(None if words is None else np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        out = []
        for t, places in zip(rows, split):
            if places is None:
                out.append(self._ids(t))
                continue
            starts = self.ends[places]
            counts = self.ends[places + 1] - starts
            before = np.cumsum(counts) - counts
            out.append(self.flat[np.repeat(starts - before, counts) + np.arange(counts.sum())])
        return out


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece."""
    return [(s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].astype("<u4").tobytes())) for s in range(0, len(ids), capacity)]


def _pieces(batches, path: str, capacity: int):
    encode = per_worker(f"word ids {path}", lambda: WordIds(path))
    for b in batches:
        rows = []
        for doc, ids in zip(b.column(0).to_pylist(), encode(texts(b.column(1)))):
            ids = np.append(ids, np.uint32(END_ID))
            rows += [(doc, *piece, len(ids)) for piece in cut(ids, capacity)]
        yield batch(_PIECES, *zip(*rows)) if rows else batch(_PIECES, *[[]] * len(_PIECES))


class Rooms:
    """A tournament tree: each inner node holds the most free room below it; bins open from the left."""

    def __init__(self, most_bins: int, capacity: int):
        self.leaves = 1 << max(0, most_bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room for length, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        place, had = node - self.leaves, room[node]
        room[node] = had - length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return place, had


def first_fit(lengths, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given."""
    rooms = Rooms(len(lengths), capacity)
    return [(place, capacity - had) for place, had in map(rooms.put, lengths)]


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    places = np.array(first_fit(pdf["length"].tolist(), capacity)).reshape(-1, 2)
    return pd.DataFrame({"row": pdf["row"], "sequence_id": (pdf["grp"].to_numpy(np.int64) << 32) + places[:, 0], "offset": places[:, 1]})


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: such a document is the end id alone. Full pieces are sequences of
    their own, with negative sequence_id; rests share sequences. Repeated rows are packed each.
    An empty table gives an empty result. Other columns are ignored.
    """
    tuned(docs.sparkSession)
    path = vocabulary or tokenizer_path()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    pieces = rows.mapInArrow(functools.partial(_pieces, path=path, capacity=capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    groups = max(1, math.ceil(rests.count() / GROUP_PIECES))
    rests = rests.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return _pack(group, capacity)

    places = rests.select("row", "length", "grp").groupBy("grp").applyInPandas(packed, "row long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    out = full.unionByName(rests.drop("grp").join(places, "row"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
