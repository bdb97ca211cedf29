"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each slot, one bit per language. A language's n-grams set its
bit at three slots each; one lookup, the AND of three slots, returns all languages that contain an
n-gram. A document's n-grams are looked up at once and counted per language; counts are corrected
for each language's rate of false positives, and the largest decides.

Learning counts the n-grams of every training document in the workers and adds the counts up in a
shuffle. An n-gram belongs to a language if it makes up at least MIN_SHARE of the language's n-grams
and at least RELATIVE of its share in the language where it is most frequent. So a language has at
most 1/MIN_SHARE n-grams, whatever the size of the corpus, and the filter is small enough to send to
every worker.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, per_worker, texts, tuned, written

ORDERS = (3, 4)
#: An n-gram's least share of its language: a language has at most 1/MIN_SHARE of them.
MIN_SHARE = 1e-5
#: ... and its least share relative to the language where it is most frequent.
RELATIVE = 0.25
PROBES = 3
#: Filter slots for each n-gram.
SLOTS_PER_GRAM = 8
UNDETERMINED = "und"
#: The pipeline rejects a document whose score is below.
MIN_SCORE = 0.05
#: Characters looked at at a time.
CHUNK = 1 << 18
#: Distinct (language, n-gram) counts that a worker holds.
HELD = 1 << 19

_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _letters() -> np.ndarray:
    return per_worker("letters", _fold)


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha() or unicodedata.category(x)[0] == "M":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(rows: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all rows, runs of anything else as one space, each row between spaces; and each character's row."""
    points = np.frombuffer("".join(f"\n{t}\n\n" for t in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(rows)), [len(t) + 3 for t in rows])
    codes = fold[points]
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
    first = np.r_[True, own[1:] != own[:-1]]
    keep |= first
    return codes[keep], own[keep]


def _long_codes(text: str, fold: np.ndarray) -> np.ndarray:
    """The codes of one long row, as _codes() has them, made a part at a time."""
    parts, last = [np.array([32], np.uint32)], 32
    for at in range(0, len(text), CHUNK):
        codes = fold[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        before = np.r_[np.uint32(last), codes[:-1]]
        last = codes[-1]
        parts.append(codes[(codes != 32) | (before != 32)])
    return np.concatenate([*parts, np.array([32] * int(last != 32), np.uint32)])


def _parts(rows: list[str], fold: np.ndarray):
    """(codes, their rows, places where n-grams may begin) of CHUNK characters or so; the n-grams of a long row are all in one part each."""
    held, size = [], 0

    def joined():
        codes, own = _codes([rows[i] for i in held], fold)
        return codes, np.array(held)[own], len(codes)

    for i, t in enumerate(rows):
        if len(t) > CHUNK:
            codes, over = _long_codes(t, fold), max(ORDERS) - 1
            for at in range(0, len(codes), CHUNK):
                part = codes[at : at + CHUNK + over]
                yield part, np.full(len(part), i), CHUNK
            continue
        held.append(i)
        size += len(t)
        if size >= CHUNK:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def grams(rows: list[str], fold: np.ndarray):
    """(n-grams as integers, their rows), a part and an order at a time: spans of letters and single spaces within a row, with a letter each."""
    for codes, own, begin in _parts(rows, fold):
        codes = codes.astype(np.uint64)
        for n in ORDERS:
            size = min(begin, len(codes) - n + 1)
            if size <= 0:
                continue
            out = np.zeros(size, np.uint64)
            for i in range(n):
                out = out * np.uint64(0x110000) + codes[i : i + size] if n < 4 else (out << np.uint64(16)) ^ codes[i : i + size]
            inner = (own[:size] == own[n - 1 : n - 1 + size]) & ~((codes[:size] == 32) & (codes[1 : size + 1] == 32))
            yield (out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)).view(np.int64)[inner], own[:size][inner]


def _count(batches):
    fold, held, size = _letters(), {}, 0

    def merged() -> list:
        out = []
        for lang, parts in held.items():
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            out.append((lang, keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)))
        return out

    def flush():
        for lang, keys, n in merged():
            yield batch(_COUNTS, [lang] * len(keys), keys, n)

    for b in batches:
        rows, langs = texts(b.column(0)), b.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for t, lang in zip(rows, langs):
            by.setdefault(lang, []).append(t)
        for lang, mine in by.items():
            for keys, _ in grams(mine, fold):
                keys, n = np.unique(keys, return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
        if size > HELD:
            held = {lang: [(keys, n)] for lang, keys, n in merged()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD // 2:
                yield from flush()
                held, size = {}, 0
    yield from flush()


@dataclass
class LanguageFilter:
    langs: list[str]
    table: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray
    fallback: int

    @staticmethod
    def build(langs: list[str], by_lang: list[np.ndarray], fallback: int) -> LanguageFilter:
        most = sum(map(len, by_lang))
        slots = 1 << max(10, math.ceil(math.log2(max(1, most * SLOTS_PER_GRAM))))
        table = np.zeros((slots, (len(langs) + 63) // 64), np.uint64)
        rate = np.zeros(len(langs))
        for i, keys in enumerate(by_lang):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            for where in _probes(keys, slots):
                table[where, word] |= bit
            rate[i] = ((table[:, word] & bit) != 0).mean() ** PROBES
        return LanguageFilter(langs, table, rate, fallback)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages that contain it, as bits."""
        out = None
        for where in _probes(keys, len(self.table)):
            out = self.table[where] if out is None else out & self.table[where]
        return out


def _probes(keys: np.ndarray, slots: int):
    k, shift = keys.view(np.uint64), np.uint64(64 - int(math.log2(slots)))
    for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[:PROBES]:
        h = k * np.uint64(odd)
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> shift


def learn(docs: DataFrame) -> LanguageFilter:
    """From docs (text, lang): rows of null lang don't count."""
    tuned(docs.sparkSession)
    rows = docs.select("text", docs["lang"].cast("string").alias("lang")).where("lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    best = shares.groupBy("gram").agg(F.max("share").alias("most"))
    held = shares.join(best, "gram").where(F.col("share") >= RELATIVE * F.col("most")).select("lang", "gram")
    sizes = {r.lang: r.total for r in totals.collect()}
    langs = sorted(sizes)
    table = held.toArrow()
    names, keys = table.column("lang").to_numpy(), table.column("gram").to_numpy()
    return LanguageFilter.build(langs, [np.sort(keys[names == x]) for x in langs], max(range(len(langs)), key=lambda i: sizes[langs[i]], default=0))


def _predict_rows(rows: list[str], f: LanguageFilter, fold: np.ndarray) -> tuple[list[str], list[float]]:
    hits, seen = np.zeros((len(rows), len(f.langs))), np.zeros(len(rows))
    for keys, own in grams(rows, fold):
        masks = f.masks(keys)
        seen += np.bincount(own, minlength=len(rows))
        for i in range(len(f.langs)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] += np.bincount(own, bit, len(rows))
    names, scores = [], []
    for t, h, n in zip(rows, hits, seen):
        if not f.langs or not any(map(str.isalpha, t)):
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        right = np.maximum(0, h - n * f.false_rate) / (1 - np.minimum(f.false_rate, 0.99))
        best = int(right.argmax()) if right.max() > 0 else f.fallback
        names.append(f.langs[best])
        scores.append(float(min(1.0, right[best] / max(n, 1))))
    return names, scores


def _predict(batches, shared):
    f, fold = shared.value, _letters()
    for b in batches:
        yield batch(_OUT, b.column(0), b.column(1), *_predict_rows(texts(b.column(2)), f, fold))


def _told(batches, shared, at: int, min_score: float):
    f, fold = shared.value, _letters()
    for b in batches:
        names, scores = _predict_rows(texts(b.column(at)), f, fold)
        yield b.filter(pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores)], pa.bool_()))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learns from rows that are not held out and have a lang. score is the share of the text's
    n-grams, corrected for false positives, that the language contains. A null text or one
    without a letter is "und" with score 0, and so is every text if nothing could be learned; a
    text none of whose n-grams is known gets the language with the most n-grams, with score 0;
    ties go to the language that sorts first. Empty tables give empty results; other columns are ignored.
    """
    model = learn(docs.where(~held_out(docs["doc_id"])))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(functools.partial(_predict, shared=shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those whose language can't be told: no letter, or too few known n-grams. All columns stay as they are."""
    model = learn(docs.where(~held_out(docs["doc_id"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")
    return docs.mapInArrow(functools.partial(_told, shared=shared, at=at, min_score=min_score), docs.schema)
