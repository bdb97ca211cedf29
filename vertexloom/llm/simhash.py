"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most three of 64 bits differ in at most two once the worst of three
blocks is left out. So each distinct fingerprint emits, for each block left out, every variant of
the other bits within half of those two, one bit: 131 variants. Two fingerprints within reach meet
at a variant. (A ball of half of three over all 64 bits would miss pairs at distance three if
rounded down, and hold 2,081 variants if rounded up.) Variants are shuffled, colliding
fingerprints are compared in full, and links are reduced to forests as they are found, so that a
group of n fingerprints gives n - 1 links, not all pairs. Components follow by star contraction.

Copies collapse to one fingerprint first, so a group of copies with a third of all rows is one row
until the last join, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, numbered, texts, tuned, written

WORDS = 3
RADIUS = 3
SEED = 42
#: Lowest bit and width of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at a time.
CHUNK = 65_536

_PRINTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])
_VARIANTS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the text's word shingles."""
    parts = text.encode().lower().split()  # ASCII: bytes
    if not parts:
        return 0
    plain = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    if n == 1:
        hashes = digest(plain, SEED)
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8))
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        stops = ends[words - 1 :].tolist()
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        for at in range(0, n, CHUNK):
            hashes = b"".join([digest(plain[i:j], SEED) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in texts(b.column(2))], np.uint64).view(np.int64)
        yield batch(_PRINTS, b.column(0), b.column(1), fps)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) of every variant."""
    keys, n = [], len(fps)
    for k, (low, width) in enumerate(BLOCKS):
        out = ((1 << width) - 1) << low
        bits = [0, *(1 << i for i in range(64) if not out >> i & 1)]
        base = (fps & np.uint64(~out & (2**64 - 1))) | np.uint64((k + 1) << low)
        keys.append((base[:, None] ^ np.array(bits, np.uint64)[None, :]).ravel())
    each = [len(x) // max(n, 1) for x in keys]
    return np.concatenate(keys), np.concatenate([np.repeat(np.arange(n), e) for e in each])


def _emit(batches):
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            keys, own = variants(fps[at : at + 4096])
            yield batch(_VARIANTS, keys.view(np.int64), fps[at : at + 4096][own].view(np.int64))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes, each node to the smallest it reaches through these."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (p := parent.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return np.array([root(x) for x in nodes], np.int64), np.array(nodes, np.int64)


def spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fps that join whatever is joined by pairs within the radius: a search that compares each found node with those not found yet."""
    left, a, b = fps.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(left, x)
            if hit.any():
                found, left = left[hit], left[~hit]
                a += [x] * len(found)
                b += list(found)
                queue += list(found)
    return np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)


def _links_of(keys: np.ndarray, fps: np.ndarray):
    """keys sorted, with all rows of each key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    two = starts[sizes == 2]
    x, y = fps[two], fps[two + 1]
    ok = _near(x, y) & (x != y)
    pairs = [(x[ok].view(np.int64), y[ok].view(np.int64))]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        pairs.append(spanning(np.unique(fps[s : s + n])))
    a, b = (np.concatenate(z) for z in zip(*pairs))
    return forest(a, b) if len(a) else None


def _collide(batches):
    """Batches sorted by key; the last key of a batch may go on in the next."""
    keys, fps, links = [], [], []
    for b in batches:
        k, f = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(k):
            continue
        keys.append(k)
        fps.append(f.view(np.uint64))
        if sum(map(len, keys)) < 200_000 or k[-1] == keys[0][0]:
            continue
        allk, allf = np.concatenate(keys), np.concatenate(fps)
        at = int(np.searchsorted(allk, allk[-1]))
        keys, fps = [allk[at:]], [allf[at:]]
        if at and (found := _links_of(allk[:at], allf[:at])):
            links.append(found)
        if sum(len(a) for a, _ in links) > 500_000:  # the same links are found again and again
            links = [forest(*(np.concatenate(z) for z in zip(*links)))]
            if len(links[0][0]) > 250_000:
                yield batch(_LINKS, *links.pop())
    if keys and (found := _links_of(np.concatenate(keys), np.concatenate(fps))):
        links.append(found)
    if links:
        yield batch(_LINKS, *forest(*(np.concatenate(z) for z in zip(*links))))


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root for every node of links (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps until nothing changes; each round is written,
    and two numbers a round reach the driver.
    """
    links = written(links.where("a <> b").distinct(), name)
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # least values are written first: both sides of a join are plain shuffles then, which adaptive execution splits where one node has many links
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = written(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), f"{name}-large")
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        links = written(small, name)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def _component_ids(prints: DataFrame) -> DataFrame:
    """fp, component_id, keep_row of every distinct fingerprint of prints (row, doc_id, fp): the smallest doc_id that it reaches, and the row that has it (null ids last, then the smallest row)."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = written(prints.groupBy("fp").agg(best), "nodes")
    met = nodes.select("fp").mapInArrow(_emit, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(_collide, "a long, b long")
    roots = components(met)
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = written(nodes, "rooted")
    firsts = written(nodes.groupBy("root").agg(F.min("first").alias("least")), "component-firsts")
    return written(nodes.join(firsts, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keep_row")), "component-ids")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id reached over links between fingerprints of at most three
    differing bits, the row itself included. Null text counts as empty; texts without words have
    fingerprint zero and link like any other. Repeated rows each give a row. A null doc_id takes
    part but is never the smallest (a component of null ids has component_id null). An empty table
    gives an empty result. Other columns are ignored.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.lit(0).cast("long").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    prints = written(rows.mapInArrow(_fingerprints, "row long, doc_id long, fp long"), "fingerprints")
    return prints.join(_component_ids(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group, in all its columns: the smallest doc_id (null last), of rows that share it one.

    Decided row by row: a doc_id may be null or stand on rows of several texts, and columns may be
    called anything. Null text counts as empty, and texts without words are near each other. An empty
    table gives an empty result.
    """
    tuned(docs.sparkSession)
    rows = numbered(docs)
    plain = rows.select("row", rows["doc.doc_id"].cast("long").alias("doc_id"), rows["doc.text"].alias("text"))
    prints = written(plain.mapInArrow(_fingerprints, "row long, doc_id long, fp long"), "fingerprints")
    dropped = written(prints.join(_component_ids(prints), "fp").where("row <> keep_row").select("row"), "near-copies")
    return rows.hint("merge").join(dropped, "row", "left_anti").select("doc.*")
