"""SimHash near-duplicates, found exactly with a vantage-point tree over the fingerprints.

1. Every text gets a 64-bit fingerprint: a bit is set if it is set in over
   half of the hashes of the text's word shingles.
2. Equal fingerprints form one class; only distinct ones go on.
3. A tree of vantage points, built on a bounded sample, deals them into shards
   of similar size by Hamming distance. A fingerprint lives in one shard and
   is sent as a query to every further shard that the triangle bound cannot
   rule out, so each pair within the distance meets in a shard.
4. A task searches its shard the same way, with further vantage points, down
   to small blocks that are compared outright. It returns the links as a
   forest, never all pairs: the result needs classes only.
5. Connected components of the forests give the groups.

A task holds bounded numbers of both: a shard that the tree cannot split (many
fingerprints around one point) is dealt into pieces, and one that many are sent
to into blocks of queries; each piece meets each block in a task of its own. The
numbers of pieces and blocks follow from the sample's way through the tree.

Edge cases: null, empty and blank texts have the fingerprint zero and are
linked like any other; texts of fewer words than a shingle hash their whole
word sequence; rows with equal ``doc_id`` stay separate rows; null ids take
part but never name a group unless no member has an id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import utf8, written
from cohortspark.llm.components import components, forest

SHINGLE, SEED, MOST_BITS = 3, 42, 3
SHARD = 65_536  # fingerprints that live in one shard, about
SAMPLE = 20_000  # fingerprints the tree is built on
ASKED = 8  # queries of a task, about, for each of the members of a shard
BLOCK = 1 << 17  # pairs compared at once
CHUNK = 1 << 16  # shingle hashes counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 bytes: A-Z lowered, words split at ASCII blanks, xxh64 with seed 42, majority bits."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        some = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in some), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: Sequence[Column] = ()) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit number; with ``keys`` (long columns) those too, as k0, k1, ..."""
    names = [f"k{i}" for i in range(len(keys))]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *(b.column(n) for n in names)], names=["doc_id", "fp", *names])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[k.alias(n) for k, n in zip(keys, names)], utf8(docs["text"]).alias("t"))
    return rows.mapInArrow(make, ", ".join(f"{n} long" for n in ["doc_id", "fp", *names]))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(x: np.ndarray) -> tuple[np.uint64, int] | None:
    """The point, of a few tried, whose median distance splits ``x`` most evenly; none if none splits it."""
    best = None
    for k in range(0, len(x), max(1, len(x) // 4)):
        d = distance(x, x[k])
        cut = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inside = int((d <= cut).sum())
        if inside < len(x) and (best is None or abs(2 * inside - len(x)) < best[0]):
            best = abs(2 * inside - len(x)), x[k], cut
    return None if best is None else best[1:]


class Tree:
    """Vantage points over a sample, split until a leaf stands for at most ``shard`` of ``total`` fingerprints."""

    def __init__(self, sample: np.ndarray, total: int, shard: int = SHARD, bits: int = MOST_BITS):
        self.bits, self.leaves = bits, 0
        self.pieces: list[int] = []  # parts a leaf's members are dealt into
        each = total / max(1, len(sample))
        self.root = self._grow(sample, each, shard)
        self.blocks = [1] * self.leaves  # parts a leaf's queries are dealt into
        for leaf, at, _ in self.route(sample):
            self.blocks[leaf] = max(1, int(np.ceil(len(at) * each / (ASKED * shard))))

    def _grow(self, x: np.ndarray, each: float, shard: int):
        split = _vantage(x) if len(x) * each > shard and len(x) > 1 else None
        if split is None:
            self.leaves += 1
            self.pieces.append(max(1, int(np.ceil(len(x) * each / (2 * shard)))))
            return self.leaves - 1
        point, cut = split
        near = distance(x, point) <= cut
        return point, cut, self._grow(x[near], each, shard), self._grow(x[~near], each, shard)

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions in ``x``, whether each lives there), all leaves a neighbour may live in."""
        todo = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at, home
                continue
            point, cut, near, far = node
            d = distance(x[at], point).astype(int)
            for child, lives, sent in ((near, d <= cut, d <= cut + self.bits), (far, d > cut, d > cut - self.bits)):
                todo.append((child, at[sent], (home & lives)[sent]))


def links(x: np.ndarray, q: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of one of ``x`` and one of ``q`` (values) that differ in at most ``bits`` bits."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    todo = [(x, q)]
    while todo:
        x, q = todo.pop()
        if not len(x) or not len(q):
            continue
        split = _vantage(x) if len(x) * len(q) > BLOCK and len(x) > 16 else None
        if split is not None:
            point, cut = split
            dx, dq = distance(x, point), distance(q, point).astype(int)
            todo += [(x[dx <= cut], q[dq <= cut + bits]), (x[dx > cut], q[dq > cut - bits])]
            continue
        step = max(1, BLOCK // len(x))
        for at in range(0, len(q), step):
            i, j = np.nonzero(distance(q[at : at + step, None], x[None, :]) <= bits)
            a, b = q[at + i], x[j]
            other = a != b
            if other.any():
                found.append((a[other].view(np.int64), b[other].view(np.int64)))
                held += len(found[-1][0])
                if held > 1_000_000:
                    found = [forest(*map(np.concatenate, zip(*found)))]
                    held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*map(np.concatenate, zip(*found)))


def similar(classes: DataFrame, bits: int = MOST_BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Distinct ``fp`` (long) to (node, component): groups of those within ``bits`` bits of each other, transitively."""
    spark = classes.sparkSession
    total = classes.count()
    share = min(1.0, sample / max(1, total))
    some = classes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    known = np.sort(np.array([r[0] for r in some.select("fp").limit(2 * sample).collect()], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree(known, total, shard, bits))  # at most 2 * sample nodes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for leaf, at, home in t.route(x):
                pieces, blocks = t.pieces[leaf], t.blocks[leaf]
                mixed = x[at] * np.uint64(0x9E3779B97F4A7C15)
                own = (mixed >> np.uint64(40)).astype(np.int64) % pieces
                block = (mixed >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.int64) % blocks
                for task in range(pieces * blocks):
                    # a member of a piece meets every block, a query of a block every piece
                    member, asks = home & (own == task // blocks), block == task % blocks
                    here = np.flatnonzero(member | asks)
                    cols = [np.full(len(here), leaf), np.full(len(here), task), x[at[here]].view(np.int64), member[here], asks[here]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["leaf", "task", "fp", "home", "asks"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = links(x[rows["home"].to_numpy(bool)], x[rows["asks"].to_numpy(bool)], bits)
        return pd.DataFrame({"a": a, "b": b})

    sent = classes.select("fp").mapInArrow(send, "leaf long, task long, fp long, home boolean, asks boolean")
    return components(sent.groupBy("leaf", "task").applyInPandas(search, "a long, b long"))


def _grouped(fps: DataFrame, first: Column, bits: int) -> DataFrame:
    """Written: each fingerprint with its group and the least ``first`` of its rows."""
    classes = written(fps.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-classes")
    groups = similar(classes.select("fp"), bits)
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    return written(named.select("fp", "first", "group"), "fingerprint-groups")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id of the group)."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    named = _grouped(fps, F.col("doc_id"), bits)
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    of_fp = written(named.join(least, "group").select("fp", "component_id"), "group-names")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, bits: int = MOST_BITS) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id.

    Rows without an id come after those with one; of rows with equal ids that
    with the smaller hash of id and text stays, and of rows equal in both any
    one.
    """
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    keys = [F.xxhash64(name, utf8(docs["text"])), F.xxhash64(F.lit(1), utf8(docs["text"]), name)]
    fps = written(fingerprints(docs, shingle, keys), "fingerprints")
    named = _grouped(fps, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k0", "k1"), bits)
    kept = written(named.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.k0").alias("_k0"), F.col("first.k1").alias("_k1")), "kept")
    rows = docs.withColumns({"_row_k0": keys[0], "_row_k1": keys[1]})
    there = rows.join(kept, (F.col("_row_k0") == F.col("_k0")) & (F.col("_row_k1") == F.col("_k1")), "left_semi")
    return there.dropDuplicates(["_row_k0", "_row_k1"]).drop("_row_k0", "_row_k1")
