"""Logistic regression on hashed word features, trained with FTRL-proximal updates in Spark tasks.

Labelled rows are dealt into shards of a bounded number of rows; each shard
runs the per-coordinate FTRL updates over its rows for a few passes in a fixed
order, and the shards' weights are averaged (one-shot parameter mixing). At
most ``2**bits + 1`` weights exist, so they are collected and broadcast.

A document's features are the hashes of its word n-grams and, if asked for,
skip-grams; a word said twice in a row also counts as a feature that all
words share. Words are runs of word characters or runs of other non-blank
characters of the lower-cased text. A constant feature of value one comes
last.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import slices

WORD = re.compile(r"\w+|[^\w\s]+")
CACHED_WORDS = 60_000


@dataclass(frozen=True)
class Settings:
    """``ngrams``: longest word n-gram. ``skips``: largest number of words left out between the two of a
    skip-gram (0: none). ``counts``: a feature's value is its count, a row scaled to length one; else one if
    present. ``max_rows``: labelled rows used for fitting, about; beyond it a hash sample of that size.
    ``shard_rows``: rows one task trains on. ``block``: features held in memory; a task makes its passes over
    blocks of rows of that many."""

    bits: int = 18
    ngrams: int = 2
    skips: int = 0
    counts: bool = False
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    passes: int = 4
    max_rows: int = 100_000
    shard_rows: int = 16_000
    block: int = 2_000_000


class Features:
    def __init__(self, settings: Settings):
        self.s = settings
        self._hash: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known = self._hash
        if len(known) > CACHED_WORDS:
            known.clear()
        found = WORD.findall(text.lower())
        try:
            return np.array([known[w] for w in found], dtype=np.uint64)
        except KeyError:
            for w in set(found):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        return np.array([known[w] for w in found], dtype=np.uint64)

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray | float]:
        """Distinct feature indices, the constant one last, and their values."""
        h = self.words(text or "")
        mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - self.s.bits)
        again = np.full(int((h[1:] == h[:-1]).sum()), 2, dtype=np.uint64)
        parts, run = [h, again], h
        for n in range(2, self.s.ngrams + 1):
            run = run[:-1] * mix + h[n - 1 :] if len(h) >= n else h[:0]
            parts.append(run)
        for gap in range(1, self.s.skips + 1):
            if len(h) > gap + 1:
                parts.append(h[: -gap - 1] * mix + h[gap + 1 :] + np.uint64(gap))
        hashed = (np.concatenate(parts) * mix) >> shift
        idx, times = np.unique(hashed, return_counts=True)
        idx = np.append(idx, 2**self.s.bits).astype(np.int32)
        if not self.s.counts:
            return idx, 1.0
        return idx, np.append(times / max(1.0, math.sqrt(float(times @ times))), 1.0).astype(np.float32)


class Learner:
    """FTRL-proximal state: the sums ``z`` and the squared gradients ``n`` of each coordinate."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros(2**s.bits + 1), np.zeros(2**s.bits + 1)

    def weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        s = self.s
        return np.where(np.abs(z) > s.l1, (np.sign(z) * s.l1 - z) / ((s.beta + root) / s.alpha + s.l2), 0.0)

    def step(self, idx: np.ndarray, value: np.ndarray | float, y: float) -> None:
        zi, ni = self.z[idx], self.n[idx]
        root = np.sqrt(ni)
        w = self.weights(zi, root)
        g = (1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float((w * value).sum()))))) - y) * value
        ni += g * g
        self.z[idx] = zi + g - (np.sqrt(ni) - root) / self.s.alpha * w
        self.n[idx] = ni

    def passes(self, rows: list) -> None:
        for _ in range(self.s.passes):
            for idx, value, y in rows:
                self.step(idx, value, y)

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(self.z, np.sqrt(self.n))
        used = np.flatnonzero(w)
        return used, w[used]


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights as (indices, values).

    ``learn`` says of a ``labels`` row (by its ``doc_id``) whether it may be
    learnt from. A document with several label rows takes the largest. Rows
    whose text or label is null are left out. Without any row: no weights.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    total = known.count()
    if not total:
        return none
    order = F.xxhash64("doc_id")
    share = min(1.0, s.max_rows / total)
    if share < 1.0:
        known = known.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000))
    shards = max(1, math.ceil(min(total, s.max_rows) / s.shard_rows))
    # at most about max_rows rows of two numbers: a bounded broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(known), "doc_id").where(F.col("_text").isNotNull())
    rows = rows.select("_text", "_y", F.xxhash64("doc_id", F.lit(7)).alias("_o")).withColumn("_shard", F.pmod("_o", F.lit(shards)).cast("int"))
    # dealt by number, not by the number's hash: one shard a task
    rows = rows.repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_o", "_text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, shard, learner, held, size = Features(s), None, Learner(s), [], 0

        def done():
            learner.passes(held)
            idx, w = learner.sparse()
            return pa.RecordBatch.from_pydict({"idx": pa.array(idx, pa.int64()), "w": pa.array(w, pa.float64())})

        for b in slices(batches):
            for text, y, k in zip(b.column("_text").to_pylist(), b.column("_y").to_pylist(), b.column("_shard").to_pylist()):
                if k != shard:
                    if shard is not None:
                        yield done()
                    shard, learner, held, size = k, Learner(s), [], 0
                held.append((*features.row(text), y))
                size += len(held[-1][0])
                if size > s.block:
                    learner.passes(held)
                    held, size = [], 0
        if shard is not None:
            yield done()

    each = rows.mapInArrow(fit, "idx long, w double")
    mean = each.groupBy("idx").agg((F.sum("w") / shards).alias("w")).toPandas()  # at most 2**bits + 1 rows
    mean = mean.sort_values("idx")
    return mean["idx"].to_numpy(np.int64), mean["w"].to_numpy(np.float64)


def scorer(spark, weights: tuple[np.ndarray, np.ndarray], s: Settings):
    """A column function: text to the probability of label 1 (whole text; null counts as empty)."""
    sent = spark.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))  # at most 2**bits + 1 pairs

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(2**s.bits + 1)
        dense[sent.value[0]] = sent.value[1]
        features = Features(s)
        for texts in parts:
            out = []
            for some in slices([texts]):
                for text in some.to_pylist():
                    idx, value = features.row(text)
                    out.append(float((dense[idx] * value).sum()))
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(np.array(out, float), -35, 35))))

    return lambda text: score(text.cast("string"))
