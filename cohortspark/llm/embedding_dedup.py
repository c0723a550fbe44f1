"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector falls into it if their inner product
exceeds a threshold. Directions are structured: after a random rotation the
space is cut in two halves, each with a random code of unit vectors, and every
pair of code words is a direction. ``CODES`` such codes, each over another
split of the coordinates, are used side by side, since the directions of one
code hang on few words. A vector's filters are list-decoded: only words that
reach the threshold with the best word of the other half are paired, so the
cost follows the code's size and the filters found, not the number of
directions. Vectors that share a filter are compared exactly, in double
precision.

The threshold follows from the number of vectors of a length and the law of
spherical caps in that dimension: a filter should hold ``BUCKET`` of them if
they were spread evenly. The number of filters is measured: it grows until at
most ``MISS`` of ``PAIRS`` synthetic pairs at the least cosine share none. Up
to ``BLOCK`` vectors of a length share one filter, so none of their links is
missed.

Equal vectors form one class before anything else, so copies cost nothing. A
filter with many classes is dealt into blocks, a task for each pair of
blocks. A pair counts for the first filter it shares only, so links are
distinct without a further shuffle. Pairs never leave their task: it returns,
for each filter, how many links each of its vectors has found and a forest over
them, so what is written grows with the vectors in the filters, not with their
pairs.

Edge cases: a vector that is null or empty, is zero, or has a null or
non-finite component links with nothing and is its own component; vectors of
different lengths never link; rows without a vec_id link with nothing, have no
component and are not kept; rows that repeat a vec_id share its node, and all
of them count as vectors; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import partitions, written
from cohortspark.llm.components import components, forest

COSINE = 0.9
BUCKET, SHARED = 48, 18  # vectors a filter should hold; filters a pair should share, to begin with
CODES = 8  # pairs of half codes, each over another split of the space
MISS = 0.001  # most synthetic pairs at the least cosine that may share no filter
PAIRS = 4000  # synthetic pairs that this is measured on
LEAST_DIMENSION = 16  # shorter vectors get zeros behind, which changes no cosine
BLOCK = 512  # classes of a filter compared in one task
SEED = 20


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _above(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values and the share of the unit sphere on which a coordinate exceeds each."""
    angle = np.linspace(math.pi, 0, 200_001)
    share = np.cumsum(np.sin(angle[::-1]) ** (dimension - 2))[::-1]
    return np.cos(angle), share / share[0]


def cap(total: int, dimension: int, cosine: float, bucket: int = BUCKET) -> tuple[float, float, float]:
    """(least inner product, share of vectors in a filter, share of those whose mate at ``cosine`` is in it too)."""
    dimension = max(dimension, LEAST_DIMENSION)
    share = min(0.05, bucket / max(1, total))
    values, above = _above(dimension)
    cut = float(np.interp(-share, -above, values))
    x = np.linspace(cut, 1, 4002)[:-1]
    density = (1 - x * x) ** ((dimension - 3) / 2)
    need = (cut - cosine * x) / np.maximum(np.sqrt((1 - cosine * cosine) * (1 - x * x)), 1e-12)
    both = np.interp(need, *_above(dimension - 1))
    return cut, share, float((density * both).sum() / density.sum())


def missed(dimension: int, cosine: float, cut: float, size: int, pairs: int = PAIRS, seed: int = SEED) -> float:
    """Share of synthetic pairs at ``cosine`` that have no filter in common."""
    rng = np.random.default_rng([seed, dimension])
    lost = 0
    for n in [512] * (pairs // 512) + [pairs % 512] * (pairs % 512 > 0):
        x = unit(rng.standard_normal((n, dimension)))
        z = rng.standard_normal((n, dimension))
        if dimension > 1:
            z -= (z * x).sum(axis=1, keepdims=True) * x
            y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(z)
        else:
            y = x
        lost += sum(not len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(decoded(x, cut, size), decoded(y, cut, size)))
    return lost / pairs


@lru_cache(maxsize=64)
def family(total: int, dimension: int, cosine: float) -> tuple[float, int]:
    """(least inner product, code words a half) for ``total`` vectors: pairs miss all filters in at most ``MISS`` of the cases."""
    cut, share, also = cap(total, dimension, cosine)
    shared = SHARED
    while True:
        size = math.ceil(math.sqrt(shared / also / share / CODES))
        if missed(dimension, cosine, cut, size) <= MISS:
            return cut, size
        shared *= 1.25


@lru_cache(maxsize=4)
def codes(dimension: int, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Rotation, and each code's order of coordinates and two halves' words, the same in every task."""
    rng = np.random.default_rng([SEED, dimension, size])
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
    half = (dimension + 1) // 2
    made = []
    for _ in range(CODES):
        words = [rng.standard_normal((size, n)) for n in (half, dimension - half)]
        made.append((rng.permutation(dimension), *(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) for w in words)))
    return rotation, made


def decoded(rows: np.ndarray, cut: float, size: int) -> list[np.ndarray]:
    """Ascending numbers of all filters of each unit vector."""
    rows = np.pad(rows, ((0, 0), (0, max(0, LEAST_DIMENSION - rows.shape[1]))))
    rotation, made = codes(rows.shape[1], size)
    turned = rows @ rotation
    least = cut * math.sqrt(2)  # a direction is a pair of unit words, so of length sqrt(2)
    owners, numbers = [], []
    for k, (places, one, two) in enumerate(made):
        first, second = turned[:, places[: one.shape[1]]] @ one.T, turned[:, places[one.shape[1] :]] @ two.T
        # words that reach the threshold with the other half's best
        row, word = np.nonzero(first >= least - second.max(axis=1, keepdims=True))
        other, mate = np.nonzero(second >= least - first.max(axis=1, keepdims=True))
        many = np.bincount(other, minlength=len(rows))
        mates = many[row]
        own = np.repeat(np.arange(len(row)), mates)
        at = np.arange(len(own)) + np.repeat((np.cumsum(many) - many)[row] - (np.cumsum(mates) - mates), mates)
        hit = first[row, word][own] + second[other, mate][at] >= least
        own, at = own[hit], at[hit]
        owners.append(row[own])
        numbers.append((k * size + word[own]) * size + mate[at])
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    order = np.lexsort((number, owner))
    return np.split(number[order], np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1])


def _compared(x: np.ndarray, lists: list[np.ndarray], filter_id: int, left: np.ndarray, right: np.ndarray, cosine: float):
    """Pairs of the rows ``left`` and ``right`` at the cosine or above that share no filter before this one."""
    i, j = np.nonzero(x[left] @ x[right].T >= cosine)
    i, j = left[i], right[j]
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([i, j]))
    before = [lists[k][lists[k] < filter_id] for k in used]
    names, at = np.unique(np.concatenate(before), return_inverse=True)
    has = np.zeros((len(used), len(names)), np.float32)
    has[np.repeat(np.arange(len(used)), [len(b) for b in before]), at] = 1
    earlier = has @ has.T > 0
    new = ~earlier[np.searchsorted(used, i), np.searchsorted(used, j)]
    return i[new], j[new]


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links between different classes of ``classes`` (node, copies, v), as rows (a, b, n).

    With ``n`` over 0 node ``a`` has that many linked vectors (``b`` is null);
    with 0 the row is an edge of a forest over linked nodes.
    """
    spark = classes.sparkSession
    # a length with few classes has one filter that holds them all
    many = classes.groupBy(F.size("v").alias("d")).count().where(F.col("count") > BLOCK).collect()
    families = {r["d"]: family(r["count"], r["d"], cosine) for r in many}
    number = np.int32 if all(CODES * size * size < 1 << 31 for _, size in families.values()) else np.int64

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(v) for v in b.column("v")])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for part in np.array_split(at, -(-len(at) // 512)):
                    some = b.take(pa.array(part))
                    values = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d)
                    found = decoded(unit(values), *families[d]) if d in families else [np.zeros(1, np.int64)] * len(part)
                    which = np.repeat(np.arange(len(part)), [len(f) for f in found])
                    rows = some.take(pa.array(which))
                    lists = [f.astype(number).tobytes() for f in found]
                    raw = pa.array([lists[k] for k in which], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(which), d, np.int32)), pa.array(np.concatenate(found)), *(rows.column(c) for c in ("node", "copies", "v")), raw],
                        names=["d", "f", "node", "copies", "v", "fs"],
                    )

    kind = dict(classes.dtypes)["v"]
    cast_rows = written(classes.mapInArrow(cast, f"d int, f long, node long, copies long, v {kind}, fs binary"), "filters")
    large = cast_rows.groupBy("d", "f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = written(large.select("d", "f", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-filters")
    dealt = cast_rows.join(large, ["d", "f"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    group = ["d", "f", "low", "high"]
    dealt = dealt.select(*group, "own", "node", "copies", "v", "fs").repartition(partitions(spark), *group).sortWithinPartitions(*group)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(t: pa.Table):
            keys = np.stack([t.column(c).to_numpy() for c in group])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
            lists = [np.frombuffer(x, number) for x in t.column("fs").to_pylist()]
            flat = t.column("v").combine_chunks()
            out = []
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                d, f, low, high = (int(k) for k in keys[:, s])
                x = unit(flat.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(e - s, d))
                left, right = np.flatnonzero(own[s:e] == low), np.flatnonzero(own[s:e] == high)
                i, j = _compared(x, lists[s:e], f, left, right, cosine)
                if low == high:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                many = np.bincount(i, copies[j + s], e - s) + np.bincount(j, copies[i + s], e - s)
                has = np.flatnonzero(many)
                low, high = forest(node[i + s], node[j + s])
                out.append((np.concatenate([node[has + s], low]), np.concatenate([has * 0 - 1, high]), np.concatenate([many[has], low * 0])))
            a, b, n = (np.concatenate(c).astype(np.int64) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], names=["a", "b", "n"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = [t.column(c).to_numpy() for c in group]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
            if whole:
                yield done(t.slice(0, whole).combine_chunks())
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield done(rest.combine_chunks())

    return dealt.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), sound.alias("sound"), F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2")
    )
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    found = written(links(classes.select("node", "copies", "v"), cosine), "links")
    degree = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.select("k1", "k2", "node", "copies").join(degree, "node", "left").join(components(found.where("n = 0").select("a", "b")), "node", "left")
    named = named.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = written(named, "vector-groups").withColumn("sound", F.lit(True))
    out = rows.select("vec_id", "sound", "k1", "k2").join(named, ["k1", "k2", "sound"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
