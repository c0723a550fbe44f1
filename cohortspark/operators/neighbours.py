"""Nearest neighbours of covariance matrices under the affine-invariant metric.

The distance of two symmetric positive-definite matrices is the length of the
logarithms of the eigenvalues of one seen from the other. Seen from one centre,
the logarithms of two matrices are never farther apart than the matrices are,
so plain distances of these vectors bound it from below; they are all but equal
for matrices near the centre.

1. The centre and a few cuts of the vectors come from a bounded sample.
2. Of equal matrices the ``k + 1`` rows of the smallest keys can be neighbours;
   these rows get their vectors and are written in the order of the cells
   between the cuts, so that rows that lie together are near each other.
3. Queries go to all tasks in blocks of bounded size. A task bounds its rows a
   shard at a time: queries that lie too far from a shard's box pass it by; of
   the others it takes the rows in the order of their lower bounds, a few at a
   time, as long as the bound does not exceed the query's k-th distance so far.
   No other pair is computed, and none that could matter is left out.
4. The tasks' few nearest are merged by distance.

A first pass over a bounded sample of the rows gives each query a distance
that its k-th neighbour cannot exceed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohortspark.session import materialise

NEIGHBOURS = 5
SAMPLE = 2000  # rows that the centre and the cuts are taken from
RADIUS_SAMPLE = 32_000  # rows that give the first radii
CUTS = 10  # a cell lies between this many cuts
BLOCK_BYTES = 16 << 20  # of query matrices sent to all tasks at once
SHARD, STEP = 1024, 8  # rows whose bounds are computed at once; rows a query takes at once
FOUND = "query long, distance double, neighbour long, label int, compared long"


def _whiten(mats: np.ndarray) -> np.ndarray:
    """For each matrix the inverse of its lower triangular root."""
    return np.linalg.inv(np.linalg.cholesky(mats))


def distances(white: np.ndarray, mats: np.ndarray) -> np.ndarray:
    """Affine-invariant distance of each (whitened) matrix to the matrix of the same place."""
    seen = white @ mats @ np.swapaxes(white, -1, -2)
    values = np.linalg.eigvalsh((seen + np.swapaxes(seen, -1, -2)) / 2)
    return np.sqrt((np.log(values) ** 2).sum(axis=-1))


def _stack(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size, size)


def tangents(mats: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Vectors of the logarithms of matrices seen from the centre that ``white`` whitens; not a number where there is none."""
    size = white.shape[0]
    row, col = np.triu_indices(size)
    out = np.full((len(mats), len(row)), np.nan)
    sound = np.isfinite(mats).all(axis=(1, 2))
    seen = white @ mats[sound] @ white.T
    values, vectors = np.linalg.eigh((seen + np.swapaxes(seen, -1, -2)) / 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = (vectors * np.log(values)[:, None, :]) @ np.swapaxes(vectors, -1, -2)
    out[sound] = logs[:, row, col] * np.where(row == col, 1.0, np.sqrt(2.0))
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def centre(mats: np.ndarray) -> np.ndarray:
    """What whitens the middle of some matrices: their mean, scaled by their mean logarithms."""
    white = _whiten(mats.mean(axis=0)[None])[0]
    seen = white @ mats @ white.T
    values, vectors = np.linalg.eigh((seen + np.swapaxes(seen, -1, -2)) / 2)
    logs = ((vectors * np.log(values)[:, None, :]) @ np.swapaxes(vectors, -1, -2)).mean(axis=0)
    values, vectors = np.linalg.eigh(logs)
    return (vectors * np.exp(-values / 2)) @ vectors.T @ white


def cuts(vectors: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Halvings: at each level (means, axes, places) of the cells so far, each cut in half along its widest direction."""
    cell, levels = np.zeros(len(vectors), np.int64), []
    for level in range(count):
        places, axes, means = np.zeros(1 << level), np.zeros((1 << level, vectors.shape[1])), np.zeros((1 << level, vectors.shape[1]))
        for c in range(1 << level):
            own = vectors[cell == c]
            if len(own):
                means[c] = own.mean(axis=0)
                axes[c] = np.linalg.svd(own - means[c], full_matrices=False)[2][0]
                places[c] = np.median((own - means[c]) @ axes[c])
        levels.append((means, axes, places))
        cell = _cell(vectors, levels)
    return levels


def _cell(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    cell = np.zeros(len(vectors), np.int64)
    for means, axes, places in levels:
        cell = 2 * cell + (((vectors - means[cell]) * axes[cell]).sum(axis=1) > places[cell])
    return cell


class _Nearest:
    """The k nearest (distance, neighbour, label) of each query; none farther than its ``radius``."""

    def __init__(self, k: int, radius: np.ndarray):
        self.k, self.radius = k, radius.copy()
        self.distance = np.full((len(radius), k), np.inf)
        self.neighbour, self.label = np.zeros((2, len(radius), k), np.int64)

    def add(self, query: np.ndarray, distance: np.ndarray, neighbour: np.ndarray, label: np.ndarray) -> None:
        near = distance <= self.radius[query]
        query, distance, neighbour, label = query[near], distance[near], neighbour[near], label[near]
        met = np.unique(query)
        held = np.isfinite(self.distance[met])
        query = np.concatenate([np.repeat(met, held.sum(axis=1)), query])
        distance = np.concatenate([self.distance[met][held], distance])
        neighbour = np.concatenate([self.neighbour[met][held], neighbour])
        label = np.concatenate([self.label[met][held], label])
        order = np.lexsort((neighbour, distance, query))
        query, distance, neighbour, label = query[order], distance[order], neighbour[order], label[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        at = query[kept], place[kept]
        self.distance[at], self.neighbour[at], self.label[at] = distance[kept], neighbour[kept], label[kept]
        self.radius[met] = np.minimum(self.radius[met], self.distance[met, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.isfinite(self.distance))
        return query, self.distance[query, place], self.neighbour[query, place], self.label[query, place]


ROOM = 1e-8  # for rounding, in lower bounds


def _box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to a box."""
    away = np.maximum(np.maximum(low - points, points - high), 0.0)
    return (away * away).sum(axis=1)


def _search(rows: DataFrame, shared, k: int, size: int) -> DataFrame:
    """Each task's nearest rows of each query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, points, radius = shared.value
        best, compared = _Nearest(k, radius), 0
        # as one product: lower bound, squared, less the room
        asked = np.column_stack([-2 * (1 - ROOM) * points, np.ones(len(points)), (points * points).sum(axis=1) * (1 - 2 * ROOM) - ROOM])
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                b = batch.slice(at, SHARD)
                mats, keys, labels = _stack(b.column("flat"), size), b.column("key").to_numpy(), b.column("label").to_numpy().astype(np.int64)
                own = b.column("tangent").flatten().to_numpy().reshape(b.num_rows, -1)
                sound = ~np.isnan(own[:, 0])
                mats, keys, labels, own = mats[sound], keys[sound], labels[sound], own[sound]
                if not len(own):
                    continue
                given = np.column_stack([own, (own * own).sum(axis=1) * (1 - 2 * ROOM), np.ones(len(own))]).T
                gaps = _box_gaps(points, own.min(axis=0), own.max(axis=0))
                near = np.flatnonzero(gaps * (1 - ROOM) - ROOM <= best.radius**2)
                for first in range(0, len(near), 256):
                    some = near[first : first + 256]
                    low = asked[some] @ given
                    open_ = np.flatnonzero(low.min(axis=1) <= best.radius[some] ** 2)
                    while len(open_):
                        take = min(STEP, len(own))
                        x = np.argpartition(low[open_], take - 1, axis=1)[:, :take]
                        bound = np.take_along_axis(low[open_], x, axis=1)
                        which, place = np.nonzero(bound <= best.radius[some[open_], None] ** 2)
                        asks, rows_ = open_[which], x[which, place]
                        compared += len(rows_)
                        best.add(some[asks], distances(white[some[asks]], mats[rows_]), keys[rows_], labels[rows_])
                        low[open_[:, None], x] = np.inf  # taken
                        open_ = open_[low[open_].min(axis=1) <= np.minimum(best.radius[some[open_]] ** 2, np.finfo(float).max)]
        query, distance, neighbour, label = best.rows()
        counts = np.zeros(len(query), np.int64)
        if len(counts):
            counts[0] = compared
        cols = [pa.array(query), pa.array(distance), pa.array(neighbour), pa.array(label.astype(np.int32)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "distance", "neighbour", "label", "compared"])

    return rows.mapInArrow(run, FOUND)


def nearest_neighbours(
    train: DataFrame, queries: DataFrame, matrix: str, key: str, label: str, size: int, k: int = NEIGHBOURS,
    block_bytes: int = BLOCK_BYTES, report: dict | None = None,
) -> DataFrame:
    """Per query its ``k`` nearest rows of ``train``: (key, rank from 1, neighbour, distance, label of the neighbour).

    ``matrix`` is an ``array<array<double>>`` of ``size`` rows, ``key`` a long,
    ``label`` a boolean. Equal distances are ordered by the neighbour's key. A
    row never has itself (its key) as neighbour. Rows without a whole matrix
    (a null entry) take no part. ``report`` receives the number of pairs whose
    distance was computed and that of all pairs.
    """
    spark = train.sparkSession
    whole = lambda df: df.where(F.coalesce(~F.exists(F.flatten(matrix), lambda x: x.isNull()), F.lit(False)))
    flat = lambda df: whole(df).select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), F.flatten(matrix).alias("flat"))
    base = materialise(flat(train), "neighbour-rows")
    total = base.count()
    share = lambda most: F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(np.ceil(1e6 * min(1.0, most / max(1, total))))
    sample = base.where(share(SAMPLE)).select("flat").toPandas()["flat"].tolist() or [r[0] for r in base.select("flat").take(1)]
    if not sample:
        return spark.createDataFrame([], f"{key} long, rank int, neighbour long, distance double, neighbour_label int")
    mats = np.array(sample).reshape(-1, size, size)
    sound = mats[~np.isnan(tangents(mats, np.eye(size))[:, 0])]
    middle = centre(sound if len(sound) else np.eye(size)[None])
    halves = cuts(tangents(sound, middle), max(0, min(CUTS, int(np.log2(max(1, len(sound) / 2))))))

    @F.pandas_udf("struct<tangent: array<double>, cell: long>")
    def placed(flat: pd.Series) -> pd.DataFrame:
        seen = tangents(np.array(flat.tolist()).reshape(-1, size, size), middle)
        return pd.DataFrame({"tangent": list(seen), "cell": _cell(seen, halves)})

    # of equal matrices, the rows that can be among the k + 1 nearest
    first_keys = Window.partitionBy("flat").orderBy("key")
    apart = base.withColumn("_copy", F.row_number().over(first_keys)).where(F.col("_copy") <= k + 1).drop("_copy")
    apart = apart.withColumn("_p", placed("flat")).select(*base.columns, "_p.tangent", "_p.cell")
    rows = materialise(apart.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key"), "neighbour-places")
    asked = materialise(flat(queries), "neighbour-queries")
    many = asked.count()
    blocks = max(1, -(-many * size * size * 8 // block_bytes))
    done, seen = None, 0
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)) == block).select("key", "flat").toPandas()  # about block_bytes
        if not len(held):
            continue
        mats, keys = np.array(held["flat"].tolist()).reshape(-1, size, size), held["key"].to_numpy(np.int64)
        white, points, radius = _whiten(mats), tangents(mats, middle), np.full(len(held), np.inf)
        names = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(held)), key: keys}), f"query long, {key} long")

        def search(part: DataFrame) -> DataFrame:
            # one more than asked for, as a query may meet itself
            found = _search(part, spark.sparkContext.broadcast((white, points, radius)), k + 1, size)
            return found

        first = search(rows.where(share(RADIUS_SAMPLE)))
        place = Window.partitionBy("query").orderBy("distance", "neighbour")
        ends = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k + 1).select("query", "distance").toPandas()
        radius[ends["query"].to_numpy(np.int64)] = ends["distance"].to_numpy()
        found = search(rows)
        if report is not None:
            counted = Observation()
            found = found.observe(counted, F.sum("compared").alias("compared"))
        best = found.join(F.broadcast(names), "query").where(F.col("neighbour") != F.col(key))
        best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        best = materialise(best.select(key, "rank", "neighbour", "distance", F.col("label").alias("neighbour_label")), "neighbours")
        seen += (counted.get["compared"] or 0) if report is not None else 0
        done = best if done is None else done.union(best)
    if report is not None:
        report.update(compared=seen, pairs=many * total)
    return done if done is not None else spark.createDataFrame([], f"{key} long, rank int, neighbour long, distance double, neighbour_label int")


def neighbour_vote(neighbours: DataFrame, key: str) -> DataFrame:
    """The most frequent label among the neighbours (of equal ones the smaller) and the share of label 1."""
    votes = neighbours.groupBy(key).agg(F.avg("neighbour_label").alias("p1"))
    return votes.select(key, (F.col("p1") > 0.5).cast("double").alias("prediction"), "p1")
