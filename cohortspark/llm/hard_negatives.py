"""Hard negatives by lists that clustered anchors share.

Anchors of one label are clustered by direction. For a cluster the candidates
are sorted once by an upper bound that holds for every member: with ``c`` the
cluster's direction and ``w`` the widest angle of a member to it, a candidate
``x`` scores at most ``|a| |x| cos(max(0, angle(x, c) - w))`` with member
``a``. Every member walks that list and stops where the bound, and so all that
follows, cannot enter its result any more. So nothing is missed.

Anchors are taken in blocks of bounded size, which go to all tasks; each task
sorts and walks the lists of its own part of the candidates, and starts from
what a bounded sample of candidates has found. The tasks' few best are merged
by score. A block takes two passes over all candidates, one for its positives
and one for its negatives, each after one over the sample.

Scores are inner products of whole numbers and exact: in double precision
where no sum can reach 2**53, else in 64-bit integers.

Edge cases: a row with a null label or vector, or a null or non-finite
component, takes no part, nor does one with components so large that a score
could leave 64 bits; empty vectors score 0; vectors of different lengths are
not compared; rows that repeat a ``vec_id`` are rows of their own; equal scores
are ordered by ``vec_id``, then by row; rows without ``vec_id`` come last among
equals and are no anchors unless ``anchors`` says so; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import shared_path, written

POSITIVES, NEGATIVES, LEAST_PERCENT, SCALE = 5, 5, 80, 256
BLOCK_BYTES = 32 << 20  # of anchors sent to all tasks at once
MEMBERS = 64  # anchors of a cluster, about
SHARD = 8192  # candidates sorted into lists at once
STEP = 256  # candidates a cluster's members walk at once
SAMPLE = 8192  # candidates that give the first least scores
ROUNDS, SEED = 6, 13
NONE = np.iinfo(np.int64).min
PAIRS = "query long, anchor_id long, positive_id long, positive_score long"


def items_of(vectors: DataFrame, anchors: Column, scale: int = SCALE) -> DataFrame:
    """Written: row, vec_id, label, v (scaled, whole numbers), is_anchor of the rows that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda y: F.floor(y.cast("double") * scale))
    limit = F.sqrt(F.lit(float(2**62)) / F.greatest(F.size(x), F.lit(1))) / scale
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y.cast("double")) > limit))
    sound = F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))
    rows = vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    return written(rows, "candidates")


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**52 else a @ b.T


class Cluster:
    """Anchors of one label: direction and widest angle."""

    def __init__(self, members: np.ndarray, vectors: np.ndarray, label: str):
        self.members, self.label = members, label
        units = _unit(vectors)
        mean = units.sum(axis=0)
        size = np.linalg.norm(mean)
        self.centre = mean / size if size > 0 else mean
        self.widest = float(np.arccos(np.clip(units @ self.centre, -1, 1)).max(initial=0)) if size > 0 else np.pi

    def bounds(self, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each candidate, the most it can score with a member of length one."""
        angle = np.arccos(np.clip(units @ self.centre, -1, 1))
        return sizes * (np.cos(np.maximum(0, angle - self.widest)) + 1e-6)  # room for rounding


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def clusters(vectors: np.ndarray, labels: np.ndarray) -> list[Cluster]:
    """A block's anchors, label by label, in clusters of about ``MEMBERS``: spherical k-means."""
    out, rng = [], np.random.default_rng(SEED)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        units = _unit(vectors[at])
        count = -(-len(at) // MEMBERS)
        centres = units[rng.choice(len(at), count, replace=False)]
        for _ in range(ROUNDS if count > 1 else 0):
            near = (units @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, units)
            centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
        near = (units @ centres.T).argmax(axis=1)
        out += [Cluster(at[near == k], vectors[at[near == k]], label) for k in np.unique(near)]
    return out


class Best:
    """The best few (score, vec_id, row) of each query; a query takes scores from ``least`` to ``most``."""

    def __init__(self, keep: int, least: np.ndarray, most: np.ndarray):
        self.keep, self.least, self.most = keep, least.copy(), most
        self.query = self.score = self.vec_id = self.row = np.zeros(0, np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` [query, candidate]; NONE where a candidate is not for a query."""
        q, c = np.nonzero((scores >= self.least[queries, None]) & (scores <= self.most[queries, None]) & (scores != NONE))
        if not len(q):
            return
        query = np.concatenate([self.query, queries[q]])
        score, vec_id, row = (np.concatenate(x) for x in ((self.score, scores[q, c]), (self.vec_id, ids[c]), (self.row, rows[c])))
        order = np.lexsort((row, vec_id, -score, query))
        query, score, vec_id, row = query[order], score[order], vec_id[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.keep
        full = place == self.keep - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])  # equal scores may still come first
        self.query, self.score, self.vec_id, self.row = query[kept], score[kept], vec_id[kept], row[kept]


class Walk:
    """What the tasks of a pass share: a block's anchors, their clusters, and the queries of each anchor."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, parts: list[Cluster], same: bool, keep: int):
        self.vectors, self.rows, self.parts, self.same, self.keep = vectors, rows, parts, same, keep
        self.step = STEP
        self.lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
        # by default one query an anchor, for all scores
        self.of, self.least, self.most = np.arange(len(rows)), np.full(len(rows), NONE + 1), np.full(len(rows), np.iinfo(np.int64).max)

    def shard(self, best: Best, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        units, sizes = _unit(vectors), np.linalg.norm(vectors.astype(np.float64), axis=1)
        first = np.searchsorted(self.of, np.arange(len(self.rows) + 1))  # an anchor's queries follow one another
        for part in self.parts:
            here = np.flatnonzero((labels == part.label) == self.same)
            bound = part.bounds(units[here], sizes[here])
            order = np.argsort(-bound, kind="stable")
            here, bound = here[order], bound[order]
            queries = np.concatenate([np.arange(first[m], first[m + 1]) for m in part.members] or [np.zeros(0, np.int64)])
            for at in range(0, len(here), self.step):
                reach = self.lengths[self.of[queries]] * bound[at] + 1  # all that follows scores no more
                queries = queries[(reach >= best.least[queries]) & (best.least[queries] <= self.most[queries])]
                if not len(queries):
                    break
                some = here[at : at + self.step]
                members, which = np.unique(self.of[queries], return_inverse=True)
                scores = _scores(self.vectors[members], vectors[some])
                scores = np.where(self.rows[members][:, None] == rows[some][None, :], NONE, scores)[which]
                best.add(queries, scores, ids[some], rows[some])


FOUND = "query long, score long, vec_id long, row long"
LAST = np.iinfo(np.int64).max  # where a row without vec_id stands among equals


def _walked(candidates: DataFrame, walk: Walk) -> DataFrame:
    """The best few of each query in each task's part of the candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast(walk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        best = Best(w.keep, w.least, w.most)
        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                some = b.slice(at, SHARD)
                ids = some.column("vec_id").fill_null(LAST).to_numpy()
                labels = np.array(some.column("label").to_pylist(), object)
                w.shard(best, some.column("row").to_numpy(), ids, labels, _matrix(some.column("v"), w.vectors.shape[1]))
        cols = [pa.array(c) for c in (best.query, best.score, best.vec_id, best.row)]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "score", "vec_id", "row"])

    return candidates.select("row", "vec_id", "label", "v").mapInArrow(run, FOUND)


def _matrix(column, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def _merged(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
    scale: int = SCALE, block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE,
) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: which rows are anchors. A positive's negatives score from ``least_percent`` of its score to its score.
    """
    spark = vectors.sparkSession
    items = items_of(vectors, anchors, scale)
    out = []
    sizes = items.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors")).where("anchors > 0").collect()
    for d, total, many in sorted(tuple(r) for r in sizes):
        of_length = items.where(F.size("v") == d)
        blocks = -(-many * max(1, d) * 8 // block_bytes)
        share = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1_000_000)) < int(np.ceil(1e6 * min(1.0, sample / total)))
        for block in range(blocks):
            mine_ = of_length.where(F.col("is_anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block))
            held = mine_.select("row", F.coalesce("vec_id", F.lit(int(LAST))).alias("vec_id"), "label", "v").toPandas().sort_values("row", ignore_index=True)  # about block_bytes
            if not len(held):
                continue
            matrix = np.array(held["v"].tolist(), np.int64).reshape(len(held), d)
            rows, names = held["row"].to_numpy(np.int64), held["label"].to_numpy(object)
            parts = clusters(matrix, names)
            out.append(_block(of_length, share, held, Walk(matrix, rows, parts, True, positives), positives, negatives, least_percent))
    if not out:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*out)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _block(candidates: DataFrame, share: Column, held: pd.DataFrame, walk: Walk, positives: int, negatives: int, least_percent: int) -> str:
    """The rows of one block's anchors, written; their path."""
    spark = candidates.sparkSession
    # a few of the candidates give scores that the rest must reach
    some = _merged(_walked(candidates.where(share), walk), positives).where(F.col("rank") == positives).select("query", "score").toPandas()
    walk.least[some["query"].to_numpy(np.int64)] = some["score"].to_numpy(np.int64)
    found = _merged(_walked(candidates, walk), positives).select("query", "score", "vec_id", "row").toPandas()  # a few for each anchor of the block
    found = found.sort_values(["query", "score", "vec_id", "row"], ascending=[True, False, True, True], ignore_index=True)
    far = Walk(walk.vectors, walk.rows, walk.parts, False, negatives)
    far.of = found["query"].to_numpy(np.int64)
    far.most = found["score"].to_numpy(np.int64)
    # 100 * score >= least_percent * positive's score, in whole numbers
    far.least = -(-least_percent * far.most // 100)
    pairs = pd.DataFrame({"query": np.arange(len(found)), "anchor_id": held["vec_id"].to_numpy()[far.of], "positive_id": found["vec_id"].to_numpy(), "positive_score": far.most})
    some = _merged(_walked(candidates.where(share), far), negatives).where(F.col("rank") == negatives).select("query", "score").toPandas()
    far.least[some["query"].to_numpy(np.int64)] = some["score"].to_numpy(np.int64)
    best = _merged(_walked(candidates, far), negatives)
    named = spark.createDataFrame(pairs if len(pairs) else [], PAIRS)
    id_of = lambda c: F.nullif(F.col(c), F.lit(int(LAST))).alias(c)
    rows = best.select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "query")
    path = shared_path(spark, "hard-negatives")
    rows.select(id_of("anchor_id"), id_of("positive_id"), "rank", id_of("negative_id"), "positive_score", "negative_score").write.parquet(path)
    return path
