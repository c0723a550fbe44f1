"""Connected components of a graph given as edges, in rounds of Spark jobs.

Each round first shrinks the edges inside every task (union-find over the
task's own edges, one edge per node left), then every node is pointed at the
smallest label among its neighbours and itself, alternating between all
neighbours and smaller ones (large-star and small-star steps). Labels are
smallest node numbers. Every round is written to the shared folder, so a lost
executor never sends the work back to the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import written

MOST_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the given edges, without the roots themselves."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


EDGES_A_STEP = 2_000_000


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task to a forest over the same components, in bounded steps."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > EDGES_A_STEP:
            a, b = forest(a, b)
            if len(a) > EDGES_A_STEP // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, component): each node that has an edge, and its smallest reachable node."""
    shrink = lambda df: df.mapInArrow(_shrink, "a long, b long")
    now = written(shrink(edges.where("a != b")), "edges")  # a > b: each node points to a smaller one
    for _ in range(MOST_ROUNDS):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = now.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        own = low.where("m < a").select("a", F.col("m").alias("b"))
        nxt = written(shrink(large.union(own).where("a != b").distinct()), "edges")
        # settled when every node points to one root and no root points on
        state = nxt.select(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("nodes")).head()
        on = nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        now = nxt
        if state["n"] == state["nodes"] and not on:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
