"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates follow each feature's own gradients, and the L1 term
keeps most weights at zero, so the broadcast holds few pairs. Edge cases are
those of ``quality``: null or empty texts get the constant feature's score,
every row is scored, other columns play no part, and without labelled rows
every score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import ftrl
from cohortspark.llm.common import remainder

SETTINGS = ftrl.Settings(bits=20, ngrams=2, skips=2, alpha=0.5, l1=8.0, l2=0.1)
HELD_OUT, TOXIC_FROM = (5, 0), 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS):
    """Weights learnt from labelled rows outside the held-out fifth."""
    return ftrl.train(docs, labels, "toxic", ~held_out(F.col("doc_id")), settings)


def toxicity_scores(docs: DataFrame, weights, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5)."""
    score = ftrl.scorer(docs.sparkSession, weights, settings)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def drop_toxic(docs: DataFrame, weights, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs``, all their columns, that stay below the threshold."""
    score = ftrl.scorer(docs.sparkSession, weights, settings)
    return docs.where(score(docs["text"]) < TOXIC_FROM)
