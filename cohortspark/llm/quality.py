"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Edge cases: a null or empty text has no words and gets the score of the
constant feature; a document may appear any number of times, each row is
scored; other columns of the input play no part. Without labelled rows every
score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import ftrl
from cohortspark.llm.common import remainder

SETTINGS = ftrl.Settings(bits=18, ngrams=2, counts=True, alpha=1.0, l1=0.1, l2=0.1)
HELD_OUT, KEEP_FROM = (4, 2), 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS):
    """Weights learnt from labelled rows outside the held-out quarter."""
    return ftrl.train(docs, labels, "quality", ~held_out(F.col("doc_id")), settings)


def quality_scores(docs: DataFrame, weights, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.7)."""
    score = ftrl.scorer(docs.sparkSession, weights, settings)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, weights, settings: ftrl.Settings = SETTINGS) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score reaches the threshold."""
    score = ftrl.scorer(docs.sparkSession, weights, settings)
    return docs.where(score(docs["text"]) >= KEEP_FROM)
