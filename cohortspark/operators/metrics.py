"""Evaluation metrics: accuracy, ROC-AUC, ROC points.

Scores are first grouped by distinct value (positives and negatives per
score), which makes ties exact and shrinks the data; cumulative counts
over the score order use the distributed prefix sums of ``ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ordering import prefix_sums


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def accuracy(df: DataFrame, pred: str | Column, label: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """M8: share of rows where the prediction equals the label, of each group of ``by``."""
    return df.groupBy(*by).agg(F.avg((_col(pred) == _col(label)).cast("double")).alias("accuracy"))


def score_counts(
    df: DataFrame, score: str | Column, label: str | Column, pred: str | Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Positives, negatives (and correct predictions) per group and distinct score (partial aggregation, any skew)."""
    y = _col(label).cast("boolean")
    aggs = [F.sum(y.cast("long")).alias("pos"), F.sum((~y).cast("long")).alias("neg")]
    if pred is not None:
        aggs.append(F.sum((_col(pred).cast("boolean") == y).cast("long")).alias("correct"))
    return df.groupBy(*by, _col(score).cast("double").alias("score")).agg(*aggs)


def _auc_expr() -> Column:
    num = F.sum(F.col("pos") * (F.col("neg_before") + F.lit(0.5) * F.col("neg")))
    den = F.sum("pos") * F.sum("neg")
    return F.when(den > 0, num / den)


def roc_auc(df: DataFrame, score: str | Column, label: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """M9 (W5): exact ROC-AUC with average ranks for ties, of each group of ``by``.

    AUC = Σ_s pos(s)·(neg below s + ½·neg at s) / (P·N); null when a class is absent.
    """
    g = prefix_sums(score_counts(df, score, label, by=by), ["score"], ["neg"], by)
    return g.groupBy(*by).agg(_auc_expr().alias("auc"))


def accuracy_auc(
    df: DataFrame, pred: str | Column, score: str | Column, label: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    """M6 metrics on a scored set: n, accuracy and ROC-AUC in one row a group, from one pass over ``df``.

    The groups (say, the models of a table of predictions) share one range
    exchange of their distinct scores.
    """
    g = prefix_sums(score_counts(df, score, label, pred, by), ["score"], ["neg"], by)
    n = F.sum(F.col("pos") + F.col("neg"))
    return g.groupBy(*by).agg(
        n.alias("n"),
        (F.sum("correct") / n).alias("accuracy"),
        _auc_expr().alias("auc"),
    )


def roc_points(df: DataFrame, score: str | Column, label: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """M7 (W4): one ROC point per group and distinct score: predicting positive at ``score >= threshold``.

    Columns: the group's, threshold, fpr, tpr. (Collinear points are kept.)
    """
    g = prefix_sums(score_counts(df, score, label, by=by), ["score"], ["pos", "neg"], by, totals=True)
    return g.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"),
    )
