"""Order-dependent helpers that avoid single-task windows.

A window with an ``orderBy`` and no ``partitionBy`` (a running total over
all rows, a global rank) runs in one task. These helpers give the same
results with range partitioning: each range partition computes its local
running values, partition totals (one row per partition) give offsets, and
the offsets table, bounded by the partition count, is broadcast back.

Totals and rows must see the same range boundaries, which Spark samples anew
for every range exchange. So the rows are tagged with their range partition
once and written to the shared folder; both are derived from that one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import materialise

BROADCAST_OFFSETS = 1_000_000  # rows (partitions x groups) up to which the offsets are broadcast


def prefix_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str],
    group: Sequence[str] = (),
    num_partitions: int | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add ``<v>_before``: sum of ``v`` over earlier rows (same ``group``) in ``order``; with ``totals`` also ``<v>_total`` of the group.

    ``order`` must be unique within a group (ties would make "earlier"
    ambiguous); null groups count as a group. Without ``num_partitions`` the
    number of ranges follows the data's size (adaptive coalescing).
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = materialise(ranged.withColumn("_pid", F.spark_partition_id()), "ranges")
    sums = tagged.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sums.select(
        F.col("_pid").alias("_p"),
        *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(whole).alias(f"_w_{v}") for v in values],
    )
    offsets = materialise(offsets, "range-offsets")
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same = F.col("_pid") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    local = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tagged.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(local), F.lit(0))).alias(f"{v}_before") for v in values],
        *[F.col(f"_w_{v}").alias(f"{v}_total") for v in values if totals],
    )


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    num_partitions: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add ``pos``: 0-based position of each row within its ``group`` in ``order``, and the group's size under the name ``size``.

    Equivalent to ``row_number() - 1`` over ``partitionBy(group).orderBy(order)``
    but without putting a whole group in one task. ``order`` should be unique
    within a group for a deterministic result.
    """
    one = df.withColumn("_one", F.lit(1).cast("long"))
    res = prefix_sums(one, order, ["_one"], group, num_partitions, totals=size is not None)
    return res.withColumnsRenamed({"_one_before": "pos", "_one_total": size or "_one_total"}).drop("_one")
