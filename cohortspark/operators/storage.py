"""Readings stored once as tables bucketed by case, so that later joins move no readings.

A staged reading belongs to a case (stay, entry date). The stored table is
hashed on (stay, entry date) into a fixed number of buckets, sorted within
them; a join or semi-join on these columns reads the buckets as they are and
only the cases, a row or few each, are shuffled to them.

If there are hot stays, of more than ``SLOT_ROWS`` raw readings, a third bucket
column, the slot, splits them: a hot stay deals its readings by their own hash
over as many slots as it has ``SLOT_ROWS``, and its cases are repeated once a
slot; all others have the slot 0. The hot stays are broadcast: they are at most
the number of readings over ``SLOT_ROWS`` (2 million rows for 10**13 readings).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import ensure_checkpoint_dir, made_table, materialise

SLOT_ROWS = 5_000_000
SLOT = "slot"


def hot_stays(readings: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame | None:
    """(id_nda text, slots) of the stays with more readings than a slot holds; None if there are none."""
    counts = readings.groupBy(F.col("id_nda").cast("string").alias("id_nda")).agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= slot_rows:
        return None
    hot = counts.where(F.col("n") > slot_rows).select("id_nda", F.ceil(F.col("n") / slot_rows).cast("int").alias("slots"))
    return materialise(hot, "hot-stays")


def slotted(readings: DataFrame, hot: DataFrame | None, dealt_by: Sequence[str | Column]) -> DataFrame:
    """Add the slot of each reading, if there are hot stays: by the hash of ``dealt_by`` within one, else 0."""
    if hot is None:
        return readings
    joined = readings.join(F.broadcast(hot), "id_nda", "left")
    return joined.withColumn(SLOT, F.coalesce(F.pmod(F.xxhash64(*dealt_by), F.col("slots")).cast("int"), F.lit(0))).drop("slots")


def over_slots(cases: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Each case once for every slot its readings may be in."""
    if hot is None:
        return cases
    joined = cases.join(F.broadcast(hot), "id_nda", "left")
    return joined.withColumn(SLOT, F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as a catalog table bucketed and sorted by ``keys``; returns the table.

    The rows are dealt to the buckets once, so that each bucket is one file.
    ``dealt``: they lie so already, as rows of another such table do.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    root = ensure_checkpoint_dir(spark).rstrip("/")
    full = f"cohortspark_{name}_{uuid.uuid4().hex}"
    path = f"{root}/cohortspark-tables/{full}"
    made_table(path, full)
    writer = (df if dealt else df.repartition(buckets, *keys)).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(full)
    return spark.table(full)
