"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import ensure_checkpoint_dir, made_table


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortspark-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    made_table(path)
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, mod: int) -> Column:
    """Unsigned crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def utf8(col: Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches (or arrays) in slices, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, len(b) if isinstance(b, pa.Array) else b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
