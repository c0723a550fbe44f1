"""Sources, sinks and table management.

Tables are parquet folders or catalog tables. Writes go to folders the
caller names (on a cluster: shared storage); nothing is collected to the
driver except row counts and existence checks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_sql(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run an SQL text and return a lazy DataFrame.

    Values are bound as named parameters (``:name``), never pasted into the
    text; DataFrames can be referenced as ``{name}``.
    """
    if frames:
        return spark.sql(text, args=args, **frames)
    return spark.sql(text, args=args)


def scan(spark: SparkSession, name_or_path: str, schema: T.StructType | None = None) -> DataFrame:
    """A catalog table by name, or a parquet folder by path."""
    if "/" not in name_or_path and spark.catalog.tableExists(name_or_path):
        return spark.table(name_or_path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(name_or_path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """S4 (``overwrite``) / S5 (``errorifexists``) / S8 (``ignore``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_table_as(df: DataFrame, name: str, mode: str = "errorifexists") -> None:
    """Create a catalog table from a query result."""
    df.write.mode(mode).saveAsTable(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog lookup, no scan."""
    return spark.catalog.tableExists(name)


def create_if_absent(spark: SparkSession, name: str, df: DataFrame) -> bool:
    """Create the table only when it is missing; returns True if created."""
    if table_exists(spark, name):
        return False
    create_table_as(df, name)
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop, ignoring a missing table; other errors propagate."""
    spark.sql(f"DROP TABLE IF EXISTS {_quote(name)}")


def _quote(name: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in name.split("."))


def save_cohort(cohort: DataFrame, path: str, vois: Sequence[str], mode: str = "overwrite", with_age: bool = False) -> None:
    """Persist the selected cohort (stay, entry date, VOI counts, death, bounds); the earlier variant has the age too."""
    cols = ["id_nda", "j1", *vois, *(["age"] if with_age else []), "dt_deces", "dt_min", "dt_max", "stay_len"]
    write_parquet(cohort.select(*cols), path, mode=mode)


def save_dataset(dataset: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the packed dataset (series array<array<double>> + target)."""
    write_parquet(dataset, path, mode=mode)


def save_blocks(dataset: DataFrame, path: str, block: str = "block") -> None:
    """Write a dataset as one folder per block; only the blocks that ``dataset`` has are replaced.

    Rows are dealt to tasks by block and by their own hash, so that a block is
    written by several tasks and a lost one is rebuilt by writing it alone.
    """
    spread = dataset.repartition(F.col(block), F.pmod(F.xxhash64(*[c for c in dataset.columns if c != block]), F.lit(BLOCK_FILES)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)


BLOCK_FILES = 4  # files a block is written in, at most


def missing_blocks(spark: SparkSession, path: str, nb_splits: int, block: str = "block") -> list[int]:
    """Block numbers of ``0..nb_splits-1`` that have no folder yet (partition values only, no data is read)."""
    try:
        there = {int(r[0]) for r in spark.read.parquet(path).select(block).distinct().collect()}  # nb_splits rows at most
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        there = set()
    return sorted(set(range(nb_splits)) - there)


def build_blocks(spark: SparkSession, path: str, nb_splits: int, build: Callable[[list[int]], DataFrame], block: str = "block") -> list[int]:
    """Build and write the blocks that are missing; returns their numbers. A second call finds nothing to do.

    ``build`` makes the rows of the given blocks, all in one plan. A block
    without any row leaves no folder and is asked for again, which costs a
    plan that finds nothing.
    """
    missing = missing_blocks(spark, path, nb_splits, block)
    if missing:
        save_blocks(build(missing), path, block)
    return missing


def case_view(cases: DataFrame, name: str) -> None:
    """Hand a set of case ids to SQL users as a temp view."""
    cases.createOrReplaceTempView(name)


def distributed_count(spark: SparkSession, values: Sequence[Any]) -> int:
    """Local collection → distributed data, then count."""
    return spark.createDataFrame([(v,) for v in values], "value string").count()


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 10, last: bool = False) -> DataFrame:
    """First (or last) ``n`` rows by a key, as a top-k (no full sort)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if last:
        cols = [c.desc() for c in cols]
    return df.orderBy(*cols).limit(n)
