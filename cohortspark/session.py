"""Session helpers.

Library functions take the caller's ``SparkSession`` and never change its
configuration. ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortspark") -> SparkSession:
    """A local session configured like the cluster jobs expect (UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="cohortspark-wh-", dir=os.environ.get("TMPDIR", "/tmp")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared folder set by the operator; it is read from
    the session and never replaced, and a cluster session without one is an
    error (a machine-local folder would not survive a lost executor). Only a
    local-mode session without the setting (tests, bench) gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: set it to a shared folder (for example on the cluster's "
            "distributed file system) before running iterative steps"
        )
    path = tempfile.mkdtemp(prefix="cohortspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


_open: list[list[tuple[str, str | None]]] = []  # what the open ``intermediate_tables`` blocks have seen, the innermost last


def made_table(path: str, name: str | None = None) -> None:
    """Note an intermediate table (its folder, and its name in the catalog if it has one) for removal."""
    if _open:
        _open[-1].append((path, name))


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that the library wrote in it on its way to results.

    Results that still read them must have been written or collected by then.
    Outside such a block the tables stay in the checkpoint folder, which is the
    caller's to empty, because lazy results may read them at any later time.
    """
    _open.append([])
    try:
        yield
    finally:
        for path, name in _open.pop():
            if name is not None:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a reliable checkpoint, but runs the plan a single time
    (an eager RDD checkpoint computes it twice unless cached) and keeps a
    columnar copy later stages can prune. Used before iterative steps and
    before plans that read one result several times.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/cohortspark-tables/{name}-{uuid.uuid4().hex}"
    made_table(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
