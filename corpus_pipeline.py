"""A corpus run: score, filter, deduplicate, decontaminate and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's
documents. All stages but the last return the columns of documents.

Classifiers learn from the labelled rows of the original documents, whatever
earlier stages removed.

Every stage takes any table with the columns doc_id and text: nulls may stand
in any column, other columns pass through under whatever name they have (the
operators' own helper names included), texts are read whole however long they
are, and an empty table gives an empty one. Rows are judged by their own text,
so rows that repeat are judged alike; what that means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import decontaminate, packing, quality, simhash, toxicity
from cohortspark.llm.common import shared_path, table
from cohortspark.session import intermediate_tables


CACHED_UNITS = 150_000  # fewer than in a job of its own: the workers have run the earlier stages


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has the score of the constant feature alone, so all
    such rows stay or go together. A score equal to the limit stays. Each of
    several equal rows stays or goes like the others.
    """
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    As in the quality stage; here a score equal to the limit goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, that with the smallest doc_id.

    Null, empty and blank texts are copies of each other. Rows without an id
    come after those with one; of rows that share the smallest id the one with
    the smaller hash of id and text stays, and of wholly equal rows one. Rows
    that share an id but are unlike belong to different groups: each may stay.
    """
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go.

    A null, empty or blank text has no words and stays. Rows that repeat, with
    or without an id, go together or stay together. An empty benchmark, or one
    of items without words, removes nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences.

    A null or empty text is a piece of the end id alone. Rows that repeat are
    packed each. Pieces of equal length are interchangeable: which of them goes
    to which sequence follows the order in which tasks cut them.
    """
    packed = packing.pack(docs, cached_units=CACHED_UNITS)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt scores and hashed fingerprints have no SQL form; the tests run each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediate_tables(spark):  # what a stage writes on its way goes when its result is written
            path = shared_path(spark, f"pipeline-{name}")
            done = stage(spark, docs, sf_dir)
            done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
