"""Session and storage helpers of the operators in this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Used only where the session names no checkpoint directory, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches so that a few thousand long texts never meet in one."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: the files outlive the executors that wrote them, and nothing upstream
    runs again when a later stage is retried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stemma/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the files replace this query's shuffles, so their disk is free again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True for the fifth of the documents whose labels no model may see."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def whole_rows(sample: DataFrame, kind: str, order: list[str], size: str, most: int) -> DataFrame:
    """Of each ``kind`` the first rows by ``order`` whose ``size`` adds up to at most ``most``; a row that is larger by itself is passed over.

    ``sample`` is a bounded sample, so the running sum of a kind fits one task.
    """
    w = Window.partitionBy(kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [kind, *order]
    kept = sample.where(F.col(size) <= most).select(*keys, F.sum(size).over(w).alias("_sum")).where(F.col("_sum") <= most).drop("_sum")
    return sample.join(kept, keys, "left_semi").select(sample.columns)  # a join by names puts those first
