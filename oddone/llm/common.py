"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from oddone.session import ensure_checkpoint_dir, ship_package

#: Rows in one Arrow batch handed to a Python worker. Texts can be long, so a batch is kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, prepared for operators that run Python on the workers."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see (``spark.checkpoint.dir``)."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def staged(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: later steps neither repeat the
    work nor depend on shuffle files of a lost executor. The folder is the cluster's scratch space."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_keys(df: DataFrame, label: str) -> DataFrame:
    """:func:`staged` for hashes and keys: they don't compress, and a codec's buffers outside the heap are saved."""
    return staged(df, label, compression="uncompressed")
