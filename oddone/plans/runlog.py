"""Timing log: one record per measured action, kept as a table.

``timed(...)`` is a context manager that yields a record and fills in its outcome when the block ends;
``RunLog`` collects records and appends them to a Parquet table in one write, so a run leaves few files.
"""

from __future__ import annotations

import functools
import socket
import time
from contextlib import contextmanager
from dataclasses import astuple, dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNLOG_SCHEMA = "ts timestamp_ntz, name string, ok boolean, secs double, host string, error string"


@dataclass
class Record:
    ts: datetime
    name: str
    ok: bool = True
    secs: float = 0.0
    host: str = ""
    error: str | None = None


@contextmanager
def timed(name: str):
    """Measure the block; an exception marks the record as failed and goes on."""
    record = Record(datetime.now().replace(microsecond=0), name, host=socket.gethostname())
    clock = time.perf_counter
    began = clock()
    try:
        yield record
    except BaseException as failure:  # an interrupted block has failed, too
        record.ok, record.error = False, f"{type(failure).__name__}: {failure}"
        raise
    finally:
        record.secs = clock() - began


class RunLog:
    """Records of this driver, written in batches: at every ``batch`` records, on ``flush`` and at the end of ``with``.
    ``path`` is a folder that the executors see, too."""

    def __init__(self, spark: SparkSession, path: str, batch: int = 100):
        self.spark, self.path, self.batch = spark, path, batch
        self.records: list[Record] = []

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *_) -> None:
        self.flush()

    @contextmanager
    def timed(self, name: str):
        try:
            with timed(name) as record:
                self.records.append(record)
                yield record
        finally:
            if len(self.records) >= self.batch:
                self.flush()

    def wrap(self, function, name: str | None = None):
        """``function`` with each of its calls measured."""
        @functools.wraps(function)
        def measured(*args, **kwargs):
            with self.timed(name or function.__qualname__):
                return function(*args, **kwargs)
        return measured

    def flush(self) -> None:
        if self.records:
            rows = self.spark.createDataFrame([astuple(r) for r in self.records], RUNLOG_SCHEMA)
            rows.coalesce(1).write.mode("append").parquet(self.path)
            self.records = []


#: Quantiles of a summary.
QUANTILES = (0.5, 0.95, 0.99)
#: log2 of a sketch's accuracy parameter k = 2**SKETCH_BITS: a rank is off by about 1.3 / k of the records.
SKETCH_BITS = 10


def summarize(log: DataFrame, quantiles: tuple = QUANTILES) -> DataFrame:
    """Per (name, ok): calls, total / mean / max seconds and exact percentiles ``p50``, ``p95``, … (interpolated).

    An exact percentile counts every different value of a group; for a log with very many use :func:`sketch`."""
    exact = [F.round(F.percentile("secs", F.lit(q)), 6).alias(quantile_name(q)) for q in quantiles]
    return log.groupBy("name", "ok").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("secs"), 3).alias("total_secs"),
        F.round(F.avg("secs"), 6).alias("mean_secs"), F.max("secs").alias("max_secs"), *exact)


def quantile_name(q: float) -> str:
    return f"p{round(100 * q, 4):g}".replace(".", "_")


def sketch(log: DataFrame) -> DataFrame:
    """Per (name, ok, day): calls and a quantile sketch of the seconds, of bounded size however long the day. Sketches are
    kept as a table, and those of any days merge (:func:`merge_sketches`)."""
    return log.groupBy("name", "ok", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.kll_sketch_agg_double("secs", F.lit(1 << SKETCH_BITS)).alias("sketch"))


def merge_sketches(sketches: DataFrame, quantiles: tuple = QUANTILES) -> DataFrame:
    """Per (name, ok), from the sketches of its days: calls and approximate ``p50``, ``p95``, … (each a value that occurs)."""
    whole = sketches.groupBy("name", "ok").agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch", F.lit(1 << SKETCH_BITS)).alias("sketch"))
    return whole.select("name", "ok", "calls", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(quantile_name(q)) for q in quantiles])
