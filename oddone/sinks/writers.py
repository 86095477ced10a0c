"""Sinks of the reference's outputs (K1-K5), as partitioned tables.

* stimuli export (K1): refuses an empty stimulus set
* answers (K2): ``partitionBy(version, model, stimulus)`` instead of one CSV per path; a rerun replaces its partitions
* learned embedding (K3): ``item, id, dim_0..`` (wide form only at export)
* reference vectors (K4): ``item, embedding`` with the vector as space-joined text
* run log (K5): see :mod:`oddone.plans.runlog`
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.functions.vectors import to_text
from oddone.operators.sampling import STIMULI_COLS

STIMULI_EXPORT_COLS = [c for c in STIMULI_COLS if c != "attempt_id"] + ["shuffled_item_y", "shuffled_item_z", "format_str"]


def write_stimuli(stimuli: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    if stimuli.isEmpty():
        raise ValueError("no stimuli to write")
    cols = [c for c in STIMULI_EXPORT_COLS if c in stimuli.columns]
    w = stimuli.select(*cols).write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


ANSWER_KEYS = ("version", "model", "stimulus")


def _partitioned(df: DataFrame, keys: tuple, path: str, fmt: str) -> None:
    """Write a table by ``keys``, replacing exactly the partitions that ``df`` has rows of: what a run writes twice is there once."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_answers(answers: DataFrame, path: str, version: str | None = None, model: str | None = None, stimulus: str | None = None,
                  fmt: str = "parquet") -> None:
    """Answers by (version, model, stimulus), each given or a column of ``answers``; a rerun replaces its own partitions."""
    given = {k: F.lit(v) for k, v in zip(ANSWER_KEYS, (version, model, stimulus)) if v is not None}
    _partitioned(answers.withColumns(given) if given else answers, ANSWER_KEYS, path, fmt)


def wide_embedding(long_form: DataFrame, d: int, vec_col: str = "vec", keys=("item", "id")) -> DataFrame:
    """``(item, id, vec)`` -> ``item, id, dim_0..dim_{d-1}``."""
    return long_form.select(*keys, *[F.get(F.col(vec_col), i).alias(f"dim_{i}") for i in range(d)])


def write_embedding(wide: DataFrame, path: str, fmt: str = "csv", partition_cols: tuple = ()) -> None:
    """Learned embeddings, sorted by id; with ``partition_cols`` (version, model, run, …) a rerun replaces its own partitions."""
    wide = wide.sortWithinPartitions(*partition_cols, "id")
    if partition_cols:
        return _partitioned(wide, partition_cols, path, fmt)
    w = wide.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def reference_export(vectors: DataFrame, key_col: str = "key") -> DataFrame:
    """First vector per item as ``item, embedding`` (space-joined text)."""
    return vectors.select(F.col(key_col).alias("item"), to_text("vec").alias("embedding"))


def write_reference(vectors: DataFrame | None, path: str, key_col: str = "key") -> None:
    if vectors is None:
        raise ValueError("no reference vectors to write")
    reference_export(vectors, key_col).write.mode("overwrite").option("header", True).csv(path)
