"""Concept rows, reference vectors and the distance operators over them.

* :func:`zip_matrix`   positional join of concept rows and matrix rows (truncates to the shorter)
* :func:`first_vector` first vector per key (the smallest ``row_idx`` wins)
* :func:`candidates`   every concept row (position) with its key's vector, or NULL
* :func:`near_far_counts` per distinct key: how many candidate rows are near / far, by blocks (no pair rows)
* :func:`triplet_distances` distances for given (a, b, c) rows via equi-joins
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.functions.vectors import euclid
from oddone.operators.distances import COUNTS, block_counts, pack_keys, pack_rows
from oddone.operators.joins import checked_broadcast


def zip_matrix(concepts: DataFrame, matrix: DataFrame, key_col: str = "key") -> DataFrame:
    """Concept row i <-> matrix row i (inner join on ``row_idx``)."""
    return concepts.select("row_idx", key_col).join(matrix.select("row_idx", "vec"), "row_idx")


def zip_lengths(concepts: DataFrame, matrix: DataFrame) -> dict:
    """Row counts of both sides and the mismatch flag the reference warns about."""
    sides = concepts.select(F.lit("c").alias("side")).unionByName(matrix.select(F.lit("m").alias("side")))
    rows = {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()}  # one job for both
    nc, nm = rows.get("c", 0), rows.get("m", 0)
    return {"concept_rows": nc, "matrix_rows": nm, "mismatch": nc != nm}


def first_vector(zipped: DataFrame, key_col: str = "key") -> DataFrame:
    """``(key, vec, first_row_idx)`` with the vector of the first occurrence of each key."""
    return (zipped.groupBy(key_col)
            .agg(F.min_by("vec", "row_idx").alias("vec"), F.min("row_idx").alias("first_row_idx"),
                 F.count(F.lit(1)).alias("n_rows")))


def candidates(concepts: DataFrame, vectors: DataFrame | None, key_col: str = "key") -> DataFrame:
    """``(pos, key, vec)`` for every concept row; ``vec`` is the key's first vector (or NULL)."""
    c = concepts.select(F.col("row_idx").alias("pos"), F.col(key_col).cast("string").alias("key"))
    if vectors is None:
        return c.withColumn("vec", F.lit(None).cast("array<double>"))
    return c.join(vectors.select(F.col(key_col).cast("string").alias("key"), "vec"), "key", "left")


def matrix_row_bytes(dim: int) -> int:
    return 8 * dim + 64


def near_far_counts(cand: DataFrame, euclid_min: float, euclid_max: float, among: DataFrame | None = None, by: str = "pos",
                    with_pairs: bool = False) -> DataFrame:
    """Per distinct key with a vector: candidate rows (other keys, with vectors), how many are
    near (``dist < euclid_min``), far (``dist > euclid_max``) and both, plus min/max distance.

    Key blocks and row blocks meet in the cells of a grid (:mod:`oddone.operators.distances`): no pair becomes a row and
    nothing passes the driver.  ``among`` restricts the rows counted; ``by="pivot"`` packs rows by nearest pivot, so
    that most blocks of clustered vectors are counted whole.  ``with_pairs`` adds ``pairs`` and ``skipped`` (of them,
    settled by their block's bounds): sum them over all keys for the share."""
    keys = pack_keys(cand.filter("key is not null and vec is not null").groupBy("key").agg(F.first("vec").alias("vec")))
    parts = block_counts(keys, pack_rows(cand if among is None else among, by), euclid_min, euclid_max)
    sums = [*COUNTS, "pairs", "skipped"] if with_pairs else COUNTS
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("min_dist").alias("min_dist"), F.max("max_dist").alias("max_dist"),
                                    *[F.sum(c).alias(c) for c in sums if c not in COUNTS])


def with_vectors(df: DataFrame, vecs: DataFrame, cols: list[str], n_vec_rows: int | None = None,
                 dim: int = 64) -> DataFrame:
    """Attach ``{c}_vec`` for each item column via equi-joins on the item key."""
    v = vecs.select(F.col("key"), F.col("vec"))
    if n_vec_rows is not None:
        v = checked_broadcast(v, n_vec_rows, matrix_row_bytes(dim))
    out = df
    for c in cols:
        out = out.join(v.select(F.col("key").alias(c), F.col("vec").alias(f"{c}_vec")), c, "left")
    return out


def triplet_distances(df: DataFrame, vecs: DataFrame, a: str, b: str, c: str, n_vec_rows: int | None = None,
                      dim: int = 64) -> DataFrame:
    """``dist_{a}_{b}``, ``dist_{a}_{c}``, ``dist_{b}_{c}`` for each row (NULL when a vector is missing)."""
    out = with_vectors(df, vecs, [a, b, c], n_vec_rows, dim)
    return (out.withColumn(f"dist_{a}_{b}", euclid(f"{a}_vec", f"{b}_vec"))
            .withColumn(f"dist_{a}_{c}", euclid(f"{a}_vec", f"{c}_vec"))
            .withColumn(f"dist_{b}_{c}", euclid(f"{b}_vec", f"{c}_vec"))
            .drop(f"{a}_vec", f"{b}_vec", f"{c}_vec"))
