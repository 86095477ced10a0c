"""Dense ids and exact first-n selection without a single-partition window.

* :func:`dense_index` numbers rows ``0..n-1`` in a total order: range-partition + sort,
  then per-partition row counts (one row per partition) give each partition its offset.
* :func:`first_n_by` keeps the n rows with the smallest non-negative BIGINT order value:
  a histogram over value buckets finds the cut bucket; only that bucket is ranked, and a
  cut bucket that is still large is refined again, so no task ever ranks an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from oddone.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _parts(df: DataFrame, num_partitions: int | None) -> int:
    return num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_index(df: DataFrame, order_cols: list, name: str = "idx", partition_cols: list | None = None,
                num_partitions: int | None = None, counted: Observation | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank in ``order_cols`` order (order must be total/unique).

    With ``partition_cols`` the rank restarts per group (a NULL is a group).  Rows are range-partitioned on group
    and order together, so a group of any size spreads over many partitions.  The ordered rows are checkpointed:
    counts and ids read the same rows, and nothing stays cached.  ``counted`` gets the number of rows, ``n``, from the
    same job."""
    ensure_checkpoint_dir(df.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    group = F.struct(*partition_cols) if partition_cols else F.lit(0)  # a struct of NULLs equals itself in joins
    ordered = df.withColumn("_group", group)
    ordered = (ordered.repartitionByRange(_parts(df, num_partitions), "_group", *order).sortWithinPartitions("_group", *order)
               .withColumn("_mid", F.monotonically_increasing_id()))
    if counted is not None:
        ordered = ordered.observe(counted, F.count(F.lit(1)).alias("n"))
    ordered = ordered.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = ordered.groupBy("_group", pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("_group", "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    if not partition_cols:
        offsets = F.broadcast(offsets)  # one row per partition
    return (ordered.withColumn("_pid", pid).join(offsets, ["_group", "_pid"])
            .withColumn(name, F.col("_off") + F.col("_mid")).drop("_mid", "_pid", "_off", "_group"))


def first_n_by(df: DataFrame, order_col: str, n: int, value_bits: int = 62, max_exact: int = 10_000,
               fanout_bits: int = 12) -> DataFrame:
    """Rows with the ``n`` smallest values of ``order_col`` (unique, in ``[0, 2**value_bits)``)."""
    if n <= 0:
        return df.limit(0)
    lo_bits = value_bits  # current range is [base, base + 2**lo_bits)
    base = 0
    keep = []  # DataFrames fully inside the answer
    rest = df
    need = n
    while True:
        shift = max(lo_bits - fanout_bits, 0)
        bucket = F.shiftright(F.col(order_col) - F.lit(base), shift)
        in_range = (F.col(order_col) >= base) & (F.col(order_col) < base + (1 << lo_bits))
        hist = (rest.filter(in_range).groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
                .orderBy("_b").collect())  # at most 2**fanout_bits rows
        cum = 0
        cut = None
        for row in hist:
            if cum + row["_n"] >= need:
                cut = (row["_b"], row["_n"])
                break
            cum += row["_n"]
        if cut is None:  # fewer than n rows: everything qualifies
            keep.append(rest.filter(in_range))
            break
        b, cnt = cut
        lo_val = base + (b << shift)
        keep.append(rest.filter((F.col(order_col) >= base) & (F.col(order_col) < lo_val)))
        need -= cum
        if cnt <= max_exact or shift == 0:
            hi_val = lo_val + (1 << shift)
            cut_rows = rest.filter((F.col(order_col) >= lo_val) & (F.col(order_col) < hi_val))
            w = Window.orderBy(order_col)  # one bucket of at most max_exact rows
            keep.append(cut_rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need).drop("_r"))
            break
        base, lo_bits = lo_val, shift
    out = keep[0]
    for k in keep[1:]:
        out = out.unionByName(k)
    return out
