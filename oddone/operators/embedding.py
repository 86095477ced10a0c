"""Item indexing, triplet mapping and the train/test split.

* :func:`item_index`   sorted distinct items of head/winner/loser (NULL and '-1' dropped) -> 0-based id,
  per run when a run column is given (the reference indexes each answer file on its own)
* :func:`map_lenient`  head/winner/loser -> ids, rows with any miss dropped (inner equi-joins)
* :func:`map_strict`   every listed column -> id; a miss raises (``raise_error``)
* :func:`split_train_test` exact ``ceil(test_size * n)`` test rows per group by seeded hash order

The fits are in :mod:`oddone.operators.fitting`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddone.functions.hashing import seeded_hash
from oddone.operators.indexing import dense_index
from oddone.operators.joins import checked_broadcast
from oddone.session import ensure_checkpoint_dir

MISSING_ITEM = "-1"  # fixed value: the reference's missing-item sentinel


# ------------------------------------------------------------------ indexing
def item_index(answers: DataFrame, run_col: str | None = None, cols=("head", "winner", "loser")) -> DataFrame:
    keys = [run_col] if run_col else []
    items = answers.select(*keys, F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("item"))
    items = items.filter(F.col("item").isNotNull() & (F.col("item") != MISSING_ITEM)).distinct()
    return dense_index(items, ["item"], "id", partition_cols=keys or None)


def column_index(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column (as strings) -> 0-based id (``item, id``)."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to index; there are {df.columns}")
    return dense_index(df.select(F.col(column).cast("string").alias("item")).distinct(), ["item"], "id")


INDEX_ROW_BYTES = 128  # estimate per (run, item, id) row for the broadcast check
INDEX_BROADCAST_ROWS = 32_768  # an index grows with the input: a larger one does not pass the driver
GROUP_ROW_BYTES = 256  # the same for the split's one row per group


def _index_side(index: DataFrame) -> DataFrame:
    """A small item index is broadcast, so the answer table is not shuffled for the three lookups.  Beyond
    ``INDEX_BROADCAST_ROWS`` the lookups shuffle on the item (Spark still broadcasts by itself below
    ``spark.sql.autoBroadcastJoinThreshold``)."""
    ensure_checkpoint_dir(index.sparkSession)
    index = index.checkpoint(eager=True)  # computed once for the three lookups; cleaned up when unreferenced
    n = index.count()
    return checked_broadcast(index, n, INDEX_ROW_BYTES) if n <= INDEX_BROADCAST_ROWS else index


def map_lenient(answers: DataFrame, index: DataFrame, run_col: str | None = None,
                cols=("head", "winner", "loser"), out=("h", "w", "l")) -> DataFrame:
    keys = [run_col] if run_col else []
    side = _index_side(index)
    df = answers
    for c, o in zip(cols, out):
        idx = side.select(*keys, F.col("item").alias(c), F.col("id").cast("int").alias(o))
        df = df.join(idx, keys + [c], "inner")
    return df


def map_strict(df: DataFrame, index: DataFrame, cols: list[str], suffix: str = "_id") -> DataFrame:
    out = df
    side = _index_side(index)
    for c in cols:
        idx = side.select(F.col("item").alias(c), F.col("id").cast("int").alias(c + suffix))
        out = out.join(idx, c, "left")
        out = out.withColumn(c + suffix, F.when(F.col(c + suffix).isNull(), F.raise_error(
            F.concat(F.lit(f"{c} has an item without an id: "), F.coalesce(F.col(c), F.lit("NULL")))
        ).cast("int")).otherwise(F.col(c + suffix)))
    return out


# ------------------------------------------------------------------ split
def split_train_test(df: DataFrame, key: str, seed: int = 42, test_size: float = 0.2,
                     group_col: str | None = None, fanout_bits: int = 12, small: int = 10_000) -> DataFrame:
    """Add ``is_test``: per group the ``ceil(test_size * n)`` rows with the smallest
    ``(h(seed,'split',key), key)``; the rest are train rows.  A NULL group is a group; of rows with
    equal keys any may be the test rows.

    The cut is found on narrow ``(group, hash, key, rows)`` counts: a histogram over the leading hash bits,
    refined within the cut bucket until every group's bucket holds at most ``small`` distinct keys, which are
    then ranked.  Equal keys are one counted row, so a repeated key never fills a task."""
    ensure_checkpoint_dir(df.sparkSession)
    g = F.struct(F.col(group_col) if group_col else F.lit(0))  # a struct of NULL equals itself in joins
    tagged = df.withColumn("_g", g).withColumn("_h", seeded_hash(seed, "split", F.col(key))).withColumn("_k", F.col(key).cast("string"))
    keys = tagged.groupBy("_g", "_h", "_k").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)

    def per_group(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        """``rows`` with the columns of their group in ``side`` (checkpointed, one row per group): literals if there is
        only one group, else a join that broadcasts ``side`` while its counted size fits."""
        if group_col:
            return rows.join(checked_broadcast(side, side.count(), GROUP_ROW_BYTES), "_g", how)
        one = side.drop("_g").first()
        rows = rows.withColumns({f.name: F.lit(one[f.name] if one else None).cast(f.dataType) for f in side.schema.fields if f.name != "_g"})
        return rows if one or how == "left" else rows.limit(0)

    # per group: the range of hashes [_lo, _lo + 2**bits) that holds the cut, and the rows still needed from it
    cut = keys.groupBy("_g").agg(F.lit(0).cast("long").alias("_lo"), F.ceil(F.sum("_n") * F.lit(test_size)).cast("long").alias("_need"))
    cut, bits = cut.checkpoint(eager=True), 60
    while bits:
        step = max(bits - fanout_bits, 0)
        inside = per_group(keys, cut, "inner").filter((F.col("_h") >= F.col("_lo")) & (F.shiftright(F.col("_h") - F.col("_lo"), bits) == 0))
        hist = inside.groupBy("_g", "_lo", "_need", F.shiftright(F.col("_h") - F.col("_lo"), step).alias("_b")).agg(
            F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_keys"))  # at most 2**fanout_bits per group
        before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("_before", before).filter(
            (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_rows") >= F.col("_need")))
        cut = hist.select("_g", (F.col("_lo") + F.shiftleft(F.col("_b"), step)).alias("_lo"),
                          (F.col("_need") - F.col("_before")).alias("_need"), "_keys").checkpoint(eager=True)
        bits = step
        if cut.filter(F.col("_keys") > small).isEmpty():
            break
        cut = cut.drop("_keys")
    cut = cut.select("_g", "_lo", "_need")
    hi = F.col("_lo") + F.lit(1 << bits)
    inside = per_group(keys, cut, "inner").filter((F.col("_h") >= F.col("_lo")) & (F.col("_h") < hi))
    taken = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (inside.withColumn("_taken", taken).filter((F.col("_taken") < F.col("_need")) & (F.col("_taken") + F.col("_n") >= F.col("_need")))
            .select("_g", F.col("_h").alias("_ch"), F.col("_k").alias("_ck"), (F.col("_need") - F.col("_taken")).alias("_left"),
                    F.col("_n").alias("_of")))
    last = last.checkpoint(eager=True)  # one row per group: the key at which the test rows end
    joined = per_group(tagged, last, "left")
    at = (F.col("_h") == F.col("_ch")) & F.col("_k").eqNullSafe(F.col("_ck"))
    below = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col("_k") < F.col("_ck")))
    joined = joined.withColumn("_at", F.coalesce(at, F.lit(False))).withColumn("is_test", F.coalesce(below, F.lit(False)) | (F.col("_at") & (F.col("_left") == F.col("_of"))))
    some = F.col("_at") & (F.col("_left") < F.col("_of"))  # a repeated key is cut in its middle
    drop = ["_g", "_h", "_k", "_ch", "_ck", "_left", "_of", "_at"]
    if last.filter(F.col("_left") < F.col("_of")).isEmpty():
        return joined.drop(*drop)
    middle = first_of_group(joined.filter(some), ["_g"], "_left")
    return joined.filter(~some).unionByName(middle).drop(*drop)


def first_of_group(rows: DataFrame, group: list, need: str, flag: str = "is_test") -> DataFrame:
    """``flag``: true for ``need`` rows of each group, whichever; rows are counted per partition, and only one
    number per (partition, group) is ranked."""
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    per = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).checkpoint(eager=True)
    rows = rows.join(checked_broadcast(per, per.count(), GROUP_ROW_BYTES), [*group, "_part"])
    whole, cut = F.col("_before") + F.col("_in") <= F.col(need), (F.col("_before") < F.col(need)) & (F.col("_before") + F.col("_in") > F.col(need))
    rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_id"))  # of rows that one partition holds anyway
    return (rows.withColumn(flag, F.when(cut, rank <= F.col(need) - F.col("_before")).otherwise(whole))
            .drop("_part", "_id", "_in", "_before"))
