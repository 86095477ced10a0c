"""Seeded triplet sampling (x, y, z) with the reference's law, as Spark jobs.

Law (per attempt): x is a uniform concept *row*; the other rows are visited in a uniformly
random order; y is the first row whose key differs from x's, has a vector and lies nearer
than ``euclid_min``; z is the first such row farther than ``euclid_max`` other than y's row.
An attempt fails when y or z is missing (or has an empty key); the first ``n_items``
successful attempts (in attempt order) are the triplets.

Spark form, exact for that law:

1. *Draw phase* (JVM): attempt ``a`` draws row positions ``pmod(h(seed,'draw',a,k), n)``.  The
   first occurrences of a with-replacement draw sequence are a uniformly random ordering, so
   y = the near draw with the smallest k and z = the far draw with the smallest k whose position
   differs from y's.  Draws are staged (``FIRST_STAGE`` for every attempt, then all ``draws`` for
   the attempts still open), which gives the same result as evaluating every draw.  The candidate
   table is kept partitioned by position: attempts and draws, whose number the input leaves alone, are
   sent to it, and a table with a vector a row never passes the driver (Spark broadcasts it by itself
   below ``spark.sql.autoBroadcastJoinThreshold``).
2. *Lists* (attempts still missing y or z; all attempts with ``draws=0``): what is missing is drawn by index from
   x's near and far rows.  Per key and block of rows the numbers of near, far and both-near-and-far rows are counted
   (:func:`block_counts`, no pair rows); running counts find the block of the k-th such row, and one block's distances
   find the row.  Rows already drawn leave the law alone: an attempt without y has drawn no near row, one without z
   no far row but y.  With y known, z is uniform over the far rows other than y.  With both missing, y is uniform
   over the near rows; then, with b rows near and far besides y and o rows only far, the first far row of a random
   order that has y before all near rows is one of the b with probability b(b+1) / ((b+o)(b+o+1)), else one of the o,
   uniformly in either.
3. *Acceptance*: attempts run in waves sized from the observed success rate; the first ``n_items``
   successes are cut exactly with :func:`first_n_by` (histogram, no global sort).  If fewer than half of the
   first wave succeed, the draw starts again with x drawn from the feasible rows only: those whose key has a
   near and another far row.  Accepted x follow the same law (a failing x is never accepted), and no share of
   infeasible rows, however large, makes the draw long or short: it ends with exactly ``n_items`` triplets
   whenever one row is feasible, and with none and a warning otherwise.

NULL keys match nothing (neither as x nor as a candidate).  The unconstrained draw (no vectors) is
the same machinery with "near" = "far" = any row of another key.
"""

from __future__ import annotations

import math
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddone.functions.hashing import seeded_choice, seeded_hash
from oddone.functions.vectors import euclid
from oddone.operators.distances import block_counts, pack_keys, pack_rows, pick
from oddone.operators.indexing import dense_index, first_n_by
from oddone.operators.joins import checked_broadcast
from oddone.operators.vectors import near_far_counts
from oddone.session import ensure_checkpoint_dir, ship_package

# Open attempts of one x whose blocks are looked up together.
LIST_GROUP = 100_000
FIRST_STAGE = 8

STIMULI_COLS = ["triplet_id", "attempt_id", "item_x", "item_y", "item_z", "dist_x_y", "dist_x_z", "dist_y_z"]


def _attempts(spark, cand: DataFrame, n: int, a0: int, a1: int, seed: int, rows: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Attempts ``[a0, a1)`` with their x row, drawn from all ``n`` rows or from ``rows`` (``i, x_pos`` and their number);
    ``spark.range`` is range-partitioned on ``a``."""
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, (a1 - a0) // 2000 + 1))
    att = spark.range(a0, a1, numPartitions=parts).withColumnRenamed("id", "a")
    if rows is None:
        att = att.withColumn("x_pos", seeded_choice(F.lit(n), seed, "x", F.col("a")))
    else:
        att = att.withColumn("i", seeded_choice(F.lit(rows[1]), seed, "x", F.col("a"))).join(rows[0], "i").drop("i")
    xs = cand.select(F.col("pos").alias("x_pos"), F.col("key").alias("x_key"), F.col("vec").alias("x_vec"))
    return att.join(xs, "x_pos").filter(F.col("x_key").isNotNull())  # a NULL key matches nothing


def feasible_rows(cand: DataFrame, lo: float | None, hi: float | None, use_vectors: bool) -> tuple[DataFrame, int]:
    """``(i, x_pos)`` of the rows from which a triplet can come, numbered by position, and their number: a near row
    and a far row other than it exist (two rows of other keys, without vectors)."""
    if use_vectors:
        named = cand.filter("key <> ''")  # a row with an empty key is never accepted as y or z
        counts = near_far_counts(cand, lo, hi, among=named)
        good = (F.col("n_near") > 0) & (F.col("n_far") > 0) & ((F.col("n_near") > 1) | (F.col("n_far") > 1) | (F.col("n_both") == 0))
        keys = counts.filter(good).select("key")
    else:
        total = cand.filter("key is not null").count()
        keys = cand.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("own")).filter(F.lit(total) - F.col("own") >= 2).select("key")
    rows = dense_index(cand.select(F.col("pos").alias("x_pos"), "key").join(keys, "key", "left_semi").drop("key"), ["x_pos"], "i")
    return rows, rows.count()


def _draw_phase(att: DataFrame, cand: DataFrame, n: int, seed: int, k_hi: int,
                lo: float | None, hi: float | None, use_vectors: bool) -> DataFrame:
    """Per attempt: first near (y) and first far other than y's row (z) among draws ``k < k_hi``."""
    dr = att.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_hi - 1))))
    dr = dr.withColumn("c_pos", seeded_choice(F.lit(n), seed, "draw", F.col("a"), F.col("k")))
    cs = cand.select(F.col("pos").alias("c_pos"), F.col("key").alias("c_key"), F.col("vec").alias("c_vec"))
    dr = dr.join(cs, "c_pos")
    valid = F.col("c_key") != F.col("x_key")
    if use_vectors:
        valid = valid & F.col("c_vec").isNotNull() & F.col("x_vec").isNotNull()
        dist = euclid("x_vec", "c_vec")
        dr = dr.withColumn("d", F.when(valid, dist))
        near = valid & (F.col("d") < F.lit(lo))
        far = valid & (F.col("d") > F.lit(hi))
    else:
        dr = dr.withColumn("d", F.lit(None).cast("double"))
        near = far = valid
    dr = dr.withColumn("near", near).withColumn("far", far)
    cand_struct = F.struct(F.col("k"), F.col("c_pos").alias("pos"), F.col("c_key").alias("key"), F.col("far"))
    agg = dr.groupBy("a").agg(
        F.any_value("x_pos").alias("x_pos"), F.any_value("x_key").alias("x_key"),
        F.min(F.when(F.col("near"), cand_struct)).alias("y"),
        F.array_sort(F.collect_list(F.when(F.col("far"), cand_struct))).alias("fars"),  # <= k_hi entries
    )
    y_pos = F.coalesce(F.col("y.pos"), F.lit(-1))
    z = F.get(F.filter(F.col("fars"), lambda s: s["pos"] != y_pos), 0)
    return agg.select("a", "x_pos", "x_key",
                      F.col("y.pos").alias("y_pos"), F.col("y.key").alias("y_key"), F.col("y.far").alias("y_far"),
                      z["pos"].alias("z_pos"), z["key"].alias("z_key"))


def _located(picks: DataFrame, directory: DataFrame, salts: DataFrame) -> DataFrame:
    """``picks`` (``a, x_key, role, idx, …``) with the ``block`` that holds the idx-th row of the role and the row's index
    ``at`` in it: picks and the running counts of a key's blocks are merged in one sorted pass, a hot key in several."""
    start = F.sum("cnt").over(Window.partitionBy("x_key", "role").orderBy("block")) - F.col("cnt")
    marks = directory.withColumn("v", start).join(salts, "x_key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    marks = marks.select("x_key", "role", "salt", "v", F.lit(0).alias("kind"), "block", F.col("v").alias("first"))
    asked = picks.join(salts, "x_key").withColumn("salt", F.pmod(F.col("a"), F.col("salts"))).drop("salts")
    asked = asked.withColumn("v", F.col("idx")).withColumn("kind", F.lit(1))
    run = Window.partitionBy("x_key", "role", "salt").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = (asked.unionByName(marks, allowMissingColumns=True).withColumn("block", F.last("block", ignorenulls=True).over(run))
              .withColumn("at", F.col("v") - F.last("first", ignorenulls=True).over(run)))
    return merged.filter("kind = 1").drop("kind", "salt", "v", "first", "idx")


def _by_lists(unresolved: DataFrame, rows: DataFrame, seed: int, lo: float, hi: float) -> DataFrame:
    """Attempts (``a, x_key, x_vec`` and what they have of ``y_pos, y_key, y_far, z_pos, z_key``) with y and z; an
    attempt whose x lacks a row for either drops out."""
    open_ = unresolved.checkpoint(eager=True)
    keys = open_.groupBy("x_key").agg(F.first("x_vec").alias("vec"), F.ceil(F.count(F.lit(1)) / LIST_GROUP).cast("long").alias("salts"))
    keys = keys.checkpoint(eager=True)
    counts = block_counts(pack_keys(keys.select(F.col("x_key").alias("key"), "vec")), rows, lo, hi, per_block=True, extremes=False)
    counts = counts.withColumnRenamed("key", "x_key").checkpoint(eager=True)
    totals = counts.groupBy("x_key").agg(*[F.sum(f"n_{c}").alias(f"t_{c}") for c in ("near", "far", "both")]).checkpoint(eager=True)
    n_keys = totals.count()
    totals = checked_broadcast(totals, n_keys, 64)
    salts = checked_broadcast(keys.select("x_key", "salts"), n_keys, 64)
    roles = {"near": F.col("n_near"), "far": F.col("n_far"), "both": F.col("n_both"), "farther": F.col("n_far") - F.col("n_both")}
    directory = counts.select("x_key", "block", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("cnt")) for r, c in roles.items()])).alias("e"))
    directory = directory.select("x_key", "block", "e.role", "e.cnt").filter("cnt > 0")

    def found(picks: DataFrame) -> DataFrame:
        return pick(_located(picks, directory, salts), rows, lo, hi)

    at = open_.join(totals, "x_key").withColumn("no_y", F.col("y_pos").isNull())  # an x without near or far rows drops out
    at = at.filter((~F.col("no_y") | (F.col("t_near") > 0)) & (F.col("z_pos").isNotNull() | (F.col("t_far") > 0)))
    first = at.filter("no_y").select("a", "x_key", "x_vec", F.lit("near").alias("role"), seeded_choice(F.col("t_near"), seed, "ty", F.col("a")).alias("idx"))
    ys = found(first).select("a", F.col("pos").alias("p"), F.col("key").alias("k"), F.col("is_far").alias("f"))
    at = (at.join(ys, "a", "left").withColumn("y_pos", F.coalesce("y_pos", "p")).withColumn("y_key", F.when(F.col("no_y"), F.col("k")).otherwise(F.col("y_key")))
          .withColumn("y_far", F.when(F.col("no_y"), F.col("f")).otherwise(F.col("y_far")).cast("long")).drop("p", "k", "f")).checkpoint(eager=True)
    b, o = F.col("t_both") - F.col("y_far"), F.col("t_far") - F.col("t_both")
    among = F.when(~F.col("no_y"), F.lit("far")).when(b + o == 0, F.lit(None)).when(
        seeded_choice(F.greatest((b + o) * (b + o + 1), F.lit(1)), seed, "tc", F.col("a")) < b * (b + 1), F.lit("both")).otherwise(F.lit("farther"))
    zs = at.filter("z_pos is null").withColumn("role", among).withColumn("without", F.when(F.col("role") == "farther", F.lit(0)).otherwise(F.col("y_far")))
    zs = zs.withColumn("size", F.when(F.col("role") == "far", F.col("t_far")).when(F.col("role") == "both", F.col("t_both")).otherwise(o))
    zs = zs.filter(F.col("role").isNotNull() & (F.col("size") > F.col("without")))
    # uniform over the list without y: an index below the size without it; where that is y itself, the last row instead
    idx = seeded_choice(F.col("size") - F.col("without"), seed, "tz", F.col("a"))
    tries = F.array(F.struct(F.lit(0).alias("n"), idx.alias("idx")), F.struct(F.lit(1).alias("n"), (F.col("size") - 1).alias("idx")))
    asked = zs.withColumn("t", F.explode(F.slice(tries, F.lit(1), F.lit(1) + F.col("without").cast("int"))))
    asked = asked.select((F.col("a") * 2 + F.col("t.n")).alias("a"), "x_key", "x_vec", "role", "t.idx")
    got = found(asked).select(F.shiftright("a", 1).alias("a"), F.struct(F.pmod("a", F.lit(2)).alias("n"), "pos", "key").alias("z"))
    got = got.join(at.select("a", F.col("y_pos").alias("not")), "a").filter(F.col("z.pos") != F.col("not"))
    got = got.groupBy("a").agg(F.min("z").alias("z"))
    out = at.join(got, "a", "left").withColumn("zk", F.when(F.col("z_pos").isNotNull(), F.col("z_key")).otherwise(F.col("z.key")))
    out = out.select("a", "x_key", "y_pos", "y_key", F.coalesce("z_pos", F.col("z.pos")).alias("z_pos"), F.col("zk").alias("z_key"))
    return out.filter("y_pos is not null and z_pos is not null")


def draw_triplets(cand: DataFrame, n_items: int, euclid_min: float | None = None, euclid_max: float | None = None,
                  seed: int = 0, draws: int = 32, max_attempts: int | None = None,
                  use_vectors: bool = True, n_rows: int | None = None) -> DataFrame:
    """Constrained (H1) or, with ``use_vectors=False``, unconstrained (H2) triplet draw.

    ``max_attempts`` is an explicit bound (none by default): if it is reached first, this raises.

    ``cand``: ``(pos, key, vec)`` with dense ``pos`` 0..n-1 (see :func:`candidates`).
    Returns ``STIMULI_COLS`` (distances NULL for the unconstrained draw)."""
    parts = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cand = cand.select("pos", "key", "vec").repartition(parts, "pos").persist(StorageLevel.MEMORY_AND_DISK)  # every join is on pos
    try:
        return _draw(cand, n_items, euclid_min, euclid_max, seed, draws, max_attempts, use_vectors, n_rows)
    finally:
        cand.unpersist()


def _draw(cand: DataFrame, n_items: int, euclid_min: float | None, euclid_max: float | None, seed: int, draws: int,
          max_attempts: int | None, use_vectors: bool, n_rows: int | None) -> DataFrame:
    spark = cand.sparkSession
    ship_package(spark)  # distances of blocks are computed in Python workers
    counted = cand.count()
    n = n_rows if n_rows is not None else counted
    xs = cand.select(F.col("pos").alias("x_pos"), F.col("key").alias("x_key"), F.col("vec").alias("x_vec"))
    ensure_checkpoint_dir(spark)
    lo = float(euclid_min) if euclid_min is not None else None
    hi = float(euclid_max) if euclid_max is not None else None
    rows = None
    if not use_vectors:
        possible = feasible_rows(cand, lo, hi, use_vectors)
        if n and not possible[1]:
            raise ValueError("no key has two rows of other keys to draw from")
    waves, done, a0, wave, packed = [], 0, 0, n_items, None
    missing = F.col("y_pos").isNull() | F.col("z_pos").isNull()
    first = min(FIRST_STAGE, draws)
    while done < n_items and n > 0:
        a1 = a0 + wave if max_attempts is None else min(max_attempts, a0 + wave)
        if a1 <= a0:
            raise RuntimeError(f"{done} of {n_items} triplets after the {max_attempts} attempts allowed")
        att = _attempts(spark, cand, n, a0, a1, seed, rows)
        # staged draws, same result as evaluating all `draws` at once: when y and z are found among
        # the first `first` draws they are also the first among all draws.  Stage results are
        # checkpointed (shared folder): later steps read them instead of re-running the draws.
        if first:
            res = _draw_phase(att, cand, n, seed, first, lo, hi, use_vectors).checkpoint(eager=True)
        else:
            # NULLs, but no literal ones: a checkpoint keeps what the optimizer knows of a column, and it would still
            # take y and z for NULL after they are found
            none = F.when(F.col("a") < 0, F.lit(0))
            res = att.select("a", "x_pos", "x_key", *[none.cast(t).alias(c) for c, t in (
                ("y_pos", "long"), ("y_key", "string"), ("y_far", "boolean"), ("z_pos", "long"), ("z_key", "string"))])
        resolved = res.filter(~missing)
        unresolved = res.filter(missing)
        if first < draws and not unresolved.isEmpty():
            again = unresolved.select("a", "x_pos").join(xs, "x_pos")
            res2 = _draw_phase(again, cand, n, seed, draws, lo, hi, use_vectors).checkpoint(eager=True)
            resolved = resolved.unionByName(res2.filter(~missing))
            unresolved = res2.filter(missing)
        ok = resolved.select("a", "x_key", "y_pos", "y_key", "z_pos", "z_key")
        if not unresolved.isEmpty():
            none = F.array().cast("array<double>")  # without vectors every row of another key is near and far
            if packed is None:
                packed = pack_rows(cand if use_vectors else cand.withColumn("vec", none))
            rest = unresolved.join(xs.select("x_pos", (F.col("x_vec") if use_vectors else none).alias("x_vec")), "x_pos").drop("x_pos")
            ok = ok.unionByName(_by_lists(rest, packed, seed, lo if use_vectors else math.inf, hi if use_vectors else -1.0))
        if use_vectors:  # as in the reference, only the draw with vectors looks at empty keys
            ok = ok.filter((F.col("y_key") != "") & (F.col("z_key") != ""))
        ok = ok.checkpoint(eager=True)
        s = ok.count()
        if rows is None and s < 0.5 * (a1 - a0) and s < n_items:  # start again with x from the feasible rows
            rows = possible if not use_vectors else feasible_rows(cand, lo, hi, use_vectors)
            waves, done, a0, wave = [], 0, 0, n_items
            if not rows[1]:
                warnings.warn("no row has a near and another far row: the draw is empty")
                break
            continue
        waves.append((ok, s))
        done, a0 = done + s, a1
        wave = int(math.ceil((n_items - done) / max(done / a0, 1e-3) * 1.1)) + 64

    if not waves:
        return spark.createDataFrame([], _stimuli_schema())
    # all waves but the last are wholly inside; the last is cut exactly
    kept, total = [], 0
    for ok, s in waves[:-1]:
        kept.append(ok)
        total += s
    last, s_last = waves[-1]
    kept.append(first_n_by(last, "a", n_items - total, value_bits=max(1, int(a0).bit_length()))
                if total + s_last > n_items else last)
    acc = kept[0]
    for k in kept[1:]:
        acc = acc.unionByName(k)

    out = dense_index(acc, ["a"], "triplet_id")
    vec = cand.select("pos", "vec")
    if use_vectors:
        out = (out.join(vec.withColumnRenamed("pos", "y_pos").withColumnRenamed("vec", "y_vec"), "y_pos")
               .join(vec.withColumnRenamed("pos", "z_pos").withColumnRenamed("vec", "z_vec"), "z_pos"))
        xv = cand.select(F.col("key").alias("x_key"), F.col("vec").alias("x_vec")).dropDuplicates(["x_key"])
        out = out.join(xv, "x_key")
        dists = [euclid("x_vec", "y_vec"), euclid("x_vec", "z_vec"), euclid("y_vec", "z_vec")]
    else:
        dists = [F.lit(None).cast("double")] * 3
    out = out.select(F.col("triplet_id"), F.col("a").alias("attempt_id"), F.col("x_key").alias("item_x"),
                     F.col("y_key").alias("item_y"), F.col("z_key").alias("item_z"),
                     dists[0].alias("dist_x_y"), dists[1].alias("dist_x_z"), dists[2].alias("dist_y_z"))
    # materialise the n_items stimuli once in the shared checkpoint folder: every consumer
    # (render, score, export) reads them back instead of re-running the waves
    ensure_checkpoint_dir(spark)
    return out.checkpoint(eager=True)


def _stimuli_schema():
    return ("triplet_id long, attempt_id long, item_x string, item_y string, item_z string, "
            "dist_x_y double, dist_x_z double, dist_y_z double")


def shuffle_yz(stimuli: DataFrame, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """``shuffled_item_y/z``: y and z swapped when the seeded coin says so (or kept in order)."""
    if not shuffle:
        return stimuli.withColumn("shuffled_item_y", F.col("item_y")).withColumn("shuffled_item_z", F.col("item_z"))
    swap = F.pmod(seeded_hash(seed, "shuffle", F.col("triplet_id")), F.lit(2)) == 1
    return (stimuli.withColumn("shuffled_item_y", F.when(swap, F.col("item_z")).otherwise(F.col("item_y")))
            .withColumn("shuffled_item_z", F.when(swap, F.col("item_y")).otherwise(F.col("item_z"))))


def subset_k(concepts: DataFrame, k: int, seed: int = 0, key_col: str = "key") -> DataFrame:
    """Rows whose key is among ``k`` distinct keys drawn without replacement (all duplicates kept)."""
    keys = concepts.select(F.col(key_col).cast("string").alias("_k")).filter("_k is not null").distinct()  # NULL is no key
    keys = keys.withColumn("_h", seeded_hash(seed, "subset", F.col("_k")))
    n_keys, n_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_k")), F.lit(0))).first()
    if k > n_keys:
        raise ValueError(f"cannot choose {k} keys, the table has {n_keys}")
    chosen = first_n_by(keys, "_h", k, value_bits=60).select(F.col("_k").alias(key_col))
    return concepts.join(checked_broadcast(chosen, k, 64 + 4 * n_bytes // max(n_keys, 1)), key_col, "left_semi")
