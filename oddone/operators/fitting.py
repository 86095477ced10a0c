"""Ordinal-embedding fits as DataFrame plans.

A run (all triplets, or those of one key) with at most ``PACK_TRIPLETS`` triplets is fitted by one task, all its epochs in
one job: runs are dealt to tasks, and a task holds one run at a time. Larger runs share the epochs of one plan:

The model is a table ``(keys…, id, x, m, v)``: an item's vector and the two moments of its Adam step. One
epoch joins each triplet with its three vectors, sums the gradients of the items it touches (aggregated
before the shuffle, so a hot item costs one row per task), and updates the table. With ``keys`` many
independent fits share each epoch; a run is never gathered in one task and nothing passes the driver. The
table is checkpointed after each epoch, in the folder that the cluster names.

Both ways compute the same sums. Start values come from the seeded md5 hash, so any engine can state them.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddone.functions.hashing import HASH_SPACE, seeded_hash
from oddone.functions.vectors import sq_euclid
from oddone.operators.joins import checked_broadcast
from oddone.operators.vectors import matrix_row_bytes
from oddone.session import ensure_checkpoint_dir, ship_package

LOSSES = ("ste", "ckl", "gnmds", "soe")
CKL_MU = 0.05  # CKL regulariser
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8  # Adam
#: Triplets of a run that one task fits by itself, and those it computes at a time.
PACK_TRIPLETS, CHUNK = 1_000_000, 1 << 16


def loss_terms(dhw: Column, dhl: Column, loss: str = "ste") -> tuple[Column, Column, Column]:
    """Loss of a triplet and its derivatives by the squared distances D_hw and D_hl.

    ste   log(1 + exp(D_hw - D_hl))                     (van der Maaten & Weinberger 2012)
    ckl   -log((mu + D_hl) / (2 mu + D_hw + D_hl))      (Tamuz et al. 2011)
    gnmds max(0, 1 + D_hw - D_hl)                       (Agarwal et al. 2007)
    soe   max(0, sqrt(D_hw) + 1 - sqrt(D_hl))^2         (Terada & von Luxburg 2014)"""
    zero, one = F.lit(0.0), F.lit(1.0)
    if loss == "ste":
        m = dhw - dhl
        s = one / (one + F.exp(-m))
        return F.when(m > 30, m).otherwise(F.log1p(F.exp(m))), s, -s
    if loss == "ckl":
        den = dhw + dhl + 2 * CKL_MU
        return -F.log((dhl + CKL_MU) / den), one / den, one / den - one / (dhl + CKL_MU)
    if loss == "gnmds":
        t = one + dhw - dhl
        on = F.when(t > 0, one).otherwise(zero)
        return F.greatest(t, zero), on, -on
    if loss == "soe":
        rw, rl = F.sqrt(dhw), F.sqrt(dhl)
        t = F.greatest(rw + 1 - rl, zero)
        return t * t, F.when(rw > 0, t / rw).otherwise(zero), F.when(rl > 0, -t / rl).otherwise(zero)
    raise ValueError(f"unknown loss {loss!r}; known: {', '.join(LOSSES)}")


def triplet_terms(df: DataFrame, h_vec: str = "h_vec", w_vec: str = "w_vec", l_vec: str = "l_vec", loss: str = "ste") -> DataFrame:
    """Adds ``loss``, the derivatives ``gw`` and ``gl``, and ``correct`` (the winner is nearer)."""
    df = df.withColumns({"_dhw": sq_euclid(h_vec, w_vec), "_dhl": sq_euclid(h_vec, l_vec)})
    value, gw, gl = loss_terms(F.col("_dhw"), F.col("_dhl"), loss)
    return df.withColumns({"loss": value, "gw": gw, "gl": gl, "correct": F.col("_dhw") < F.col("_dhl")}).drop("_dhw", "_dhl")


def item_gradients(terms: DataFrame, d: int, h: str = "h", w: str = "w", l: str = "l", keys: tuple = (), out: str = "id",
                   h_vec: str = "h_vec", w_vec: str = "w_vec", l_vec: str = "l_vec") -> DataFrame:
    """``keys…, out, grad, loss``: the summed gradient of each touched item, and the loss of the triplets it heads."""
    def scaled(scale: Column, other: str) -> Column:
        return F.zip_with(h_vec, other, lambda a, b: (a - b) * 2.0 * scale)

    by_w, by_l = F.col("_by_w"), F.col("_by_l")
    minus = lambda v: F.transform(v, lambda x: -x)
    parts = F.array(F.struct(F.col(h).alias("i"), F.zip_with(by_w, by_l, lambda a, b: a + b).alias("g"), F.col("loss").alias("c")),
                    F.struct(F.col(w).alias("i"), minus(by_w).alias("g"), F.lit(0.0).alias("c")),
                    F.struct(F.col(l).alias("i"), minus(by_l).alias("g"), F.lit(0.0).alias("c")))
    spread = (terms.withColumns({"_by_w": scaled(F.col("gw"), w_vec), "_by_l": scaled(F.col("gl"), l_vec)})
              .select(*keys, F.explode(parts).alias("p")))
    sums = spread.groupBy(*keys, F.col("p.i").alias(out)).agg(
        *[F.sum(F.get(F.col("p.g"), F.lit(k))).alias(f"_g{k}") for k in range(d)], F.sum("p.c").alias("loss"))
    return sums.select(*keys, out, F.array(*[f"_g{k}" for k in range(d)]).alias("grad"), "loss")


def with_model(triplets: DataFrame, model: DataFrame, n_items: int, d: int, keys: tuple = (), vector: str = "x") -> DataFrame:
    """Triplets with ``h_vec, w_vec, l_vec``; the model is broadcast if its counted size fits."""
    side = checked_broadcast(model.select(*keys, "id", vector), n_items, matrix_row_bytes(d))
    for c in ("h", "w", "l"):
        triplets = triplets.join(side.select(*keys, F.col("id").alias(c), F.col(vector).alias(f"{c}_vec")), [*keys, c])
    return triplets


def start_values(items: DataFrame, d: int, seed: int) -> Column:
    """Uniform in +-1/sqrt(d), by seed, id and dimension."""
    scale = 2.0 / (math.sqrt(d) * HASH_SPACE)
    return F.array(*[(seeded_hash(seed, "init", F.col("id"), F.lit(k)) - HASH_SPACE // 2) * F.lit(scale) for k in range(d)])


def loss_arrays(dhw: np.ndarray, dhl: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`loss_terms` over arrays."""
    if loss == "ste":
        m = dhw - dhl
        s = 1 / (1 + np.exp(-np.maximum(m, -700)))
        return np.where(m > 30, m, np.log1p(np.exp(np.minimum(m, 30)))), s, -s
    if loss == "ckl":
        den = dhw + dhl + 2 * CKL_MU
        return -np.log((dhl + CKL_MU) / den), 1 / den, 1 / den - 1 / (dhl + CKL_MU)
    if loss == "gnmds":
        t = 1 + dhw - dhl
        on = (t > 0).astype(float)
        return np.maximum(t, 0), on, -on
    rw, rl = np.sqrt(dhw), np.sqrt(dhl)
    t = np.maximum(rw + 1 - rl, 0)
    return t * t, np.divide(t, rw, out=np.zeros_like(t), where=rw > 0), -np.divide(t, rl, out=np.zeros_like(t), where=rl > 0)


def fit_arrays(h: np.ndarray, w: np.ndarray, l: np.ndarray, x: np.ndarray, max_epochs: int, lr: float, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """All epochs of one run: the fitted vectors and the last epoch's loss by head item, from start values ``x``."""
    x, (n, d) = x.copy(), x.shape
    m, v, total = np.zeros_like(x), np.zeros_like(x), np.zeros(n)
    for step in range(1, max_epochs + 1):
        grad, total = np.zeros_like(x), np.zeros(n)
        for a in range(0, len(h), CHUNK):
            hh, ww, ll = h[a:a + CHUNK], w[a:a + CHUNK], l[a:a + CHUNK]
            to_w, to_l = x[hh] - x[ww], x[hh] - x[ll]
            value, gw, gl = loss_arrays((to_w * to_w).sum(axis=1), (to_l * to_l).sum(axis=1), loss)
            by_w, by_l = to_w * (2 * gw)[:, None], to_l * (2 * gl)[:, None]
            total += np.bincount(hh, value, n)
            for k in range(d):
                grad[:, k] += np.bincount(hh, by_w[:, k] + by_l[:, k], n) - np.bincount(ww, by_w[:, k], n) - np.bincount(ll, by_l[:, k], n)
        grad /= len(h)
        m = m * BETA1 + grad * (1 - BETA1)
        v = v * BETA2 + grad * grad * (1 - BETA2)
        x -= lr * (m / (1 - BETA1 ** step) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON))
    return x, total


def _fit_packed(triplets: DataFrame, start: DataFrame, join_keys: tuple, max_epochs: int, lr: float, loss: str) -> DataFrame:
    """The fits of small runs, ``join_keys, id, x, loss``: a run's triplets and start values meet in one task."""
    fields = [f for f in start.schema.fields if f.name in join_keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL("id long, x array<double>, loss double").fields])

    def run(items: pa.Table, rows: pa.Table) -> pa.Table:
        if not items.num_rows:  # triplets of a run without items: none can be mapped
            return items.select([*join_keys, "id", "x"]).append_column("loss", pa.array([], pa.float64()))
        items = items.sort_by("id")
        ids = items.column("id").to_numpy()
        x = items.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        places = [np.searchsorted(ids, rows.column(c).to_numpy()) for c in ("h", "w", "l")]
        x, total = fit_arrays(*places, x, max_epochs, lr, loss)
        out = items.select([*join_keys, "id"])
        return out.append_column("x", pa.array(list(x), pa.list_(pa.float64()))).append_column("loss", pa.array(total))

    start = start.select(*[F.col(c).alias(c) for c in start.columns])  # both sides may come from one table of answers
    return start.groupBy(*join_keys).cogroup(triplets.groupBy(*join_keys)).applyInArrow(run, schema)


def fit(triplets: DataFrame, items: DataFrame, d: int = 10, max_epochs: int = 50, lr: float = 0.05, seed: int = 0,
        loss: str = "ste", keys: tuple = (), pack_triplets: int = PACK_TRIPLETS) -> DataFrame:
    """The fitted model ``keys…, id, x, loss`` for ``triplets(keys…, h, w, l)`` over ``items(keys…, id)``.

    Full-batch Adam on the mean loss of each key's triplets. ``loss`` is the last epoch's summed loss of the
    triplets that the item heads, before its step: summed over a key's items and divided by its triplets it
    is the mean loss. Items that no triplet names keep their start values. A key without any triplet raises.
    Runs of at most ``pack_triplets`` triplets (and as many items) are fitted inside a task, larger ones by a job an epoch.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; known: {', '.join(LOSSES)}")
    spark = triplets.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    keys = tuple(keys)
    join_keys = keys or ("_all",)
    if not keys:
        triplets, items = triplets.withColumn("_all", F.lit(0)), items.withColumn("_all", F.lit(0))
    triplets = triplets.select(*join_keys, *[F.col(c).cast("long").alias(c) for c in ("h", "w", "l")]).checkpoint(eager=True)
    sizes = triplets.groupBy(*join_keys).agg(F.count(F.lit(1)).cast("double").alias("k"))
    per_run = items.groupBy(*join_keys).agg(F.count(F.lit(1)).alias("n")).join(sizes, list(join_keys), "left").checkpoint(eager=True)
    without = per_run.filter("k is null").select(*keys).limit(1).collect()
    small = (F.col("k") <= pack_triplets) & (F.col("n") <= pack_triplets)
    n_runs, n_large, n_items = per_run.agg(F.count(F.lit(1)), F.count(F.when(~small, 1)), F.coalesce(F.sum(F.when(~small, F.col("n"))), F.lit(0))).first()
    if without or not n_runs:
        raise ValueError(f"there is no triplet to fit{f' for {without[0].asDict()}' if without and keys else ''}")
    zeros = F.array(*[F.lit(0.0)] * d)
    start = items.select(*join_keys, F.col("id").cast("long").alias("id")).withColumn("x", start_values(items, d, seed))

    def of_runs(rows: DataFrame, which: Column) -> DataFrame:
        if n_large in (0, n_runs):
            return rows
        some = checked_broadcast(per_run.filter(which).select(*[F.col(c).alias(f"_{c}") for c in join_keys]), n_runs, 128)
        return rows.join(some, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in join_keys]), "left_semi")

    parts = []
    if n_large < n_runs:
        parts.append(_fit_packed(of_runs(triplets, small), of_runs(start, small), join_keys, max_epochs, lr, loss).checkpoint(eager=True))
    if n_large:
        large = of_runs(start, ~small).join(checked_broadcast(per_run.drop("n"), n_runs, 128), list(join_keys))
        large = large.withColumns({"m": zeros, "v": zeros, "loss": F.lit(0.0)}).checkpoint(eager=True)
        parts.append(_fit_by_epochs(of_runs(triplets, ~small), large, n_items, d, max_epochs, lr, loss, join_keys))
    model = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return model.select(*keys, "id", "x", "loss")


def _fit_by_epochs(triplets: DataFrame, model: DataFrame, n_items: int, d: int, max_epochs: int, lr: float, loss: str, join_keys: tuple) -> DataFrame:
    zeros = F.array(*[F.lit(0.0)] * d)
    for step in range(1, max_epochs + 1):
        terms = triplet_terms(with_model(triplets, model, n_items, d, join_keys), loss=loss)
        sums = item_gradients(terms, d, keys=join_keys)
        state = model.drop("loss").join(sums, [*join_keys, "id"], "left")
        state = state.withColumn("grad", F.transform(F.coalesce("grad", zeros), lambda g: g / F.col("k")))
        state = state.withColumns({"m": F.zip_with("m", "grad", lambda a, g: a * BETA1 + g * (1 - BETA1)),
                                   "v": F.zip_with("v", "grad", lambda a, g: a * BETA2 + g * g * (1 - BETA2))})
        moved = F.zip_with("m", "v", lambda m, v: m / (1 - BETA1 ** step) / (F.sqrt(v / (1 - BETA2 ** step)) + EPSILON))
        state = state.withColumns({"x": F.zip_with("x", moved, lambda a, b: a - b * lr), "loss": F.coalesce("loss", F.lit(0.0))})
        model = state.select(*join_keys, "id", "k", "x", "m", "v", "loss").checkpoint(eager=True)
    return model.select(*join_keys, "id", "x", "loss")


def heldout_accuracy(test: DataFrame, model: DataFrame, d: int, keys: tuple = ()) -> DataFrame:
    """``keys…, n_test, n_correct, accuracy`` of the fitted model on triplets it has not seen."""
    terms = triplet_terms(with_model(test.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("h", "w", "l")]),
                                     model, model.count(), d, tuple(keys)))
    right = F.count(F.when(F.col("correct"), 1))
    return terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), right.alias("n_correct"),
                                    (right / F.count(F.lit(1))).alias("accuracy"))


def embedding_frame(model: DataFrame, items: DataFrame, d: int, keys: tuple = ()) -> DataFrame:
    """``keys…, item, id, dim_0…``: the model with its labels."""
    from oddone.sinks.writers import wide_embedding

    named = items.select(*keys, "item", F.col("id").cast("long").alias("id")).join(model.select(*keys, "id", "x"), [*keys, "id"])
    return wide_embedding(named, d, "x", keys=(*keys, "item", "id"))
