"""Loss, gradient and fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddone.operators.embedding import item_index, map_lenient, split_train_test
from oddone.operators.fitting import LOSSES, embedding_frame, fit, fit_arrays, heldout_accuracy, item_gradients, triplet_terms


def planted(n=40, d=2, k=3000, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    T = []
    while len(T) < k:
        h, a, b = rng.choice(n, 3, replace=False)
        da, db = ((X[h] - X[a]) ** 2).sum(), ((X[h] - X[b]) ** 2).sum()
        T.append((h, a, b) if da < db else (h, b, a))
    return X, np.array(T)


def terms_at(spark, X, T, loss):
    rows = [(int(h), int(w), int(l), X[h].tolist(), X[w].tolist(), X[l].tolist()) for h, w, l in T]
    df = spark.createDataFrame(rows, "h long, w long, l long, h_vec array<double>, w_vec array<double>, l_vec array<double>")
    return triplet_terms(df, loss=loss)


def total(X, T, loss):
    """The loss by numpy."""
    dhw, dhl = ((X[T[:, 0]] - X[T[:, 1]]) ** 2).sum(1), ((X[T[:, 0]] - X[T[:, 2]]) ** 2).sum(1)
    return {"ste": lambda: np.log1p(np.exp(dhw - dhl)), "ckl": lambda: -np.log((0.05 + dhl) / (0.1 + dhw + dhl)),
            "gnmds": lambda: np.maximum(0, 1 + dhw - dhl), "soe": lambda: np.maximum(0, np.sqrt(dhw) + 1 - np.sqrt(dhl)) ** 2}[loss]().sum()


@pytest.mark.parametrize("loss", LOSSES)
def test_gradient_matches_finite_differences(spark, loss):
    X, T = planted(10, 3, 50)
    rows = item_gradients(terms_at(spark, X, T, loss), 3).collect()
    G = {r.id: r.grad for r in rows}
    assert abs(sum(r.loss for r in rows) - total(X, T, loss)) < 1e-9
    eps = 1e-6
    for i, j in [(0, 0), (3, 2), (7, 1)]:
        Xp, Xm = X.copy(), X.copy()
        Xp[i, j] += eps
        Xm[i, j] -= eps
        fd = (total(Xp, T, loss) - total(Xm, T, loss)) / (2 * eps)
        assert abs(fd - G[i][j]) < 1e-4 * max(1.0, abs(fd))


def frames(spark, T, n):
    return (spark.createDataFrame([tuple(int(v) for v in t) for t in T], "h long, w long, l long"),
            spark.range(n).withColumn("item", F.concat(F.lit("i"), "id")))


@pytest.mark.parametrize("loss", LOSSES)
def test_fit_learns_the_order(spark, loss):
    X, T = planted(20, 2, 1500)
    train, items = frames(spark, T[:1200], 20)
    model = fit(train, items, 2, 8, lr=0.3, seed=1, loss=loss)
    acc = heldout_accuracy(frames(spark, T[1200:], 20)[0], model, 2).first()
    assert acc.n_test == 300 and acc.accuracy >= 0.7
    assert embedding_frame(model, items, 2).columns == ["item", "id", "dim_0", "dim_1"]


def test_loss_decreases_and_runs_equal_single_fits(spark):
    X, T = planted(12, 2, 300)
    train, items = frames(spark, T, 12)
    other, _ = frames(spark, T[:100, [0, 2, 1]], 12)
    first, last = (fit(train, items, 2, e, lr=0.1).agg(F.sum("loss")).first()[0] for e in (1, 5))
    assert last < first
    both = train.withColumn("run", F.lit("a")).unionByName(other.withColumn("run", F.lit("b")))
    runs = items.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))
    together = {(r.run, r.id): r.x for r in fit(both, runs, 2, 4, keys=("run",)).collect()}
    for run, own in (("a", train), ("b", other)):
        alone = {r.id: r.x for r in fit(own, items, 2, 4).collect()}
        assert all(np.allclose(together[run, i], x) for i, x in alone.items()) and len(alone) == 12


@pytest.mark.parametrize("loss", LOSSES)
def test_fit_in_a_task_equals_the_epochs_as_jobs(spark, loss, monkeypatch):
    monkeypatch.setattr("oddone.operators.fitting.CHUNK", 64)  # chunks sum up (on the driver; workers take the default)
    X, T = planted(15, 3, 400)
    train, items = frames(spark, T, 15)
    epochs = {r.id: r for r in fit(train, items, 3, 6, lr=0.1, loss=loss, pack_triplets=0).collect()}
    packed = {r.id: r for r in fit(train, items, 3, 6, lr=0.1, loss=loss).collect()}
    start = np.array([r.x for r in sorted(fit(train, items, 3, 0).collect())])
    arrays, total = fit_arrays(T[:, 0], T[:, 1], T[:, 2], start, 6, 0.1, loss)
    assert set(epochs) == set(packed) == set(range(15))
    for i in range(15):
        assert np.allclose(epochs[i].x, packed[i].x, atol=1e-10) and np.allclose(arrays[i], packed[i].x, atol=1e-10)
        assert abs(epochs[i].loss - packed[i].loss) < 1e-8 and abs(total[i] - packed[i].loss) < 1e-8


def test_large_and_small_runs_share_a_fit(spark):
    X, T = planted(12, 2, 300)
    train, items = frames(spark, T, 12)
    both = train.withColumn("run", F.lit("large")).unionByName(train.limit(90).withColumn("run", F.lit("small")))
    runs = items.withColumn("run", F.explode(F.array(F.lit("large"), F.lit("small"))))
    mixed = {(r.run, r.id): r.x for r in fit(both, runs, 2, 4, keys=("run",), pack_triplets=100).collect()}
    packed = {(r.run, r.id): r.x for r in fit(both, runs, 2, 4, keys=("run",)).collect()}
    assert len(mixed) == 24 and set(mixed) == set(packed) and all(np.allclose(mixed[k], packed[k]) for k in mixed)


def test_a_shipped_number_of_epochs_takes_few_jobs(spark):
    X, T = planted(20, 2, 1000)
    train, items = frames(spark, T[:800], 20)
    spark.sparkContext.setJobGroup("packed-fit", "500 epochs")
    try:
        model = fit(train, items, 2, 500, lr=0.05)
        accuracy = heldout_accuracy(frames(spark, T[800:], 20)[0], model, 2).first().accuracy
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert accuracy > 0.9 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("packed-fit")) < 50


def test_fit_without_broadcast_and_errors(spark):
    X, T = planted(12, 2, 100)
    train, items = frames(spark, T, 12)
    spark.conf.set("oddone.broadcast.maxBytes", "10")
    try:
        shuffled = {r.id: r.x for r in fit(train, items, 2, 3, pack_triplets=0).collect()}
    finally:
        spark.conf.unset("oddone.broadcast.maxBytes")
    assert all(np.allclose(shuffled[r.id], r.x) for r in fit(train, items, 2, 3).collect())
    with pytest.raises(ValueError, match="unknown loss"):
        fit(train, items, 2, 1, loss="other")
    with pytest.raises(ValueError, match="no triplet"):
        fit(train.limit(0), items, 2, 1)
    runs = items.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"))))
    with pytest.raises(ValueError, match="no triplet to fit for"):
        fit(train.withColumn("run", F.lit("a")), runs, 2, 1, keys=("run",))


def test_runs_are_split_before_the_fit(spark):
    rows = [(run, f"a{i % 12}", f"a{(i * 5 + 1) % 12}", f"a{(i * 7 + 2) % 12}", i) for run in ("r1", "r2") for i in range(60)]
    df = spark.createDataFrame(rows, "run string, head string, winner string, loser string, n int")
    idx = item_index(df, "run")
    trip = split_train_test(map_lenient(df, idx, "run"), "n", group_col="run")
    assert {r.run: r["count"] for r in trip.filter("is_test").groupBy("run").count().collect()} == {"r1": 12, "r2": 12}
    model = fit(trip.filter("not is_test"), idx, 2, 2, keys=("run",))
    assert model.count() == 24 and heldout_accuracy(trip.filter("is_test"), model, 2, ("run",)).count() == 2
