"""Triplet sampling: exact law against enumeration, properties, edge cases."""

import functools
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddone.operators import distances, sampling
from oddone.operators.sampling import draw_triplets, shuffle_yz, subset_k
from oddone.operators.vectors import candidates, first_vector, near_far_counts, zip_matrix


def cand_df(spark, keys, vecs):
    rows = [(i, k, [float(v)] if v is not None else None) for i, (k, v) in enumerate(zip(keys, vecs))]
    return spark.createDataFrame(rows, "pos long, key string, vec array<double>")


def exact_law(keys, vecs, lo, hi):
    """P(x, y, z | success) by enumerating x and every ordering of the rows (the reference loop)."""
    n = len(keys)
    probs = Counter()
    for xi in range(n):
        x = keys[xi]
        if vecs[xi] is None:
            continue
        perms = list(itertools.permutations(range(n)))
        for perm in perms:
            y = z = None
            for o in perm:
                if keys[o] == x or vecs[o] is None:
                    continue
                d = abs(vecs[xi] - vecs[o])
                if y is None and d < lo:
                    y = o
                elif z is None and d > hi:
                    z = o
                if y is not None and z is not None:
                    break
            if y is not None and z is not None and keys[y] and keys[z]:
                probs[(x, keys[y], keys[z])] += 1.0 / n / len(perms)
    tot = sum(probs.values())
    return {k: v / tot for k, v in probs.items()}


@pytest.mark.parametrize("draws", [1, 32])
def test_draw_matches_exact_law(spark, draws):
    keys = ["a", "b", "c", "d", "e"]
    vecs = [0.0, 1.0, 2.0, 3.0, 10.0]
    lo, hi = 2.5, 1.5  # near and far overlap, and far has members outside near: the hard case
    law = exact_law(keys, vecs, lo, hi)
    out = draw_triplets(cand_df(spark, keys, vecs), 3000, lo, hi, seed=7, draws=draws).collect()
    assert len(out) == 3000
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    for k in set(law) | set(emp):
        assert abs(emp[k] / 3000 - law.get(k, 0.0)) < 0.03, k
    for r in out:
        assert r.item_x != r.item_y and r.item_x != r.item_z
        assert r.dist_x_y < lo and r.dist_x_z > hi


def test_draw_empty_when_nothing_is_near(spark):
    with pytest.warns(UserWarning, match="the draw is empty"):
        out = draw_triplets(cand_df(spark, ["a", "b", "c"], [0.0, 1.0, 2.0]), 5, -1, -1, seed=1)
    assert out.count() == 0


def test_duplicate_keys_may_repeat(spark):
    keys = ["bat", "bat", "cow"]
    out = draw_triplets(cand_df(spark, keys, [None, None, None]), 200, seed=3, use_vectors=False).collect()
    assert {(r.item_x, r.item_y, r.item_z) for r in out} == {("cow", "bat", "bat")}


def test_unconstrained_law(spark):
    keys = ["a", "b", "c", "d"]
    out = draw_triplets(cand_df(spark, keys, [None] * 4), 4000, seed=5, use_vectors=False, draws=2).collect()
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    assert len(emp) == 4 * 3 * 2
    for v in emp.values():
        assert abs(v / 4000 - 1 / 24) < 0.015


def test_partition_independent(spark):
    keys = [f"k{i}" for i in range(30)]
    vecs = [float(i % 7) for i in range(30)]
    c = cand_df(spark, keys, vecs)
    a = draw_triplets(c, 300, 2.0, 3.0, seed=11).orderBy("triplet_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = draw_triplets(c.repartition(5), 300, 2.0, 3.0, seed=11).orderBy("triplet_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_first_vector_and_zip(spark):
    concepts = spark.createDataFrame([(0, "bat"), (1, "cow"), (2, "bat")], "row_idx long, key string")
    matrix = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_idx long, vec array<double>")
    z = zip_matrix(concepts, matrix)
    assert z.count() == 2
    fv = {r.key: (r.vec, r.first_row_idx) for r in first_vector(z).collect()}
    assert fv == {"bat": ([1.0], 0), "cow": ([2.0], 1)}
    cand = {r.pos: r.vec for r in candidates(concepts, first_vector(z)).collect()}
    assert cand == {0: [1.0], 1: [2.0], 2: [1.0]}


def test_subset_and_shuffle(spark):
    concepts = spark.createDataFrame([(i, f"k{i % 5}") for i in range(20)], "row_idx long, key string")
    s = subset_k(concepts, 2, seed=1)
    assert s.select("key").distinct().count() == 2 and s.count() == 8
    with pytest.raises(ValueError):
        subset_k(concepts, 6)
    st = spark.createDataFrame([(i, "y", "z") for i in range(200)], "triplet_id long, item_y string, item_z string")
    sh = shuffle_yz(st, seed=2).groupBy("shuffled_item_y").count().collect()
    assert {r.shuffled_item_y for r in sh} == {"y", "z"}
    kept = shuffle_yz(st, shuffle=False).filter(F.col("shuffled_item_y") != "y").count()
    assert kept == 0


@pytest.mark.parametrize("lo, hi", [(2.5, 1.5), (1.5, 2.5), (20.0, 0.5), (2.5, 0.5), (11.0, 8.5)])
def test_draw_by_lists_matches_exact_law(spark, lo, hi):
    """No draws at all: y and z by index, for disjoint, nested and overlapping near and far rows, repeated keys among them."""
    keys, vecs = ["a", "b", "c", "d", "e", "c"], [0.0, 1.0, 2.0, 3.0, 10.0, 2.0]
    law = exact_law(keys, vecs, lo, hi)
    out = draw_triplets(cand_df(spark, keys, vecs), 4000, lo, hi, seed=7, draws=0).collect()
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    assert len(out) == 4000 and set(emp) <= set(law)
    for k in law:
        assert abs(emp[k] / 4000 - law[k]) < 0.03, k


@pytest.mark.parametrize("draws", [0, 1, 3])
def test_lists_over_many_blocks_match_exact_law(spark, draws, monkeypatch):
    """Blocks of two rows, joins that shuffle, picks of one key and of one block split over several groups."""
    keys, vecs = ["a", "b", "c", "d", "e"], [0.0, 1.0, 2.0, 3.0, 10.0]
    law = exact_law(keys, vecs, 2.5, 1.5)
    monkeypatch.setattr(sampling, "LIST_GROUP", 70)
    monkeypatch.setattr(sampling, "pack_rows", functools.partial(distances.pack_rows, size=2))
    monkeypatch.setattr(sampling, "pick", functools.partial(distances.pick, group=50))
    spark.conf.set("oddone.broadcast.maxBytes", str(2 * (8 + 64)))
    try:
        out = draw_triplets(cand_df(spark, keys, vecs), 3000, 2.5, 1.5, seed=7, draws=draws).collect()
    finally:
        spark.conf.unset("oddone.broadcast.maxBytes")
        monkeypatch.undo()
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    for k in set(law) | set(emp):
        assert abs(emp[k] / 3000 - law.get(k, 0.0)) < 0.03, k
    ref = draw_triplets(cand_df(spark, keys, vecs), 3000, 2.5, 1.5, seed=7, draws=draws).collect()
    assert sorted(tuple(r) for r in out) == sorted(tuple(r) for r in ref)  # same rows either way


def broadcast_subtrees(plan):
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if (at := line.find("BroadcastExchange")) >= 0:
            inside = list(itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)")) > at, lines[i + 1:]))
            yield "\n".join([line, *inside])


@pytest.mark.parametrize("use_vectors", [True, False])
def test_the_candidate_table_does_not_pass_the_driver(spark, use_vectors, monkeypatch):
    """Beyond Spark's own threshold for a broadcast no join asks for one of the table that grows with the input."""
    keys, vecs = [f"k{i}" for i in range(60)], [float(i % 7) for i in range(60)]
    seen, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, f=kind.checkpoint, **k: (
        seen.append(self._jdf.queryExecution().executedPlan().toString()), f(self, *a, **k))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = draw_triplets(cand_df(spark, keys, vecs), 200, 1.5, 4.5, seed=7, draws=2, use_vectors=use_vectors).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(out) == 200 and any("Join" in p for p in seen)
    assert not [b for p in seen for b in broadcast_subtrees(p) if "InMemoryTableScan" in b]
    monkeypatch.undo()
    assert sorted(map(tuple, out)) == sorted(map(tuple, draw_triplets(cand_df(spark, keys, vecs), 200, 1.5, 4.5, seed=7, draws=2, use_vectors=use_vectors).collect()))


def test_unconstrained_draw_by_lists(spark):
    out = draw_triplets(cand_df(spark, ["a", "b", "c", "d"], [None] * 4), 4000, seed=5, use_vectors=False, draws=0).collect()
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    assert len(emp) == 4 * 3 * 2 and all(abs(v / 4000 - 1 / 24) < 0.015 for v in emp.values())


def test_candidates_are_released_when_a_draw_raises(spark):
    with pytest.raises(RuntimeError, match="attempts allowed"):
        draw_triplets(cand_df(spark, [f"k{i}" for i in range(50)], [0.0, 0.5] + [100.0 + 10 * i for i in range(48)]), 300, 1.0, 50.0, seed=3, max_attempts=50)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def counts_plain(keys, mat, lo, hi, among):
    out = {}
    for i, k in enumerate(keys):
        if k is None or k in out:
            continue
        d = np.array([np.sqrt(((mat[i] - mat[j]) ** 2).sum()) for j in range(len(keys)) if keys[j] not in (k, None) and among[j]])
        out[k] = (len(d), int((d < lo).sum()), int((d > hi).sum()), int(((d < lo) & (d > hi)).sum()), d.min() if len(d) else None, d.max() if len(d) else None)
    return out


@pytest.mark.parametrize("by", ["pos", "pivot"])
@pytest.mark.parametrize("kind, lo, hi", [("ball", 1.2, 1.5), ("ball", 1.5, 1.2), ("grid", 2.0, 2.0), ("grid", 0.0, 0.0), ("clusters", 8.0, 20.0),
                                          ("ball", -1.0, -1.0), ("ball", 1e10, 0.0), ("far", 2.0, 3.0)])
def test_near_far_counts_equal_the_plain_formula(spark, by, kind, lo, hi):
    """Thresholds met exactly (grid), vectors far from the origin, clusters, repeated and NULL keys, rows left out."""
    r = np.random.default_rng(5)
    n = 70
    mat = {"ball": lambda: r.normal(size=(n, 6)) / 2, "grid": lambda: r.integers(0, 3, (n, 2)).astype(float),
           "clusters": lambda: r.normal(size=(n, 3)) * 0.1 + 30 * r.integers(0, 4, (n, 1)), "far": lambda: 1e6 + r.integers(0, 4, (n, 2))}[kind]()
    keys = [f"k{i % 61}" if i % 17 else None for i in range(n)]
    for i in range(n):  # a key has one vector
        mat[i] = mat[keys.index(keys[i])]
    among = [i % 5 != 0 for i in range(n)]
    df = spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, mat))], "pos long, key string, vec array<double>")
    found = {x.key: tuple(x)[1:] for x in near_far_counts(df, lo, hi, among=df.filter("pos % 5 <> 0"), by=by).collect()}
    want = counts_plain(keys, mat, lo, hi, among)
    assert set(found) == set(want)
    for k, w in want.items():
        assert found[k][:4] == w[:4] and np.allclose(found[k][4:], w[4:], rtol=1e-12, atol=0), k


def test_bounds_settle_most_pairs_of_clusters(spark):
    r = np.random.default_rng(1)
    mat = r.normal(size=(3000, 8)) * 0.05 + 10 * r.integers(0, 30, (3000, 1))
    df = spark.createDataFrame([(i, f"k{i}", v.tolist()) for i, v in enumerate(mat)], "pos long, key string, vec array<double>").repartition(4)
    shares, counts = {}, {}
    for by in ("pos", "pivot"):
        found = near_far_counts(df, 5.0, 40.0, by=by, with_pairs=True).cache()
        pairs, skipped = found.agg(F.sum("pairs"), F.sum("skipped")).first()
        shares[by], counts[by] = skipped / pairs, sorted(tuple(x)[:5] for x in found.select("key", *distances.COUNTS).collect())
        assert pairs == 3000 * 3000
        found.unpersist()
    assert counts["pos"] == counts["pivot"] and shares["pivot"] > 0.8 > 0.2 > shares["pos"]


def test_counts_take_the_same_jobs_at_any_size(spark):
    taken = []
    for n in (40, 2500):
        df = spark.range(n).selectExpr("id AS pos", "concat('k', id) AS key", "array(double(id % 7), double(id % 3)) AS vec")
        spark.sparkContext.setJobGroup(f"counts-{n}", "counts")
        near_far_counts(df, 1.0, 2.0).count()
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"counts-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(taken[0] - taken[1]) <= 2


def test_zip_length_mismatch_warns(spark):
    from oddone.functions.prompts import TRIPLET_TEMPLATE
    from oddone.operators.vectors import zip_lengths
    from oddone.plans.experiments import stimuli_set
    concepts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, key string")
    matrix = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "row_idx long, vec array<double>")
    assert zip_lengths(concepts, matrix) == {"concept_rows": 3, "matrix_rows": 2, "mismatch": True}
    assert zip_matrix(concepts, matrix).count() == 2
    with pytest.warns(UserWarning, match="the numbers differ"), pytest.warns(UserWarning, match="the draw is empty"):
        st = stimuli_set(concepts, matrix, TRIPLET_TEMPLATE, n_items=3, euclid_min=1e10, euclid_max=0)
    assert st.count() == 0  # c has no vector and a/b each lack a second candidate row


def test_mostly_infeasible_x_keeps_the_law(spark):
    """3 of 5 x values can never succeed: after the first wave their attempts are skipped without
    drawing; the accepted triplets must still follow the law."""
    keys = ["a", "b", "c", "d", "e"]
    vecs = [0.0, 1.0, 2.0, 3.0, 10.0]
    law = exact_law(keys, vecs, 1.5, 8.5)
    assert {k[0] for k in law} == {"a", "b"}
    out = draw_triplets(cand_df(spark, keys, vecs), 2000, 1.5, 8.5, seed=13, draws=4).collect()
    assert len(out) == 2000
    emp = Counter((r.item_x, r.item_y, r.item_z) for r in out)
    for k in set(law) | set(emp):
        assert abs(emp[k] / 2000 - law.get(k, 0.0)) < 0.035, k


def test_null_keys_never_enter_a_triplet(spark):
    keys = ["a", None, "b", "c", None]
    out = draw_triplets(cand_df(spark, keys, [None] * 5), 300, seed=4, use_vectors=False, draws=1).collect()
    assert len(out) == 300
    assert all(None not in (r.item_x, r.item_y, r.item_z) for r in out)


def test_one_feasible_row_among_many(spark):
    """Only the pair (a, b) is near, and everything is far from it: 2 of 400 rows are feasible."""
    keys = [f"k{i}" for i in range(400)]
    vecs = [0.0, 0.5] + [100.0 + 10 * i for i in range(398)]
    out = draw_triplets(cand_df(spark, keys, vecs), 300, 1.0, 50.0, seed=3).collect()
    assert len(out) == 300 and {(r.item_x, r.item_y) for r in out} == {("k0", "k1"), ("k1", "k0")}
    with pytest.raises(RuntimeError, match="attempts allowed"):
        draw_triplets(cand_df(spark, keys, vecs), 300, 1.0, 50.0, seed=3, max_attempts=50)


def test_unconstrained_draw_takes_empty_keys_and_needs_two_rows(spark):
    out = draw_triplets(cand_df(spark, ["a", "", "b"], [None] * 3), 200, seed=4, use_vectors=False).collect()
    assert len(out) == 200 and any("" in (r.item_y, r.item_z) for r in out)
    with pytest.raises(ValueError, match="two rows of other keys"):
        draw_triplets(cand_df(spark, ["a", "b"], [None] * 2), 5, seed=4, use_vectors=False)


def test_subset_ignores_null_keys(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a", None, "b", "c", None])], "row_idx long, key string")
    for seed in range(4):
        assert subset_k(rows, 3, seed=seed).count() == 3 and subset_k(rows, 2, seed=seed).select("key").distinct().count() == 2
    with pytest.raises(ValueError):
        subset_k(rows, 4)
