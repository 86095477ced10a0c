"""Item index, triplet mapping, dense ids, exact first-n and the train/test split."""

import math

import pytest
from pyspark.sql import functions as F

from oddone.operators.embedding import item_index, map_lenient, map_strict, split_train_test
from oddone.operators.indexing import dense_index, first_n_by


def test_unresolved_heads_enter_index(spark):
    a = spark.createDataFrame([("a", None, None), ("b", "c", "-1")], "head string, winner string, loser string")
    idx = {r.item: r.id for r in item_index(a).collect()}
    assert idx == {"a": 0, "b": 1, "c": 2}
    assert map_lenient(a, item_index(a)).count() == 0


def test_strict_mapping_raises(spark):
    idx = spark.createDataFrame([("a", 0), ("b", 1)], "item string, id int")
    ok = spark.createDataFrame([("a", "b")], "x string, y string")
    assert map_strict(ok, idx, ["x", "y"]).first().y_id == 1
    bad = spark.createDataFrame([("a", "zzz")], "x string, y string")
    with pytest.raises(Exception, match="without an id"):
        map_strict(bad, idx, ["x", "y"]).collect()


def test_a_large_index_does_not_pass_the_driver(spark):
    """Beyond Spark's own threshold only a small index is broadcast; the ids are the same either way."""
    cols = ["head", "winner", "loser"]

    def plans(n):
        idx = spark.range(0, n).select(F.concat(F.lit("i"), "id").alias("item"), "id")
        a = spark.range(0, 500).select("id", *[F.concat(F.lit("i"), F.pmod(F.col("id") * k, F.lit(n))).alias(c) for k, c in zip((1, 7, 11), cols)])
        open_ = a.withColumn("loser", F.when(F.col("id") % 5 == 0, F.lit("-1")).when(F.col("id") % 5 > 1, F.col("loser")))  # -1, NULL or an item
        strict = map_strict(a, idx, cols).select("id", *[f"{c}_id" for c in cols])
        lenient = map_lenient(open_, idx).select("id", "h", "w", "l")
        for df, kept in ((strict, range(500)), (lenient, [i for i in range(500) if i % 5 > 1])):
            assert sorted(map(tuple, df.collect())) == [(i, i % n, i * 7 % n, i * 11 % n) for i in kept]
            yield df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans(40_000))
        assert all("SortMergeJoin" not in p and p.count("BroadcastHashJoin") >= 3 for p in plans(600))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 1000)
    out = dense_index(df, ["k"], "i").collect()
    assert sorted(r.i for r in out) == list(range(1000))
    assert all(r.i == r.k for r in out)


def test_first_n_by_with_refinement(spark):
    df = spark.range(0, 5000).withColumn("v", (F.col("id") * 104729) % 1000003)
    got = {r.id for r in first_n_by(df, "v", 777, value_bits=20, max_exact=50, fanout_bits=4).collect()}
    want = {r.id for r in df.orderBy("v").limit(777).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_split_sizes(spark, n):
    df = spark.range(0, n).withColumn("key", F.col("id").cast("string"))
    out = split_train_test(df, "key", seed=3)
    assert out.count() == n
    assert out.filter("is_test").count() == math.ceil(0.2 * n)


def test_split_per_group(spark):
    df = spark.range(0, 300).withColumn("key", F.col("id").cast("string")).withColumn("g", F.col("id") % 3)
    counts = {r.g: r["count"] for r in split_train_test(df, "key", group_col="g").filter("is_test").groupBy("g").count().collect()}
    assert counts == {0: 20, 1: 20, 2: 20}


def test_column_index(spark):
    from oddone.operators.embedding import column_index
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "concept string")
    assert {r.item: r.id for r in column_index(df, "concept").collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        column_index(df, "nope")


def test_split_and_dense_ids_under_skew(spark):
    """One group holds two thirds of the rows; the order key's leading column is mostly one value."""
    df = (spark.range(0, 3000).withColumn("g", F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 5))
          .withColumn("key", F.col("id").cast("string")))
    counts = {r.g: r["count"] for r in split_train_test(df, "key", group_col="g").filter("is_test").groupBy("g").count().collect()}
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert counts == {g: math.ceil(0.2 * n) for g, n in sizes.items()}
    lead = df.withColumn("lead", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)))
    ids = dense_index(lead, ["lead", "id"], "i").collect()
    assert sorted(r.i for r in ids) == list(range(3000))
    want = {r.id: k for k, r in enumerate(sorted(ids, key=lambda r: (r.lead, r.id)))}
    assert all(r.i == want[r.id] for r in ids)


def test_split_with_null_groups_and_repeated_keys(spark):
    df = spark.range(0, 100).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), F.lit("same").alias("key"), "id").repartition(5)
    out = split_train_test(df, "key", group_col="g")
    assert out.count() == 100 and set(out.columns) == {"g", "key", "id", "is_test"}
    assert {r.g: r["count"] for r in out.filter("is_test").groupBy("g").count().collect()} == {None: 10, "a": 10}
    keyed = df.withColumn("key", F.when(F.col("id") % 10 == 0, F.lit(None).cast("string")).otherwise((F.col("id") % 7).cast("string")))
    out = split_train_test(keyed, "key", test_size=0.31)
    assert out.filter("is_test").count() == 31 and out.count() == 100


def test_split_refines_the_cut_bucket(spark):
    df = spark.range(0, 2000).withColumn("key", F.col("id").cast("string"))
    plain = {r.id for r in split_train_test(df, "key", seed=3).filter("is_test").collect()}
    assert plain == {r.id for r in split_train_test(df, "key", seed=3, fanout_bits=2, small=1).filter("is_test").collect()}
    assert len(plain) == 400


def test_dense_ids_of_one_large_group_and_null_groups(spark):
    df = spark.range(0, 500).withColumn("g", F.when(F.col("id") < 450, F.lit("big")).when(F.col("id") < 480, F.lit("small")))
    out = dense_index(df, ["id"], "i", partition_cols=["g"], num_partitions=8).collect()
    assert {(r.g, r.i) for r in out} == {("big", i) for i in range(450)} | {("small", i) for i in range(30)} | {(None, i) for i in range(20)}
    assert all(r.i == r.id - {"big": 0, "small": 450, None: 480}[r.g] for r in out)


def test_no_cached_copies_are_left(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    dense_index(spark.range(50), ["id"], "i").count()
    split_train_test(spark.range(50), "id").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
