"""Exact and near deduplication against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddone.llm import exact_dedup, ngram_join
from oddone.llm.catalog import QUERIES
from oddone.llm.common import table
from oddone.llm.components import components


# exact

def test_exact_odd_rows(odd):
    found = exact_dedup.dedup(odd).collect()
    assert len(found) == odd.count()
    kept = [r for r in found if r["kept"]]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]
    by = {r["doc_id"]: r for r in found}
    assert by[2]["keep_id"] == 1 and by[2]["group_size"] == 3 and by[4]["keep_id"] == 3 and by[4]["group_size"] == 3
    assert by[5]["keep_id"] == 5  # blanks become one space, which is not the empty text
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def test_exact_keeps_whole_rows_once(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9]


def test_index_persists_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digests_of_a_test", buckets=4)
    new = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    try:
        first = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(new([(5, "a b"), (6, "a  b"), (7, "c")]), index, "one").collect()}
        assert first == {5: (5, True), 6: (5, False), 7: (7, True)}
        second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(new([(1, "a\tb"), (8, "d"), (9, "d")]), index, "two").collect()}
        assert second == {1: (5, False), 8: (8, True), 9: (8, False)}
        assert index.read().count() == 3
        exact_dedup.dedup(new([(8, "d"), (9, "d")]), index, "two")  # a batch given again adds nothing
        assert index.read().count() == 3
        plan = index.read().hint("merge").join(index.read().select("digest"), "digest")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql("DROP TABLE IF EXISTS digests_of_a_test")


def test_batches_meet_in_one_index(spark, sf, odd):
    """One batch or several give the same rows; later batches are anti-joined with the index, which is gone afterwards."""
    for docs in (odd, table(spark, sf, "documents")):
        one, several = (sorted(map(str, exact_dedup.dedup_in_batches(docs, k).collect())) for k in (1, 3))
        assert one == several
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 1000) AS text")
    groups = docs.groupBy(exact_dedup.digest(docs["text"]).alias("digest")).agg(F.min("doc_id").alias("keep_id"))
    try:
        index.append(groups, "0")
        plan = groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        right = plan[:plan.index(f"default.{index.name}")].rsplit("Sort [", 1)[1]  # what stands between the join's sort and the scan
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in right and "Bucketed: true" in plan
        index.append(groups, "1")
        assert index.read().count() == 1000
    finally:
        index.drop()


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    docs = spark.range(100).selectExpr("1L AS doc_id", "'same' AS text").unionByName(spark.createDataFrame([(2, "same"), (3, "other")], "doc_id long, text string"))
    rows = exact_dedup.dedup(docs).collect()
    assert len(rows) == 102 and sum(r["kept"] for r in rows) == 2 and {r["group_size"] for r in rows if r["doc_id"] < 3} == {101}


def test_own_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "doc_id long, text string, __digest0 string, __keep int")
    assert exact_dedup.keep_first(docs).collect() == [(1, "a", "x", 5)]


def test_hot_group_and_rest_agree(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"t{i % 50}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(exact_dedup.dedup(docs).collect())
    monkeypatch.setattr(exact_dedup, "HOT", 10)
    assert sorted(exact_dedup.dedup(docs).collect()) == plain
    assert sum(r["kept"] for r in plain) == len({t for _, t in rows})


# components

def test_components_against_union_find(spark):
    random_ = random.Random(1)
    for n, m in ((40, 30), (60, 60), (30, 0)):
        edges = [(random_.randrange(n), random_.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        loops = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
        assert found == {x: find(x) for x in parent if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# near

def plain_join(rows):
    """Class and links of each row by comparing all sets."""
    sets = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        if words:
            sets[frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))].append(at)
    keys, links, parent = list(sets), defaultdict(int), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for x in sets[a]:
            links[x] += len(sets[a]) - 1
            parent[find(x)] = find(sets[a][0])
        for b in keys[:i]:
            common = len(a & b)
            if common >= 0.8 * (len(a) + len(b) - common) - 1e-9:
                for x in sets[a]:
                    links[x] += len(sets[b])
                for x in sets[b]:
                    links[x] += len(sets[a])
                parent[find(sets[a][0])] = find(sets[b][0])
    least = defaultdict(list)
    for at in range(len(rows)):
        least[find(at)].append(rows[at][0])
    return [(i, min((x for x in least[find(at)] if x is not None), default=None), links[at]) for at, (i, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def family(seed, copies, words=300, changes=3):
    """Near copies of one text, each with a few words changed."""
    random_ = random.Random(seed)
    base = [f"w{random_.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        new = list(base)
        for _ in range(random_.randint(0, changes)):
            new[random_.randrange(words)] = f"v{random_.randrange(10_000)}"
        out.append(" ".join(new))
    return out


def test_join_against_all_pairs(spark):
    common = " ".join(f"c{k}" for k in range(60))  # a passage that many texts share
    random_ = random.Random(9)
    texts = [t for s in range(6) for t in family(s, 12, changes=6)] + family(77, 150)
    texts += [common + " " + " ".join(f"u{random_.randrange(10**6)}" for _ in range(random_.randint(5, 200))) for _ in range(250)]
    texts += [texts[0]] * 5 + ["one two", "One  two", "one two three", "", None, None, "lone"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(map(tuple, found)) == order(plain_join(rows))


def test_join_in_blocks_and_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    rows = list(enumerate(family(5, 70) + family(6, 20, changes=8)))
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(map(tuple, found)) == order(plain_join(rows))


def test_join_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert order(map(tuple, QUERIES["op6_ngram_join"][0](spark, sf).collect())) == order(plain_join(rows))


def test_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0)
    rows = list(enumerate(family(5, 10) + ["a b c d e f"]))
    assert order(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == order(plain_join(rows))


def test_join_odd_rows(odd):
    found = order(map(tuple, ngram_join.join(odd).collect()))
    assert found == order(plain_join([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_keep_one_row_of_a_class(spark, odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    docs = spark.createDataFrame(list(enumerate(family(3, 20) + ["clean text of its own"])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [0, 20]


@pytest.mark.parametrize("text", [None, "", " \t\n"])
def test_shingles_of_nothing(text):
    assert len(ngram_join.shingles(text)) == 0


def test_runs_follow_the_recall():
    assert ngram_join.runs(0.9) < ngram_join.runs(0.99999) <= ngram_join.POSITIONS


@pytest.mark.parametrize("seed", [1992, 36602])
def test_a_pair_whose_signatures_agree_in_few_positions(spark, seed):
    random_ = random.Random(seed)
    w = [f"w{random_.randrange(10**6)}" for _ in range(14)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w[:12] + w[13:]))]  # 8 of 10 n-grams in common
    a, b = (ngram_join.signature(ngram_join.shingles(t)) for _, t in rows)
    assert (a == b).sum() < 39
    assert sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_the_miss_counts_every_filter():
    assert ngram_join.miss(ngram_join.runs()) <= 1 - ngram_join.TARGET_RECALL < ngram_join.miss(ngram_join.runs() - 1)
    assert ngram_join.miss(ngram_join.runs(), least=39) > 1.2e-4
    random_ = np.random.RandomState(3)  # runs over one signature, drawn: agreeing positions, then paths
    n, runs = 200_000, 3
    agree = random_.rand(n, ngram_join.POSITIONS) < 0.8
    share = agree.mean(axis=1)[:, None]
    met = agree[:, :runs] & (random_.rand(n, runs) < (1 - (1 - share) ** 2) ** 3)
    assert abs((~met.any(axis=1)).mean() - ngram_join.miss(runs)) < 1.5e-3
