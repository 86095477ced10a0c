"""Phrase collocations: against a plain version, with tiny tries that burst and spill, odd rows, exact arithmetic."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from oddone.llm import phrases
from oddone.llm.catalog import QUERIES
from oddone.llm.common import table

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, min_count=30, longest=4, top=2000):
    """``rows`` of (lang, text), by counters."""
    f = {}
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts.update(zip(*[words[k:] for k in range(m)]))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        covered = Counter()
        for p, c in candidates.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    covered[p[k:k + m]] = max(covered[p[k:k + m]], c)
        found = []
        for p, a in candidates.items():
            if 100 * covered[p] >= 80 * a and covered[p]:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def of(docs):
    return [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]


def test_query_equals_the_plain_version_and_sql(spark, sf):
    want = plain(of(table(spark, sf, "documents")))
    assert len(want) > 30 and rows(QUERIES["op12_phrases"][0](spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({phrases.sql()})").fetchall()) == want


@pytest.mark.parametrize("entries, burst", [(50, 4), (1000, 2)])
def test_small_tries_burst_and_spill(spark, entries, burst):
    r = random.Random(entries)
    words = ["the", "of", "New", "york", "été", "x1", "a b", "\x1c", "(c)"]
    texts = [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(r.randrange(80))))
             for _ in range(120)]
    texts += [("en", "New York New York the of" * 3)] * 12
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    for least in (2, 5):
        found = phrases.collocations(docs, min_count=least, top=50, entries=entries, burst=burst)
        assert rows(found) == plain(texts, least, top=50)
    assert rows(phrases.collocations(docs, min_count=3, longest=2, entries=entries, burst=burst)) == plain(texts, 3, 2)
    assert rows(phrases.collocations(docs, min_count=3, longest=3, entries=entries, burst=burst)) == plain(texts, 3, 3)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_trie_counts_and_leaves_whole_subtrees(n):
    r = np.random.default_rng(n)
    trie, want, left = phrases.Trie(n, burst=5), Counter(), Counter()

    def take(keep):
        columns, counts = trie.leave(keep)
        for *k, c in zip(*[x.tolist() for x in columns], counts.tolist()):
            left[tuple(k)] += c
        return set(columns[0].tolist())

    for _ in range(50):
        batch = r.integers(1, 6, (60, n)) * r.choice([1, 1, (1 << phrases.ID_BITS) // 8], (60, n))
        trie.add(list(batch.T))
        want.update(map(tuple, batch.tolist()))
        if trie.size > 60:
            gone = take(30)
            assert gone and trie.size <= 30 and not gone & set(trie.root)
    assert n == 2 or any(type(x) is phrases.Node for x in trie.root.values())
    take(0)
    assert left == want and trie.size == 0 and not trie.root


def test_small_chunks_and_few_words_at_a_time(spark, monkeypatch):
    """Chunks, word tables and ids that start afresh within a task (the driver's values travel with the functions)."""
    r = random.Random(8)
    texts = [(r.choice(["en", "de"]), " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(50)) + ".") for _ in range(1500)]
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    for name, value in (("CHUNK", 300), ("WORDS", 200)):
        monkeypatch.setattr(phrases, name, value)
    assert phrases.collocations(docs, min_count=4).count() == len(plain(texts, 4)) > 20
    monkeypatch.undo()
    assert rows(phrases.collocations(docs, min_count=4)) == plain(texts, 4)


def test_full_sieve_changes_no_count(spark, monkeypatch):
    """A bitmap too small for its phrases lets most through; the counts stay the same."""
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    r = random.Random(3)
    texts = [("en", " ".join(f"w{int(r.paretovariate(0.6)) % 9000}" for _ in range(60))) for _ in range(400)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert rows(phrases.collocations(docs, min_count=4)) == plain(texts, 4)


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    real = phrases.word_hash
    monkeypatch.setattr(phrases, "word_hash", lambda lang, word, seed: 77 if seed == 0 and word in (b"a", b"b") else real(lang, word, seed))
    texts = [("en", "a b a c b c")] * 40
    assert rows(phrases.collocations(spark.createDataFrame(texts, "lang string, text string"))) == plain(texts)


def test_ties_are_cut_by_the_phrase(spark):
    texts = [("en", f"a{k} b{k}") for k in range(30)] * 30
    found = rows(phrases.collocations(spark.createDataFrame(texts, "lang string, text string"), top=7))
    assert found == plain(texts, top=7) and len(found) == 7


def test_odd_rows(spark, odd):
    found = phrases.collocations(odd, min_count=2)
    assert rows(found) == plain(of(odd), 2)
    assert phrases.collocations(odd).count() == len(plain(of(odd)))
    assert phrases.collocations(odd.limit(0)).count() == 0
    hot = spark.createDataFrame([(None, "to be or not to be " * 20_000)], "lang string, text string")
    assert rows(phrases.collocations(hot)) == plain(of(hot))
