"""Token shards: the wavelet matrix against the plain array, files against the library's ids, odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from oddone.llm import packing, token_counts, wavelet
from oddone.llm.catalog import QUERIES
from oddone.llm.common import table


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 3), min_size=1, max_size=400), st.integers(0, 400))
def test_wavelet_equals_the_array(ids, end):
    a = np.array(ids, np.uint32)
    cut, end = len(a) // 3, min(end, len(a))
    s = wavelet.Shard(wavelet.build(a, pa.array([5, None]), np.array([cut, len(a) - cut]), 2, 9) + b"\n")
    assert (s.partition, s.number, s.n, s.doc_ids.to_pylist(), s.lengths.tolist()) == (2, 9, len(a), [5, None], [cut, len(a) - cut])
    assert (s.decode() == a).all() and (s.access(np.arange(len(a))[::-1]) == a[::-1]).all()
    for t in {*ids[:5], 70_001}:
        at = np.flatnonzero(a == t)
        assert (s.occurrences(t) == at).all() and s.rank(t) == len(at) and s.rank(t, end) == (a[:end] == t).sum()


def test_shard_files_equal_the_library(spark, sf, library):
    docs = sorted(table(spark, sf, "documents").select("doc_id", "text").collect())
    found = {r["doc_id"]: r for r in QUERIES["op11_token_shards"][0](spark, sf).collect()}
    start = 0
    assert len(found) == len(docs)
    for d, text in docs:
        ids = [*library(text), 2]
        r = found[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_lookups_over_small_shards(spark, sf, library):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = wavelet.write(docs, shard_tokens=3000)
    assert wavelet.shards(spark, path).count() > 5
    ids = {d: [*library(t), 2] for d, t in docs.collect()}
    asked = [2, 262, 13, 50_255]
    assert {tuple(r) for r in wavelet.counts(spark, path, [*asked, 13]).collect()} == {(t, sum(i.count(t) for i in ids.values())) for t in asked}
    places = {(r["token"], r["doc_id"], r["position"]) for r in wavelet.occurrences(spark, path, asked).collect()}
    assert places == {(v, d, k) for d, i in ids.items() for k, v in enumerate(i) if v in asked}
    some = [(d, k) for d, i in ids.items() for k in (0, len(i) // 2, len(i) - 1, len(i))]
    got = {(r["doc_id"], r["position"]): r["token"] for r in wavelet.access(spark, path, spark.createDataFrame(some, "doc_id long, position long")).collect()}
    assert got == {(d, k): ids[d][k] for d, k in some if k < len(ids[d])}
    found = wavelet.documents(spark, path).orderBy("doc_id").collect()
    assert [r["start"] for r in found] == np.cumsum([0, *[len(ids[r["doc_id"]]) for r in found[:-1]]]).tolist()


def test_shards_odd_rows(spark, odd, library):
    found = wavelet.documents(spark, wavelet.write(odd, shard_tokens=50)).orderBy("start").collect()
    want = [(r["doc_id"], [*library(r["text"]), 2]) for r in odd.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(
        (d is not None, d or 0, len(i), crc(i)) for d, i in want)
    starts = np.cumsum([0, *[r["n_tokens"] for r in found]])
    assert [r["start"] for r in found] == starts[:-1].tolist()
    given_ids = [r["doc_id"] for r in found]
    assert given_ids == sorted(given_ids, key=lambda d: (d is not None, d))  # null ids first
    empty = wavelet.write(odd.limit(0))
    assert wavelet.documents(spark, empty).count() == 0 and wavelet.occurrences(spark, empty, [2]).count() == 0
    assert wavelet.counts(spark, empty, [2]).collect() == [(2, 0)]


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", " ", "\r\n"])
def test_runs_of_two_million_characters(spark, library, run):
    """Runs that overflow a backtracking pattern engine, alone and inside text: all three token operators."""
    long = run * (2_000_000 // len(run))
    docs = spark.createDataFrame([(1, long), (2, f"ab{long}cd <|endoftext|> e"), (3, "plain text")], "doc_id long, text string")
    ids = {d: library(t) for d, t in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs).collect()} == {d: len(i) for d, i in ids.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in wavelet.documents(spark, wavelet.write(docs)).collect()} == {d: crc([*i, 2]) for d, i in ids.items()}
    pieces = sorted(packing.pack(docs, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"]))
    for d, i in ids.items():
        assert [x for r in pieces if r["doc_id"] == d for x in r["ids"]] == [*i, 1]
