"""Merkle manifest: against a plain recursive version, at sizes around the tree's and the butterfly's corners."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from oddone.llm import merkle
from oddone.llm.catalog import QUERIES
from oddone.llm.common import table


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(nodes):
    """Root of a list of digests, and for each the siblings and places on its way up."""
    paths = [([], []) for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, (sibs, places) in enumerate(paths):
            a = at[i] // 16 * 16
            run = nodes[a:a + 16]
            places.append(at[i] - a)
            sibs.append([x for k, x in enumerate(run) if k != at[i] - a])
        nodes = [H(*nodes[a:a + 16]) for a in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def fold(node, sibs, places):
    for run, place in zip(sibs, places, strict=True):
        node = H(*run[:place], node, *run[place:])
    return node


def plain(rows):
    """``rows`` of (doc_id, source, lang, n_chars, text) -> the query's rows."""
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4]
        groups.setdefault(r[1], []).append((r[0], H(code(r)), H(code((*r[:4], low)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climb([x[1] for x in groups[g]])
    root, over = climb([trees[g][0] for g in names])
    out = []
    for g, (up_sibs, up_places) in zip(names, over, strict=True):
        for (d, leaf, seen), (sibs, places) in zip(groups[g], trees[g][1], strict=True):
            s, p = sibs + up_sibs, places + up_places
            folded = fold(seen, s, p)
            out.append((d, leaf, trees[g][0], root, H(*[x for run in s for x in run]), folded, folded == root))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[4]))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(docs):
    return merkle.manifest(docs, merkle.FIELDS, {"text": merkle.lower_text_of_fifths(docs)}).select(*COLUMNS)


def test_query_equals_the_plain_version(spark, sf):
    docs = table(spark, sf, "documents").select(*merkle.FIELDS)
    found = QUERIES["op13_merkle"][0](spark, sf).select(*COLUMNS).collect()
    assert key(found) == key(plain(docs.collect()))
    assert 0 < sum(not r["verified"] for r in found) < len(found) / 2


def test_sql_equals_the_plain_version(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.sql()})").fetchall()
    assert key(found) == key(plain(table(spark, sf, "documents").select(*merkle.FIELDS).collect()))


def test_odd_rows(spark, odd):
    found = query(odd).collect()
    assert key(found) == key(plain(odd.select(*merkle.FIELDS).collect()))
    assert query(odd.limit(0)).count() == 0
    one = odd.filter("doc_id = 7")
    r = query(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == H()


@pytest.mark.parametrize("sizes", [[1], [16], [17], [255, 256, 257, 1], [1] * 40, [4095, 4096, 4097]])
def test_sizes(spark, sizes):
    docs = spark.createDataFrame([(i, f"s{g:03}", None, i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)],
                                 "doc_id long, source string, lang string, n_chars long, text string")
    assert key(query(docs).collect()) == key(plain(docs.collect()))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 273, 300, 600])
def test_butterfly(spark, n):
    """Every block ends with the root and its own siblings, whatever the number of blocks; two groups at once."""
    digests = {g: [H(str(g), str(b)) for b in range(m)] for g, m in (("a", n), (None, 3))}
    state = spark.createDataFrame([(g, b, len(d), x) for g, d in digests.items() for b, x in enumerate(d)], "grp string, block long, n long, node string")
    found = merkle.butterfly(state.withColumn("proof", F.array().cast("array<array<string>>"))).collect()
    assert len(found) == n + 3
    for g, d in digests.items():
        root, paths = climb(d)
        mine = {r["block"]: r for r in found if r["grp"] == g}
        assert set(mine) == set(range(len(d)))
        for b, (sibs, _) in enumerate(paths):
            assert mine[b]["node"] == root and [list(x) for x in mine[b]["proof"]] == sibs


def test_block_of_many_blocks(spark, monkeypatch):
    """The whole job over several blocks of a source, some exchange rounds, with proofs that fold by themselves."""
    def one_level(leaves, whole):  # goes to the workers with the functions that call it
        return [leaves, [hashlib.sha256("".join(leaves).encode()).hexdigest()]] if whole or len(leaves) > 1 else [leaves]

    for name, value in (("BLOCK_LEVELS", 1), ("BLOCK", 16), ("tree", one_level)):
        monkeypatch.setattr(merkle, name, value)
    docs = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    found = merkle.manifest(docs, merkle.FIELDS, {"text": merkle.lower_text_of_fifths(docs)}, with_proof=True)
    rows = found.collect()
    assert key([tuple(r[c] for c in COLUMNS) for r in rows]) == key(plain(docs.collect()))
    for r in rows[::97]:
        assert fold(r["leaf"], r["proof"], r["places"]) == r["root"]
