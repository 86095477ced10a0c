"""Merkle manifest of a table: a hash tree per group, a tree over the groups' roots, and a proof for each row.

The sorted leaves of a group are cut into aligned blocks of 4,096, which one task hashes by itself. Above
the blocks the trees grow by a butterfly exchange: in round r each block holds the root of the subtree of
16**r blocks that it lies in, and swaps it with the blocks of the other subtrees of its aligned group of 16
that have its own place in theirs. All blocks of the group then hash the same parent. After the last round
every block holds its group's root and the siblings on its way there; nothing is sent down again. Where the
last subtree is short, its blocks serve the missing places in turn. Rounds move one digest of a block 16
times at most, and every group, however large, advances in the same rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import ready, staged, staged_keys
from oddone.operators.indexing import dense_index
from oddone.operators.joins import checked_broadcast

#: Children of a node (2**FAN_BITS) and levels that a block hashes by itself.
FAN_BITS, BLOCK_LEVELS = 4, 3
FANOUT = 1 << FAN_BITS
BLOCK = FANOUT ** BLOCK_LEVELS
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block, leaves first. ``whole``: the group has more blocks, so every level is hashed, even of one node."""
    levels = [leaves]
    while len(levels) <= BLOCK_LEVELS and (whole or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([h(below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return levels


def butterfly(state: DataFrame) -> DataFrame:
    """``grp, block, n`` (blocks of the group), ``node``, ``proof`` -> the same with the group's root as ``node`` and
    the siblings' digests of each level, left to right, appended to ``proof``. Blocks are numbered from 0."""
    most = state.agg(F.max("n")).first()[0] or 0
    span, shift = 1, 0
    while span < most:
        nodes = F.ceil(F.col("n") / F.lit(span)).cast("long")

        def size(j: Column) -> Column:
            """Blocks in subtree j."""
            return F.least(F.lit(span).cast("long"), F.col("n") - j * span)

        mine = F.shiftright("block", shift)
        first = F.shiftleft(F.shiftright(mine, FAN_BITS), FAN_BITS)
        last = F.least(first + FANOUT, nodes) - 1

        def partners(j: Column) -> Column:
            """Blocks of subtree j whose place, counted round in mine, is this block's."""
            there = F.transform(F.sequence(F.col("off"), size(j) - 1, F.col("sz")), lambda o: j * span + o)
            return F.when(j == F.col("q"), F.array(F.col("block"))).when(F.col("off") < size(j), there).otherwise(F.array().cast("array<bigint>"))

        sent = (state.withColumn("q", mine).withColumn("off", F.col("block") - F.col("q") * span).withColumn("sz", size(F.col("q")))
                .withColumn("dest", F.explode(F.flatten(F.transform(F.sequence(first, last), partners)))))
        own = F.col("dest") == F.col("block")
        got = sent.select("grp", F.col("dest").alias("block"), "n", F.struct("q", "node").alias("part"), own.alias("own"), F.when(own, F.col("proof")).alias("proof"))
        got = got.groupBy("grp", "block").agg(F.max("n").alias("n"), F.max_by("proof", "own").alias("proof"), F.array_sort(F.collect_list("part")).alias("run"))
        others = F.transform(F.filter("run", lambda p: p["q"] != mine), lambda p: p["node"])
        live = F.col("n") > span  # the group has more than one node on this level
        parent = F.sha2(F.array_join(F.col("run.node"), "").cast("binary"), 256)
        state = got.select("grp", "block", "n", F.when(live, parent).otherwise(F.col("run.node")[0]).alias("node"),
                           F.when(live, F.concat("proof", F.array(others))).otherwise(F.col("proof")).alias("proof"))
        span, shift = span * FANOUT, shift + FAN_BITS
    return state


def _numbered(blocks: Iterator[pa.RecordBatch], columns: int):
    """The rows of each (group, block) of sorted batches: ``group, block, [column values]``."""
    at, held = None, [[] for _ in range(columns)]
    for b in blocks:
        lists = [c.to_pylist() for c in b.columns]
        for row in zip(*lists, strict=True):
            if (row[0], row[1]) != at:
                if at is not None:
                    yield *at, held
                at, held = (row[0], row[1]), [[] for _ in range(columns)]
            for c, v in zip(held, row[2:], strict=True):
                c.append(v)
    if at is not None:
        yield *at, held


def manifest(docs: DataFrame, fields: list[str], found: dict[str, Column] | None = None, group_col: str = "source", id_col: str = "doc_id",
             with_proof: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf`` (digest of ``fields``), ``subroot`` (of its group), ``root``,
    ``proof_sha256`` (of all siblings on the way from the leaf to the root), ``folded_root`` and ``verified``.

    The root is folded from the leaf of the fields as ``found`` (a column for each field that may have changed;
    the fields themselves by default) and the siblings; a row is verified if that gives ``root``. With
    ``with_proof`` also ``proof`` (siblings by level) and ``places`` (where the row's own node stands among them).

    A group's leaves ascend by id, then by digest (equal ids, repeated rows); null ids come first. A null group is a
    group, the first one; groups are ordered by UTF-8 bytes. Null fields have a code of their own. An empty table gives
    an empty result; other columns are not read.
    """
    ready(docs)
    was = [docs[c] for c in fields]
    now = [(found or {}).get(c, docs[c]) for c in fields]
    rows = docs.select(docs[group_col].alias("grp"), docs[id_col].alias("id"), F.unhex(leaf(was)).alias("leaf"), F.unhex(leaf(now)).alias("seen"))
    rows = staged_keys(rows.withColumn("seen", F.when(F.col("seen") != F.col("leaf"), F.col("seen"))), "leaves")  # texts are read once
    rows = dense_index(rows, ["id", "leaf"], "idx", partition_cols=["grp"])
    rows = rows.select("grp", F.shiftright("idx", FAN_BITS * BLOCK_LEVELS).alias("block"), F.pmod("idx", F.lit(BLOCK)).alias("place"), "id", "leaf", "seen")
    kind = rows.schema["id"].dataType.simpleString()

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        for grp, block, (leaves,) in _numbered(batches, 1):
            levels = tree([x.hex() for x in leaves], block > 0)
            for c, v in zip(out, (grp, block, levels[-1][0]), strict=True):
                c.append(v)
            if len(out[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["grp", "block", "node"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["grp", "block", "node"])

    rows = rows.withColumn("grp", F.col("grp").cast("string"))
    keys = ["grp", "block"]
    blocks = rows.repartition(*keys).sortWithinPartitions(*keys, "place").select("grp", "block", "leaf").mapInArrow(tops, "grp string, block long, node string")
    blocks = staged(blocks, "blocks")  # one row per 4,096 leaves, and one per small group
    sizes = blocks.groupBy("grp").agg((F.max("block") + 1).alias("n")).withColumnRenamed("grp", "g")
    n_groups = sizes.count()
    none = F.array().cast("array<array<string>>")
    state = blocks.join(checked_broadcast(sizes, n_groups, 128), F.col("grp").eqNullSafe(F.col("g"))).select("grp", "block", "n", "node", none.alias("proof"))
    state = staged(butterfly(state), "subroots")
    top = dense_index(state.filter("block = 0").select("grp", "node"), ["grp"], "at")
    top = staged(top.select(F.col("grp").alias("name"), F.col("at").alias("block"), F.lit(0).alias("grp"), F.lit(n_groups).cast("long").alias("n"), "node", none.alias("proof")), "groups")
    roots = butterfly(top.drop("name")).select("block", F.col("node").alias("root"), F.col("proof").alias("over"))
    roots = top.select("name", "block").join(roots, "block").withColumnRenamed("block", "at")
    state = state.join(checked_broadcast(roots, n_groups, 4096), F.col("grp").eqNullSafe(F.col("name")))
    info = F.struct("n", F.col("node").alias("subroot"), "proof", "at", "root", "over")
    heads = state.select("grp", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("binary").alias("leaf"),
                         F.lit(None).cast("binary").alias("seen"), info.alias("info"))
    both = rows.withColumn("info", F.lit(None).cast(heads.schema["info"].dataType)).unionByName(heads)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def typed(batches):
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("id").type
                yield b

        for _, block, (ids, leaves, seen, heads) in _numbered(typed(batches), 4):
            head, leaves, ids, seen = heads[0], [x.hex() for x in leaves[1:]], ids[1:], seen[1:]  # the block's own row comes first
            levels = tree(leaves, head["n"] > 1)[:-1]
            upper = [(b >> FAN_BITS * r & FANOUT - 1, sibs) for b, proof in ((block, head["proof"]), (head["at"], head["over"])) for r, sibs in enumerate(proof)]
            above = "".join(x for _, sibs in upper for x in sibs)
            over = {0: above}  # siblings from a node of the level up, in order
            for level in reversed(levels[1:]):
                over = {k: "".join(level[a:k] + level[k + 1:a + FANOUT]) + over[k >> FAN_BITS] for k in range(len(level)) for a in (k & -FANOUT,)}
            out = {c: [] for c in ("proof_sha256", "folded_root", "proof", "places")}
            for i in range(len(leaves)):
                node, k, path = seen[i].hex() if seen[i] is not None else leaves[i], i, []
                for level in levels:
                    a = k & -FANOUT
                    path.append((k - a, level[a:k] + level[k + 1:a + FANOUT]))
                    k >>= FAN_BITS
                path += upper
                out["proof_sha256"].append(hashlib.sha256(("".join(path[0][1]) + over[i >> FAN_BITS] if levels else above).encode()).hexdigest())
                for place, sibs in path:
                    node = h([*sibs[:place], node, *sibs[place:]])
                out["folded_root"].append(node)
                if with_proof:
                    out["proof"].append([sibs for _, sibs in path])
                    out["places"].append([place for place, _ in path])
            n = len(leaves)
            columns = {"doc_id": pa.array(ids, id_type), "leaf": pa.array(leaves), "subroot": pa.array([head["subroot"]] * n), "root": pa.array([head["root"]] * n),
                       "proof_sha256": pa.array(out["proof_sha256"]), "folded_root": pa.array(out["folded_root"]),
                       "verified": pa.array([r == head["root"] for r in out["folded_root"]])}
            if with_proof:
                columns |= {"proof": pa.array(out["proof"], pa.list_(pa.list_(pa.string()))), "places": pa.array(out["places"], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    both = both.repartition(*keys).sortWithinPartitions(*keys, "place").select("grp", "block", "id", "leaf", "seen", "info")
    return both.mapInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
                                  + ", proof array<array<string>>, places array<int>" * with_proof)


def lower_text_of_fifths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with A-Z in lower case where 5 divides the crc32 of the decimal id, else as it is."""
    hit = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(docs[text_col], A_TO_Z, A_TO_Z.lower())).otherwise(docs[text_col])


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sql(levels: int = 5, group_levels: int = 3) -> str:
    """The query in DuckDB's SQL, its levels written out: enough for 16**levels rows of a source and 16**group_levels sources."""

    def code(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(code(text if c == "text" else c) for c in FIELDS) + ")"

    low = f"CASE WHEN crc % 5 = 0 THEN translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}') ELSE text END"
    # crc32 bit by bit: DuckDB has no function for it
    byte = "range(8)"
    step = f"list_reduce(list_prepend(xor(c, ord(x)::UBIGINT), list_transform({byte}, lambda k: k::UBIGINT)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)"
    out = [f"""WITH RECURSIVE crcs AS (
  SELECT DISTINCT doc_id AS id, CAST(doc_id AS VARCHAR) AS rest, 4294967295::UBIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT id, substr(rest, 2), {step} FROM (SELECT id, rest, c, left(rest, 1) AS x FROM crcs WHERE rest <> '')),
d AS (SELECT documents.*, (SELECT any_value(xor(c, 4294967295::UBIGINT)) FROM crcs WHERE id = doc_id AND rest = '') AS crc FROM documents),
l AS (SELECT doc_id, source, {digest('text')} AS leaf, {digest('(' + low + ')')} AS seen FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
n0 AS (SELECT source AS g, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM r)"""]

    def level(name: str, k: int) -> str:
        up = f"""{name}{k}r AS (SELECT g, i // 16 AS p, list(h ORDER BY i) AS run, max(n) AS n FROM {name}{k} GROUP BY g, i // 16),
{name}{k + 1} AS (SELECT g, p AS i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, (n + 15) // 16 AS n FROM {name}{k}r)"""
        return up

    out += [level("n", k) for k in range(levels)]
    out.append(f"s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i FROM n{levels})")
    out.append("t0 AS (SELECT 0 AS g, i, subroot AS h, count(*) OVER () AS n FROM s)")
    out += [level("t", k) for k in range(group_levels)]
    out.append(f"f0 AS (SELECT r.doc_id, r.source, r.leaf, r.i, s.i AS si, s.subroot, r.seen AS fold, '' AS proof FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source)")
    names = [("n", k, "i", "n.g IS NOT DISTINCT FROM f.source") for k in range(levels)] + [("t", k, "si", "true") for k in range(group_levels)]
    for at, (name, k, i, same) in enumerate(names):
        place = f"(f.{i} % 16)"
        out.append(f"""f{at + 1} AS (SELECT f.doc_id, f.source, f.leaf, {'f.i // 16' if i == 'i' else 'f.i'} AS i, {'f.si // 16' if i == 'si' else 'f.si'} AS si, f.subroot,
  CASE WHEN n.n > 1 THEN sha256(array_to_string(n.run[:{place}], '') || f.fold || array_to_string(n.run[{place} + 2:], '')) ELSE f.fold END AS fold,
  CASE WHEN n.n > 1 THEN f.proof || array_to_string(n.run[:{place}], '') || array_to_string(n.run[{place} + 2:], '') ELSE f.proof END AS proof
  FROM f{at} f JOIN {name}{k}r n ON {same} AND n.p = f.{i} // 16)""")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM f{len(names)}, t{group_levels}"""
