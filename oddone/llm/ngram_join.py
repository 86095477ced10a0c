"""Similarity join of documents on word n-grams by chosen paths (Jaccard, 5 words, 0.8).

Documents with equal n-gram sets are one set. In each run a set follows paths down a tree of sampled tokens:
at a node, a few of the positions of its min-hash signature are chosen by a hash of the path, and the set
goes on to the child named by the token that it has there, so similar sets share children and others part.
A node with few sets is a leaf and is compared by brute force; so is a *dense* node, whose largest child
still has most of its sets, as splitting it would only multiply the work. The number of runs follows from the
target recall for a pair just at the threshold.

Leaves are compared twice: on signatures, which leaves few sets, then exactly on the n-grams of these. A pair
that shares several leaves is counted in the least of them. Pairs never leave a task: it returns, for each
set, how many documents it is linked with and an edge to one set of its local group. Leaves over ``BLOCK``
sets are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import ready, staged_keys
from oddone.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Probability with which a pair just at the threshold is found: it shares a leaf and passes the signatures there.
TARGET_RECALL = 0.99999
#: Positions of the signature, and those chosen at a node below the root.
POSITIONS, CHOSEN = 64, 2
#: Sets of a leaf at most, levels of the tree below which a node is a leaf whatever it holds, sets of a block.
LEAF, LEVELS, BLOCK = 64, 4, 512
#: Standard deviations by which the signatures of a similar pair may fall short of the threshold, and the positions
#: in which they must agree.
SIGMAS = 6.0
LEAST = math.ceil(POSITIONS * (THRESHOLD - SIGMAS * math.sqrt(THRESHOLD * (1 - THRESHOLD) / POSITIONS)) - 1e-9)
#: Sets whose keys may be broadcast (24 bytes each).
BROADCAST_SETS = 1_000_000

_RANDOM = np.random.RandomState(20240229)
_MULTIPLY = (_RANDOM.randint(0, 1 << 62, POSITIONS, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RANDOM.randint(0, 1 << 62, POSITIONS, np.int64).astype(np.uint64)


def miss(n_runs: int, threshold: float = THRESHOLD, levels: int = LEVELS, least: int = LEAST) -> float:
    """Probability, at most, with which a pair at the threshold is not found in ``n_runs`` runs.

    All runs read one signature, so they are not independent: of its positions, ``agree`` are equal by a binomial law.
    Below ``least`` the pair is dropped. Otherwise some of the runs' roots are equal (hypergeometric), and under each of
    them the pair meets if one of ``CHOSEN`` positions at each further level is.
    """
    out = 0.0
    for agree in range(POSITIONS + 1):
        below = (1 - (1 - agree / POSITIONS) ** CHOSEN) ** (levels - 1)
        lost = 1.0 if agree < least else sum(
            math.comb(agree, roots) * math.comb(POSITIONS - agree, n_runs - roots) * (1 - below) ** roots
            for roots in range(min(agree, n_runs) + 1)) / math.comb(POSITIONS, n_runs)
        out += math.comb(POSITIONS, agree) * threshold ** agree * (1 - threshold) ** (POSITIONS - agree) * lost
    return out


def runs(target: float = TARGET_RECALL, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is found with probability ``target``."""
    for n_runs in range(1, POSITIONS + 1):
        if miss(n_runs, threshold, levels) <= 1 - target:
            return n_runs
    raise ValueError(f"a recall of {target} is out of reach of {POSITIONS} positions")


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``words`` words (lower case, split at ASCII blanks).
    A shorter text with a word has one shingle, all its words; a null or blank text has none."""
    from xxhash import xxh3_64_intdigest

    found = text.lower() if text else ""
    for blank in "\t\n\v\f\r":
        found = found.replace(blank, " ")
    hashes = np.array([xxh3_64_intdigest(w) for w in found.split(" ") if w], np.uint64)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k:len(hashes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(tokens: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        least = np.minimum(least, ((tokens[at:at + 4096, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32).view(np.int32)


def _documents(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, set_key, n, signature`` of each row; the key is null for a text without words."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "set_key", "n", "signature"])

    narrow = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, text_hash long, set_key binary, n long, signature array<int>")


def _leaves(sets: DataFrame, n_runs: int) -> DataFrame:
    """``set_key, leaf`` for the leaves with two sets or more."""
    roots = sets.select("set_key", F.posexplode(F.slice("signature", 1, n_runs)).alias("run", "token"))
    nodes = roots.select("set_key", F.xxhash64("run", "token").alias("node"))
    leaves, signatures = [], sets.select("set_key", "signature")
    for level in range(1, LEVELS + 1):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        nodes = staged_keys(nodes.join(sizes.hint("merge"), "node"), "nodes")
        leaves.append(nodes.filter(F.col("size") <= LEAF).select("set_key", F.col("node").alias("leaf")))
        nodes = nodes.filter(F.col("size") > LEAF)
        if level == LEVELS or nodes.isEmpty():
            leaves.append(nodes.select("set_key", F.col("node").alias("leaf")))
            break
        at = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int") + 1
        child = lambda k: F.xxhash64("node", at(k), F.element_at("signature", at(k)))
        children = staged_keys(nodes.join(signatures.hint("merge"), "set_key").select(
            "set_key", "node", "size", F.explode(F.array(*[child(k) for k in range(CHOSEN)])).alias("child")).distinct(), "children")
        largest = (children.groupBy("node", "size", "child").agg(F.count(F.lit(1)).alias("in_child"))
                   .groupBy("node", "size").agg(F.max("in_child").alias("largest")))
        dense = largest.filter(F.col("largest") * 2 > F.col("size")).select("node")
        leaves.append(nodes.join(dense.hint("merge"), "node", "left_semi").select("set_key", F.col("node").alias("leaf")))
        nodes = children.join(dense.hint("merge"), "node", "left_anti").select("set_key", F.col("child").alias("node"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Adds the blocks ``i <= j`` of a leaf that a row takes part in, and ``side``: the block that it is in. As all joins
    of keyed tables here it merges: small broadcasts of many steps would pile up on the executors."""
    sizes = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = members.join(sizes.hint("merge"), "leaf").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "blocks", "size")
    return dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "set_key")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal ``leaf, i, j``, and the row numbers at which their groups begin and end."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        keys = np.stack([t.column(c).to_numpy() for c in ("leaf", "i", "j")])
        return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1

    for b in batches:
        if b.num_rows:
            held.append(b)
            t = pa.Table.from_batches(held)
            at = cut(t)
            if len(at):
                yield t.slice(0, at[-1]), np.concatenate([[0], at])
                held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.concatenate([[0], cut(t), [t.num_rows]])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))])


def _own(leaf: int, i: int, j: int, side: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a group are to be looked at here: of the two blocks, and with no lesser leaf in common."""
    m = len(side)
    own = np.triu(np.ones((m, m), bool), 1)
    if i != j:
        own &= side[:, None] != side[None, :]
    lesser: dict[int, list[int]] = {}
    for k, path in enumerate(paths):
        for other in path[path < leaf].tolist():
            lesser.setdefault(other, []).append(k)
    for at in lesser.values():
        if len(at) > 1:
            own[np.ix_(at, at)] = False
    return own


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of a leaf that have a similar signature in it, and one of about their size."""
    for t, bounds in _groups(batches):
        leaf, i, j, side, n = (t.column(c).to_numpy() for c in ("leaf", "i", "j", "side", "n"))
        signatures = _lists(t.column("signature"))[0].reshape(-1, POSITIONS)
        paths, at = _lists(t.column("leaves"))
        keep = np.zeros(t.num_rows, bool)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, size = signatures[a:b], n[a:b]
            alike = np.zeros((b - a, b - a), bool)
            for k in range(b - a - 1):
                alike[k, k + 1:] = (s[k + 1:] == s[k]).sum(axis=1) >= LEAST
            alike &= np.minimum.outer(size, size) >= THRESHOLD * np.maximum.outer(size, size) - 1e-9
            if alike.any():
                alike &= _own(leaf[a], i[a], j[a], side[a:b], [paths[at[k]:at[k + 1]] for k in range(a, b)])
                keep[a:b] = alike.any(axis=0) | alike.any(axis=1)
        yield t.select(["set_key", "leaf"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else \
            pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64())], ["set_key", "leaf"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set with a link in its leaf: the documents it is linked with here, and the least set of its group."""
    for t, bounds in _groups(batches):
        leaf, i, j, side, n, times = (t.column(c).to_numpy() for c in ("leaf", "i", "j", "side", "n", "times"))
        keys = t.column("set_key").to_pylist()
        paths, at = _lists(t.column("leaves"))
        tokens, to = _lists(t.column("shingles"))
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            m = b - a
            own = _own(leaf[a], i[a], j[a], side[a:b], [paths[at[k]:at[k + 1]] for k in range(a, b)])
            # numbers for the tokens of the group, and for each token the sets that have it
            _, number = np.unique(tokens[to[a]:to[b]], return_inverse=True)
            holder = np.repeat(np.arange(m), np.diff(to[a:b + 1]))
            order = np.argsort(number, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(number))])
            linked, root = np.zeros(m, np.int64), np.arange(m)
            for k in range(m - 1):
                if not own[k].any():
                    continue
                mine = number[to[a + k] - to[a]:to[a + k + 1] - to[a]]
                begin, count = first[mine], first[mine + 1] - first[mine]
                where = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                common = np.bincount(holder[order[where]], minlength=m)
                hit = own[k] & (common >= THRESHOLD * (n[a + k] + n[a:b] - common) - 1e-9)
                if hit.any():
                    linked[k] += times[a:b][hit].sum()
                    linked[hit] += times[a + k]
                    group = np.unique(np.concatenate([[root[k]], root[hit]]))
                    root[np.isin(root, group)] = group[0]
            for k in np.flatnonzero(linked).tolist():
                out[0].append(keys[a + k])
                out[1].append(keys[a + root[k]])
                out[2].append(int(linked[k]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())],
                                         ["set_key", "root", "links"])


def _classes(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_links, class_id, class_hash``: the last two name the row that stands for the class."""
    spark = ready(docs)
    rows = staged_keys(_documents(docs, words, id_col, text_col), "rows")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"))
    sets = staged_keys(rows.filter("n > 0").groupBy("set_key").agg(
        F.count(F.lit(1)).alias("times"), F.min(row).alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature")), "sets")

    paths = _leaves(sets, runs())
    paths = staged_keys(paths.groupBy("set_key").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "paths")  # bounded: runs x CHOSEN ** levels
    members = sets.join(paths.hint("merge"), "set_key").withColumn("leaf", F.explode("leaves"))
    alike = (_dealt(members.select("leaf", "set_key", "n", "signature", "leaves"))
             .mapInArrow(_similar, "set_key binary, leaf long").distinct())
    alike = staged_keys(alike, "alike")

    wanted = staged_keys(alike.select("set_key").distinct().join(sets.select("set_key", "row", "times", "n").hint("merge"), "set_key")
                    .join(paths.hint("merge"), "set_key"), "wanted")
    first = wanted.select(F.col("row.doc_id").alias("w_id"), F.col("row.text_hash").alias("w_hash"), F.col("set_key").alias("w_key"))
    if wanted.count() <= BROADCAST_SETS:
        first = F.broadcast(first)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(first, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("w_key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["set_key", "shingles"])

    tokens = texts.mapInArrow(cut, "set_key binary, shingles array<long>").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    full = alike.join(wanted.join(tokens.hint("merge"), "set_key").hint("merge"), "set_key")
    found = staged_keys(_dealt(full.select("leaf", "set_key", "n", "times", "leaves", "shingles"))
                   .mapInArrow(_links, "set_key binary, root binary, links long"), "links")

    roots = components(found.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    classed = sets.select("set_key", "times", "row").join(roots.withColumnRenamed("node", "set_key").hint("merge"), "set_key", "left")
    classed = staged_keys(classed.join(links.hint("merge"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "classed")
    heads = classed.groupBy("root").agg(F.min("row").alias("head"))
    classed = classed.join(heads.hint("merge"), "root").select("set_key", "head", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    return rows.select("doc_id", "text_hash", "set_key").join(classed, "set_key", "left").select(
        "doc_id", "text_hash", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("head.text_hash", "text_hash").alias("class_hash"))


def join(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (the least id that links lead to), ``n_links`` (the other
    rows of ``docs`` whose n-grams have a Jaccard similarity of 0.8 or more with this row's, copies included).

    Words are runs of other than ASCII blanks, in lower case; a text with fewer than ``words`` has one n-gram,
    all its words. A null or blank text is linked with nothing. A null id loses to any other as the class's
    id. Repeated rows count as copies. An empty table gives an empty result; other columns are not read.
    """
    return _classes(docs, words, id_col, text_col).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their class: the least id, null ids last,
    then the least hash of the text. Rows repeated with the same id and text stay once; rows without a word stay."""
    classes = staged_keys(_classes(docs, words, id_col, text_col), "classes")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    goes = classes.filter(~stays).select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).distinct()
    kept = docs.withColumn("__hash", F.xxhash64(docs[text_col])).join(
        goes, (F.col("__hash") == F.col("__gone_hash")) & F.col(id_col).eqNullSafe(F.col("__gone_id")), "left_anti")
    repeated = classes.filter(stays).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, "__hash"])
    return kept.drop("__hash")
