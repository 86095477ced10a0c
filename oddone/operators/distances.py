"""Distances between all keys and all candidate rows, without a table of pairs and without the driver.

Rows are packed into blocks, each one row with a matrix (:func:`pack_rows`, :func:`pack_keys`). Key blocks and row
blocks meet in the cells of a grid: a block is copied to the cells of its line, a cell is one Arrow group of two
strips of bounded size, and inside it whole blocks are compared by one matrix product (:func:`block_counts`).
Products are only a first look: pairs too close to a threshold for the product's rounding are computed again from
the difference, so every count is that of the plain formula.

A block knows its centre and how near and far its rows lie from it. By the triangle inequality a key's distance to
the centre often settles all of the block's rows at once; with ``by="pivot"`` rows are packed by their nearest of a
few pivot rows, which makes such blocks the rule where the vectors form clusters.

The counts per key and row block are a rank directory: :func:`pick` finds the k-th near (far, …) row of a key by
the block's running count and one block's distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.functions.hashing import seeded_hash
from oddone.session import ensure_checkpoint_dir, ship_package

#: Rows of a block, bytes of a strip of blocks (a cell holds two), and pivot rows at most.
BLOCK_ROWS, STRIP_BYTES, PIVOTS = 512, 32 << 20, 256
#: Share of the size of two squared norms within which a product decides nothing.
SLACK = 1e-10
COUNTS = ("n_cand", "n_near", "n_far", "n_both")
PACKED = "block long, n int, bytes long, keys array<string>, pos binary, mat binary, centre binary, r_min double, r_max double"


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """The vectors of a list column as rows (no columns if there are none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _sealed(block: int, keys: list, pos: np.ndarray, mat: np.ndarray) -> pa.RecordBatch:
    centre = mat.mean(axis=0) if len(mat) else np.zeros(0)
    r = np.sqrt(((mat - centre) ** 2).sum(axis=1))
    values = (block, len(keys), mat.nbytes + 64 * len(keys), keys, pos.astype("<i8").tobytes(), mat.astype("<f8").tobytes(), centre.tobytes(),
              float(r.min(initial=np.inf)), float(r.max(initial=0.0)))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                      [c.split()[0] for c in PACKED.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch], numbered: bool, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted ``(block, pos, key, vec)`` rows into blocks. ``numbered``: a block is what shares a number; else numbers only
    separate what must not share a block, and blocks are filled up to ``size`` and numbered in the task."""
    from pyspark import TaskContext

    held, at, made = [], None, TaskContext.get().partitionId() << 32

    def seal(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        return _sealed(at if numbered else made, table.column("key").to_pylist(), table.column("pos").to_numpy(), _matrix(table.column("vec"), n))

    for b in batches:
        if not b.num_rows:
            continue
        blocks = b.column(0).to_numpy()
        for a, e in zip((ends := [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)])[:-1], ends[1:]):
            while a < e:
                if held and (blocks[a] != at or sum(x.num_rows for x in held) >= size):
                    yield seal(pa.Table.from_batches(held))
                    held, made = [], made + 1
                at = int(blocks[a])
                take = min(e - a, size - sum(x.num_rows for x in held))
                held.append(b.slice(a, take))
                a += take
    if held:
        yield seal(pa.Table.from_batches(held))


def pack_rows(rows: DataFrame, by: str = "pos", size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the ``(pos, key, vec)`` rows that have a key and a vector: ``by="pos"`` of ``size`` consecutive positions
    each, numbered ``pos div size``; ``by="pivot"`` of at most ``size`` rows near the same pivot, in no lasting order."""
    spark = rows.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = rows.filter("key is not null and vec is not null").select("pos", "key", "vec")
    if by == "pos":
        numbered = rows.select(F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "key", "vec")
        numbered = numbered.repartition("block").sortWithinPartitions("block", "pos")
        return numbered.mapInArrow(lambda it: _pack(it, True, size), PACKED).checkpoint(eager=True)
    pivots = [r["vec"] for r in rows.select("vec", seeded_hash(0, "pivot", F.col("pos")).alias("h")).orderBy("h").limit(PIVOTS).collect()]
    pivot = spark.sparkContext.broadcast(np.array(pivots, np.float64))  # at most PIVOTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivot.value
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(2), b.num_rows)
                d = (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (v @ p.T)
                near = d.argmin(axis=1)
                r = np.sqrt(np.maximum(d[np.arange(len(v)), near], 0))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), pa.array(r), *b.columns], ["block", "r", "pos", "key", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    near = rows.mapInArrow(assign, f"block long, r double, pos long, key string, vec {kind}").checkpoint(eager=True)
    near = near.repartitionByRange("block", "r").sortWithinPartitions("block", "r").select("block", "pos", "key", "vec")
    return near.mapInArrow(lambda it: _pack(it, False, size), PACKED).checkpoint(eager=True)


def pack_keys(keys: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of distinct ``(key, vec)`` rows, of at most ``size`` each, as they lie in their partitions."""
    ship_package(keys.sparkSession)
    ensure_checkpoint_dir(keys.sparkSession)
    flat = keys.filter("key is not null and vec is not null").select(F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"), "key", "vec")
    return flat.mapInArrow(lambda it: _pack(it, False, size), PACKED).checkpoint(eager=True)


class Block:
    """An unpacked block."""

    def __init__(self, row: dict):
        self.number, self.keys = row["block"], row["keys"]
        n = len(self.keys)
        self.pos = np.frombuffer(row["pos"], "<i8")
        self.mat = np.frombuffer(row["mat"], "<f8").reshape(n, -1) if n else np.zeros((0, 0))
        self.norm = (self.mat * self.mat).sum(axis=1)
        self.centre, self.r_min, self.r_max = np.frombuffer(row["centre"]), row["r_min"], row["r_max"]
        self.of: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            self.of.setdefault(k, []).append(i)

    def settled(self, keys: Block, lo: float, hi: float):
        """For each key whether all and whether none of the block's rows are near, and the same for far."""
        d = np.sqrt(((keys.mat - self.centre) ** 2).sum(axis=1))
        slack = 1e-9 * (1 + d + self.r_max)
        low, up = np.maximum(np.maximum(d - self.r_max, self.r_min - d), 0) - slack, d + self.r_max + slack
        return up < lo, low >= lo, low > hi, up <= hi, low, up

    def distances(self, keys: Block, which: np.ndarray, lo: float, hi: float):
        """Squared distances of some keys to all rows, near and far. Distances within rounding of a threshold are exact."""
        k, kn = keys.mat[which], keys.norm[which]
        d2 = kn[:, None] + self.norm - 2 * (k @ self.mat.T)
        slack = SLACK * (1 + kn[:, None] + self.norm)
        near = d2 < lo * lo if lo > 0 else np.zeros(d2.shape, bool)
        far = d2 > hi * hi if hi >= 0 else np.ones(d2.shape, bool)
        unsure = np.zeros(d2.shape, bool)
        for t in (lo, hi):
            if 0 <= t < 1e100:
                unsure |= np.abs(d2 - t * t) <= slack + 1e-12 * t * t
        i, j = np.nonzero(unsure)
        if len(i):
            d = np.sqrt(((k[i] - self.mat[j]) ** 2).sum(axis=1))
            near[i, j], far[i, j] = d < lo, d > hi
        return d2, near, far, slack


def _compare(left: list[Block], right: list[Block], lo: float, hi: float, per_block: bool, extremes: bool) -> pa.Table:
    """The counts of the keys of ``left`` among the rows of ``right``: per key, or per key and block (empty ones left out)."""
    out = {c: [] for c in ("key", "block", *COUNTS, "min_dist", "max_dist", "pairs", "skipped")}
    for keys in left:
        n = len(keys.keys)
        total = np.zeros((4, n), np.int64)
        least, most = np.full(n, np.inf), np.full(n, -np.inf)
        pairs = skipped = 0
        for b in right:
            rows = len(b.keys)
            every_near, no_near, every_far, no_far, low, up = b.settled(keys, lo, hi)
            known = (every_near | no_near) & (every_far | no_far)
            if extremes:
                known &= (low >= least) & (up <= most)
            own = [(i, b.of[k]) for i, k in enumerate(keys.keys) if k in b.of]  # a key's own rows are no candidates
            counts = np.empty((4, n), np.int64)
            counts[0], counts[1], counts[2], counts[3] = rows, every_near * rows, every_far * rows, (every_near & every_far) * rows
            for i, at in own:
                counts[:, i] -= (counts[:, i] > 0) * len(at)
            pairs, skipped = pairs + n * rows, skipped + int(known.sum()) * rows
            which = np.flatnonzero(~known)
            if len(which):
                d2, near, far, slack = b.distances(keys, which, lo, hi)
                valid = np.ones(d2.shape, bool)
                index = {int(w): k for k, w in enumerate(which)}
                for i, at in own:
                    if i in index:
                        valid[index[i], at] = False
                near &= valid
                far &= valid
                counts[1, which], counts[2, which], counts[3, which] = near.sum(axis=1), far.sum(axis=1), (near & far).sum(axis=1)
                if extremes:
                    for sign, best in ((1, least), (-1, most)):  # the ends: all within rounding of the product's are computed again
                        d = np.where(valid, sign * d2, np.inf)
                        i, j = np.nonzero(valid & (d <= d.min(axis=1, initial=np.inf)[:, None] + 2 * slack))
                        exact = np.sqrt(((keys.mat[which[i]] - b.mat[j]) ** 2).sum(axis=1))
                        (np.minimum if sign == 1 else np.maximum).at(best, which[i], exact)
            if per_block:
                some = np.flatnonzero(counts[1:].any(axis=0))
                out["key"] += [keys.keys[i] for i in some]
                out["block"] += [b.number] * len(some)
                for c, v in zip(COUNTS, counts):
                    out[c] += v[some].tolist()
            else:
                total += counts
        if not per_block:
            out["key"] += keys.keys
            for c, v in zip(COUNTS, total):
                out[c] += v.tolist()
            out["min_dist"] += [x if x < np.inf else None for x in least.tolist()]
            out["max_dist"] += [x if x >= 0 else None for x in most.tolist()]
            out["pairs"] += [pairs] + [0] * (n - 1)
            out["skipped"] += [skipped] + [0] * (n - 1)
    long, real = pa.int64(), pa.float64()
    kinds = {"key": pa.string(), "min_dist": real, "max_dist": real}
    names = ["key", "block", *COUNTS] if per_block else ["key", *COUNTS, "min_dist", "max_dist", "pairs", "skipped"]
    return pa.table({c: pa.array(out[c], kinds.get(c, long)) for c in names})


def block_counts(keys: DataFrame, rows: DataFrame, lo: float, hi: float, per_block: bool = False, extremes: bool = True) -> DataFrame:
    """Counts of packed ``keys`` among packed ``rows``: candidate rows (of other keys), near (``d < lo``), far (``d > hi``), both.

    Per key with ``min_dist, max_dist`` and, summed over its block's keys, ``pairs`` and how many of them were ``skipped``
    because their block settled them; with ``per_block`` per key and row block, where any count is not 0. Partial
    sums of one key come from many cells: sum them by ``key``."""
    spark = keys.sparkSession
    strips, sizes = [], [x.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first() for x in (keys, rows)]
    cells = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1  # enough cells for all cores, if there are as many blocks
    for blocks, size in sizes:
        strips.append(max(1, min(blocks, max(cells, math.ceil(size / STRIP_BYTES)))))
    side = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = keys.select("*", side(strips[0]).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(strips[1] - 1))).alias("j"))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(strips[0] - 1))).alias("i"), side(strips[1]).alias("j"))
    lo, hi = float(lo), float(hi)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return _compare([Block(r) for r in a.to_pylist()], [Block(r) for r in b.to_pylist()], lo, hi, per_block, extremes)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"key string, block long, {counts}" if per_block else f"key string, {counts}, min_dist double, max_dist double, pairs long, skipped long"
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, schema)


def pick(picks: DataFrame, rows: DataFrame, lo: float, hi: float, group: int = 20_000) -> DataFrame:
    """``(a, at, pos, key, is_far)`` for ``picks`` = ``(a, x_key, x_vec, role, block, at)``: the ``at``-th row (from 0) of ``block``
    that is, as ``role`` says, ``near``, ``far``, ``both`` or ``farther`` (far and not near) for x. ``a`` names a pick.

    Picks of one block are dealt in groups of about ``group``, each with its copy of the block."""
    salts = picks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    dealt = rows.join(salts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    salted = picks.join(salts, "block").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    lo, hi = float(lo), float(hi)

    def find(a: pa.Table, b: pa.Table) -> pa.Table:
        block, asked = Block(b.to_pylist()[0]), a.to_pylist()
        vectors = {r["x_key"]: r["x_vec"] for r in asked}
        names = list(vectors)
        mat = np.array([vectors[k] for k in names], np.float64).reshape(len(names), -1)
        keys = Block({"block": 0, "keys": names, "pos": b"", "mat": mat.tobytes(), "centre": b"", "r_min": 0.0, "r_max": 0.0})
        _, near, far, _ = block.distances(keys, np.arange(len(names)), lo, hi)
        for i, k in enumerate(names):
            near[i, block.of.get(k, [])] = far[i, block.of.get(k, [])] = False
        index, lists, out = {k: i for i, k in enumerate(names)}, {}, []
        for r in asked:
            i, role = index[r["x_key"]], r["role"]
            if (i, role) not in lists:
                lists[i, role] = np.flatnonzero({"near": near[i], "far": far[i], "both": near[i] & far[i], "farther": far[i] & ~near[i]}[role])
            j = int(lists[i, role][r["at"]])
            out.append((r["a"], int(block.pos[j]), block.keys[j], bool(far[i, j])))
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                        names=["a", "pos", "key", "is_far"])

    return (salted.groupBy("block", "part").cogroup(dealt.groupBy("block", "part"))
            .applyInArrow(find, "a long, pos long, key string, is_far boolean"))
