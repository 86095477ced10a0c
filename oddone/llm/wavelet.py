"""Token ids in binary shards, each a wavelet matrix in one compressed file.

Documents are sorted by id, encoded, and cut into shards of about a million ids. A shard's ids are replaced
by their frequency rank in the shard and stored bit-plane by bit-plane, highest bit first: each plane keeps
the order left by a stable partition on the planes before it, so ``rank`` and ``select`` on the planes give
an id at a position, the number of times an id occurs before a position, and the place of its k-th
occurrence, without decoding the rest. Frequent ids have small ranks, so the high planes are nearly all
zeros and compress well. A file also holds its documents' ids and lengths.

Spark writes the files (one per shard, committed with the job, so a lost executor or a second attempt
leaves none behind) and reads them back as binary files: any file system that Spark knows will do.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddone.llm.common import ready, shared_dir, staged
from oddone.llm.tokens import encoder
from oddone.operators.joins import checked_broadcast

#: magic, partition and number of the shard, ids, distinct ids, documents, bit-planes
HEADER = struct.Struct("<4sIIQIII")
MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
#: Words of a plane whose bits are unpacked at once in a select.
SELECT_WORDS = 1 << 14
SPECIAL = (("<|endoftext|>", 50256),)


class Plane:
    """A bit vector with rank and select, over 64-bit words and the ones before each."""

    def __init__(self, data: bytes, n: int):
        self.n, self.words = n, np.frombuffer(data, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = n - int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to n)."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        word = self.words[np.minimum(w, len(self.words) - 1)] if len(self.words) else np.zeros(len(i), np.uint64)
        return self.before[w] + np.where(r > 0, np.bitwise_count(word & ((np.uint64(1) << r) - np.uint64(1))), 0)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one (or zero), from 0; k ascending or not."""
        before = self.before if one else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), SELECT_WORDS):
            part = k[a:a + SELECT_WORDS]
            w = np.searchsorted(before, part, side="right") - 1
            words = self.words[w] if one else ~self.words[w]
            found = np.cumsum(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1, dtype=np.uint8)
            out[a:a + SELECT_WORDS] = w * 64 + (found <= (part - before[w])[:, None]).sum(axis=1)
        return out


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _section(out: io.BytesIO, data: bytes) -> None:
    small = _squeezed(data)
    out.write(struct.pack("<Q", len(small)))
    out.write(small)


def build(ids: np.ndarray, doc_ids: pa.Array, lengths: np.ndarray, partition: int = 0, number: int = 0) -> bytes:
    """The file of a shard: ``ids`` of its documents one after the other, their ids and numbers of token ids."""
    count = np.bincount(ids)
    alphabet = np.flatnonzero(count)
    alphabet = alphabet[np.argsort(-count[alphabet], kind="stable")].astype("<u4")  # most frequent first, ties: smaller id
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    rank = np.zeros(len(count), np.uint32)
    rank[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    symbols = rank[ids].astype(np.uint16 if levels <= 16 else np.uint32)
    out = io.BytesIO()
    out.write(HEADER.pack(MAGIC, partition, number, len(ids), len(alphabet), len(lengths), levels))
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type), ("n", pa.int64())])) as w:
        w.write_batch(pa.record_batch([doc_ids, pa.array(lengths, pa.int64())], names=["doc_id", "n"]))
    _section(out, sink.getvalue())
    _section(out, alphabet.tobytes())
    for level in reversed(range(levels)):
        bits = (symbols >> level) & 1 == 1
        plane = np.packbits(bits, bitorder="little").tobytes()
        _section(out, plane + bytes(-len(plane) % 8))
        symbols = np.concatenate([symbols[~bits], symbols[bits]])
    return out.getvalue()


class Shard:
    """A shard read from the bytes of its file; planes are unpacked when first needed."""

    def __init__(self, data: bytes):
        magic, self.partition, self.number, self.n, _, _, self.levels = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, self.parts = HEADER.size, []
        for _ in range(2 + self.levels):
            size, = struct.unpack_from("<Q", data, at)
            self.parts.append(memoryview(data)[at + 8:at + 8 + size])
            at += 8 + size
        docs = pa.ipc.open_stream(self._open(0)).read_all().combine_chunks()
        self.doc_ids, self.lengths = docs.column(0).combine_chunks(), docs.column(1).to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.alphabet = np.frombuffer(self._open(1), "<u4")
        self.planes: dict[int, Plane] = {}

    def _open(self, part: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.parts[part])

    def plane(self, level: int) -> Plane:
        if level not in self.planes:
            self.planes[level] = Plane(self._open(2 + level), self.n)
        return self.planes[level]

    def _path(self, token: int) -> list[bool] | None:
        at = np.flatnonzero(self.alphabet == token)
        return [bool(at[0] >> (self.levels - 1 - k) & 1) for k in range(self.levels)] if len(at) else None

    def decode(self) -> np.ndarray:
        """All ids in their order: the planes' partitions undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        symbols = np.zeros(self.n, kind)
        for k in reversed(range(self.levels)):
            p = self.plane(k)
            bits, back = p.bits(), np.empty(self.n, kind)
            back[~bits] = symbols[:p.zeros]
            back[bits] = symbols[p.zeros:] | kind(1 << (self.levels - 1 - k))
            symbols = back
        return self.alphabet[symbols]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The ids at positions ``i``."""
        i, symbols = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            p = self.plane(k)
            bit, ones = p.get(i), p.ones(i)
            symbols = symbols << 1 | bit
            i = np.where(bit, p.zeros + ones, i - ones)
        return self.alphabet[symbols]

    def _range(self, path: list[bool], end: int) -> tuple[int, int]:
        ends = np.array([0, end], np.int64)
        for k, bit in enumerate(path):
            p = self.plane(k)
            ones = p.ones(ends)
            ends = p.zeros + ones if bit else ends - ones
        return int(ends[0]), int(ends[1])

    def rank(self, token: int, end: int | None = None) -> int:
        """How often ``token`` stands before position ``end`` (the whole shard by default)."""
        path = self._path(token)
        if path is None:
            return 0
        lo, hi = self._range(path, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the occurrences ``k`` (from 0) of ``token``."""
        path = self._path(token)
        i = np.asarray(k, np.int64) + self._range(path, self.n)[0]
        for level in reversed(range(self.levels)):
            p = self.plane(level)
            i = p.select(i - p.zeros, True) if path[level] else p.select(i, False)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(n)) if (n := self.rank(token)) else np.zeros(0, np.int64)


def write(docs: DataFrame, path: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, ranks: str = "byte_bpe_50k.tiktoken",
          special: tuple[tuple[str, int], ...] = SPECIAL, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents in ascending id order and write their shards to ``path`` (by default a new folder
    below the shared one); returns the folder.

    A null or empty text is the end id alone. Null ids come first; rows with equal ids stand by their text's
    hash, and repeated rows each by themselves. A document is never cut: a shard closes with the document that
    fills it, so a task holds about ``shard_tokens`` ids and the longest document. An empty table writes no shard.
    """
    spark = ready(docs)
    path = path or f"{shared_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, partition = encoder(ranks, special), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        tokens, held, number, ids = [], 0, 0, []

        def shard() -> pa.RecordBatch:
            data = build(np.frombuffer(b"".join(tokens), "<u4"), pa.concat_arrays(ids), np.array([len(t) // 4 for t in tokens]), partition, number)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for b in batches:
            first = 0
            for k, text in enumerate(b.column(1).to_pylist()):
                t = (enc.encode(text) if text else b"") + end
                tokens.append(t)
                held += len(t) // 4
                if held >= shard_tokens:
                    ids.append(b.column(0).slice(first, k + 1 - first))
                    yield shard()
                    tokens, held, number, ids, first = [], 0, number + 1, [], k + 1
            if first < b.num_rows:
                ids.append(b.column(0).slice(first))
        if tokens:
            yield shard()

    files = narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "value binary")
    # the text writer puts a row's bytes into the file as they are (and a line end, which the lengths inside leave out)
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files of ``path``: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` (with the end id), ``ids_crc32``, read from the decoded files."""
    files = shards(spark, path)
    kind = _id_type(files)
    if kind is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_py())
                ids, d = memoryview(s.decode().astype("<u4").tobytes()), len(s.lengths)
                crc = [zlib.crc32(ids[4 * a:4 * e]) for a, e in zip(s.starts[:-1].tolist(), s.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [s.doc_ids, pa.array([s.partition] * d, pa.int64()), pa.array([s.number] * d, pa.int64()), pa.array(s.starts[:-1]),
                     pa.array(s.lengths), pa.array(crc, pa.int64())], ["doc_id", "part", "shard", "start_in", "n_tokens", "ids_crc32"])

    rows = staged(files.select("content").mapInArrow(run, f"doc_id {kind}, part long, shard long, start_in long, n_tokens long, ids_crc32 long"), "shard-docs")
    totals = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    by_part = totals.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(by_part, "part")
    first = staged(first.select("part", "shard", (F.col("at") + F.col("part_start")).alias("first")), "shard-starts")
    return rows.join(checked_broadcast(first, first.count(), 32), ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("start_in")).alias("start"), "n_tokens", "ids_crc32")


def _id_type(files: DataFrame) -> str | None:
    """SQL type of the document ids, as one file has it."""
    from pyspark.sql.pandas.types import from_arrow_type

    one = files.select("content").head(1)
    return from_arrow_type(Shard(bytes(one[0][0])).doc_ids.type).simpleString() if one else None


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, n`` for each different one of ``tokens``, by rank in each shard."""
    tokens = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([s.rank(t) for t in tokens], pa.int64())], ["token", "n"])

    asked = spark.createDataFrame([(t,) for t in tokens], "token long")
    found = shards(spark, path).select("content").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return asked.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, doc_id, position`` (in the document, from 0) of every occurrence of ``tokens``, by select in each shard."""
    files = shards(spark, path)
    kind = _id_type(files) or "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_py())
                for t in sorted(set(tokens)):
                    at = s.occurrences(t)
                    d = np.searchsorted(s.starts, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int64()), s.doc_ids.take(pa.array(d)), pa.array(at - s.starts[d])],
                                                     ["token", "doc_id", "position"])

    return files.select("content").mapInArrow(run, f"token long, doc_id {kind}, position long")


def access(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, position, token`` for the distinct rows of ``wanted`` (``doc_id, position``) that exist, by access in
    the shards concerned. Positions go to their shard in groups of at most 65,536."""
    files = shards(spark, path)
    kind = _id_type(files) or "long"

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                s = Shard(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(s.lengths)), s.doc_ids, pa.array(s.starts[:-1]), pa.array(s.lengths)],
                                                 ["path", "doc_id", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, data in zip(b.column(0).to_pylist(), b.column(1)):
                s, i = Shard(data.as_py()), np.array(places, np.int64)
                d = np.searchsorted(s.starts, i, side="right") - 1
                yield pa.RecordBatch.from_arrays([s.doc_ids.take(pa.array(d)), pa.array(i - s.starts[d]), pa.array(s.access(i), pa.int64())],
                                                 ["doc_id", "position", "token"])

    directory = files.mapInArrow(where, f"path string, doc_id {kind}, at long, n long")
    placed = (wanted.select("doc_id", "position").distinct().join(directory, "doc_id").filter("position >= 0 and position < n")
              .select("path", (F.col("at") + F.col("position")).alias("i")))
    groups = placed.groupBy("path", F.shiftright("i", 16).alias("g")).agg(F.collect_list("i").alias("places"))
    return groups.join(files, "path").select("places", "content").mapInArrow(run, f"doc_id {kind}, position long, token long").distinct()
