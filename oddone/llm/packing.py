"""Cost-balanced packing of tokenised documents into sequences of fixed length.

The cost of a piece is estimated as linear in its tokens (matrix products) plus quadratic (attention). Each
task packs the documents of its own partition, block by block: pieces go, longest first, to the cheapest
sequence that still holds them. A block opens just as many sequences as its tokens fill, and a piece that no
sequence holds whole is cut at the free space of the cheapest one. What is over the last full sequence of a
block goes on to the next block; what a task has over at its end, less than a sequence, is dealt anew with what
the others have over. So padding does not depend on how many partitions the documents lie in: it is less than a
sequence for each million tokens dealt anew. A task holds one block at a time, and only those rests are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import ready, staged
from oddone.llm.tokens import encoder

#: Cost of a piece of n tokens: n + QUADRATIC * n * n. At 1/2048 a full sequence of one piece costs twice its linear part.
QUADRATIC = 1 / 2048


def assign(lengths: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """Pack documents of the given token counts; returns ``(document, start, length, sequence)`` pieces,
    each sequence's pieces in the order in which they stand there.

    Documents longer than a sequence first give up whole sequences from their start. The rest goes, longest
    first (ties: document order), to the cheapest sequence with room (ties: lowest number).
    """
    pieces, full, rest = [], 0, []
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, full + k))
        full += whole
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(r[0] for r in rest)
    count = -(-total // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    for n, d, start in rest:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if room[s] < n:  # whole in none: cut at the room of the cheapest
                s = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n, int(room[s]))
            pieces.append((d, start, part, full + s))
            cost[s] += part + quadratic * part * part
            room[s] -= part
            n, start = n - part, start + part
    return pieces


#: Bit of the sequence ids of pieces dealt anew.
ANEW = 1 << 62


def split_rest(items: list[tuple], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """``(id, start, doc_tokens, ids)`` items that fill whole sequences, and the rest: the last items, one of them cut."""
    over, rest = sum(len(i[3]) // 4 for i in items) % capacity, []
    items = list(items)
    while over:
        doc, start, n, ids = items.pop()
        here = len(ids) // 4
        if here > over:
            items.append((doc, start, n, ids[:4 * (here - over)]))
            rest.append((doc, start + here - over, n, ids[4 * (here - over):]))
            over = 0
        else:
            rest.append((doc, start, n, ids))
            over -= here
    return items, rest


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, block_tokens: int = 1 << 20, with_ids: bool = False,
         ranks: str = "byte_bpe_50k.tiktoken", special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents of ``docs`` in sequences of at most ``capacity`` tokens.

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0), ``sequence_cost`` and, if ``with_ids``, ``ids``.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each on their
    own; an empty table gives an empty result; other columns are not read. A very long text is cut over
    several sequences; a task holds about ``block_tokens`` ids and the longest document. The pieces are written
    below the shared folder, so that the rests are dealt from what was packed.
    """
    ready(docs)
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
              + ", ids array<int>" * with_ids)

    def block(items: list[tuple], first: int, kind: pa.DataType) -> tuple[pa.RecordBatch, int]:
        """Items packed into sequences numbered from ``first``; returns the next number, too."""
        pieces = assign(np.array([len(i[3]) // 4 for i in items], np.int64), capacity)
        count = max(p[3] for p in pieces) + 1
        filled, cost, offset = [0] * count, [0.0] * count, []
        for _, _, n, s in pieces:
            offset.append(filled[s])
            filled[s] += n
            cost[s] += n + QUADRATIC * n * n
        cut = [items[d][3][4 * a:4 * (a + n)] for d, a, n, _ in pieces]
        return rows([(items[d][0], items[d][1] + a, n, zlib.crc32(c), items[d][2], first + s, o, cost[s], c)
                     for (d, a, n, s), o, c in zip(pieces, offset, cut, strict=True)], kind), first + count

    def rows(out: list[tuple], kind: pa.DataType, rest: bool = False) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
        kinds = [kind, *[pa.int64()] * 6, pa.float64()]
        columns = {c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))}
        if with_ids:
            columns["ids"] = pa.array([None if rest else np.frombuffer(r[8], "<u4").astype(np.int32) for r in out], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns | {"rest": pa.array([r[8] if rest else None for r in out], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(ranks, special), np.array([end_id], "<u4").tobytes()
        following = TaskContext.get().partitionId() << 32  # a partition's sequences have numbers of their own
        items, held, kind = [], 0, None
        for b in batches:
            kind = b.schema.types[0]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (enc.encode(text) if text else b"") + end
                items.append((i, 0, len(t) // 4, t))
                held += len(t) // 4
                if held >= block_tokens:
                    full, items = split_rest(items, capacity)
                    if full:
                        out, following = block(full, following, kind)
                        yield out
                    held %= capacity
        if items:
            full, items = split_rest(items, capacity)
            if full:
                yield block(full, following, kind)[0]
            yield rows([(d, s, len(t) // 4, None, n, None, None, None, t) for d, s, n, t in items], kind, rest=True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        following, items, held, kind = ANEW + (TaskContext.get().partitionId() << 32), [], 0, None
        for b in batches:
            kind = b.schema.types[0]
            for item in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                items.append(item)
                held += len(item[3]) // 4
                if held >= block_tokens:
                    full, items = split_rest(items, capacity)
                    out, following = block(full, following, kind)
                    yield out.drop_columns(["rest"])
                    held %= capacity
        if items:
            yield block(items, following, kind)[0].drop_columns(["rest"])

    packed = staged(narrow.mapInArrow(run, schema + ", rest binary"), "packed")
    rest = packed.filter("rest is not null").select("doc_id", "start", "doc_tokens", "rest")
    tokens = rest.agg(F.sum(F.length("rest") / 4)).first()[0]
    done = packed.filter("rest is null").drop("rest")
    if not tokens:
        return done
    return done.unionByName(rest.repartition(int(tokens // block_tokens) + 1).mapInArrow(again, schema))
