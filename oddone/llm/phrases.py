"""Phrase collocations, counted in HAT-tries.

Each task counts the phrases of its texts in a shallow trie over word ids whose leaves are hash containers: a
container that grows too large bursts into a node over the next word. When a task holds too many entries
its largest subtrees leave whole, as sorted runs, and the runs of all tasks are merged per prefix partition (by
the first two words).

Phrases are counted length by length. A phrase is frequent only if the two phrases one word shorter inside
it are, so occurrences are counted only where both are in a bitmap of the frequent shorter ones. The bitmap
has a bounded size; what it lets through by chance is counted and then falls below the threshold, so counts
are exact at any fill. Words are named by 64-bit hashes of language and word; if two share one, the hash is taken
anew with another seed. Texts are split into words once and kept as ids, below the shared folder, for the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddone.llm.common import ready, staged, staged_keys

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A longer candidate with this share (in percent) of a candidate's occurrences takes its place.
COVERED = 80
#: Entries of a container before it bursts, of a trie before subtrees leave, and words a task knows at a time.
BURST, ENTRIES, WORDS = 4096, 800_000, 500_000
#: Bits of a bitmap: 16 for each frequent phrase, between these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: A-Z become a-z, and all that ends a piece becomes one sign. These bytes stand for themselves in UTF-8.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
UNKNOWN = "und"
#: Three word ids of a task, below 2**ID_BITS, fit one number.
ID_BITS = 21
#: Words of text in a chunk, entries of one row of a run, those merged at a time, and words of text for each prefix partition.
CHUNK, RUN, MERGED, PART_WORDS = 1 << 19, 1 << 16, 1 << 21, 1 << 22


def words_of(texts: list[str]) -> list[bytes]:
    """The words of the texts one after the other, with ``.`` between pieces."""
    return ".".join(texts).encode().translate(FOLD).replace(b".", b" . ").split()


def word_hash(lang: bytes, word: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b"%d:%b%b" % (len(lang), lang, word), seed) or 1


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash for each phrase, from those of its words."""
    g = columns[0].astype(np.uint64)
    for w in columns[1:]:
        g = (g * np.uint64(0x9E3779B97F4A7C15)) ^ (w.astype(np.uint64) + (g >> np.uint64(29)))
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
    return g


class Sieve:
    """A bitmap over hashed phrases: none of the phrases it was made of is missing in it."""

    def __init__(self, data: np.ndarray):
        self.data, self.mask = data, np.uint64(8 * len(data) - 1)

    def test(self, g: np.ndarray) -> np.ndarray:
        slot = g & self.mask
        return (self.data[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve_of(frequent: DataFrame, n: int) -> Sieve:
    """The bitmap of the phrases ``w1 .. wn``, made on the executors; at most 16 MB reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * frequent.count()).bit_length()))
    names = [f"w{k + 1}" for k in range(n)]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = mixed([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64) + 1)], ["slot"])

    found = frequent.select(*names).mapInArrow(slots, "slot long")
    found = found.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    data = np.zeros(bits // 8, np.uint8)
    for part, chunk in found.collect():
        a = (part - 1) * len(chunk)
        data[a:a + len(chunk)] |= np.frombuffer(chunk, np.uint8)[:len(data) - a]
    return Sieve(data)


class Node(dict):
    """An inner node of the trie: next word id -> node or container (a Counter of packed rests of phrases)."""


def segments(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``value, start, end`` of each run of equal values."""
    ends = [*(np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1).tolist(), len(sorted_)]
    yield from zip(sorted_[[0, *ends[:-1]]].tolist(), [0, *ends[:-1]], ends, strict=True)


class Trie:
    """Counts of phrases of ``n`` word ids below 2**ID_BITS. The first word leads to a container of the rest, packed into one
    number; a container of more than ``burst`` rests becomes a node over their first word."""

    def __init__(self, n: int, burst: int = BURST):
        self.n, self.burst, self.root, self.sizes, self.size = n, burst, Node(), {}, 0

    def add(self, columns: list[np.ndarray]) -> None:
        """Occurrences by their words' columns (int64)."""
        if not len(columns[0]):
            return
        order = np.argsort(columns[0], kind="stable")
        rests = packed(columns[1:])[order]
        for w, a, b in segments(columns[0][order]):
            grown = self._into(self.root, w, rests[a:b], self.n - 1)
            self.sizes[w] = self.sizes.get(w, 0) + grown
            self.size += grown

    def _into(self, node: Node, w: int, rests: np.ndarray, left: int) -> int:
        """Put occurrences below ``node[w]`` (``left`` words remain); returns the number of new entries."""
        child = node.get(w)
        if type(child) is Node:
            return sum(self._into(child, v, part, left - 1) for v, part in _by_first(rests, left))
        if child is None:
            child = node[w] = Counter()
        before = len(child)
        child.update(rests.tolist())
        grown = len(child) - before
        if left > 1 and len(child) > self.burst:
            keys, counts = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
            order = np.argsort(keys)
            keys, counts, node[w] = keys[order], counts[order], Node()
            for v, a, b in segments(keys >> ID_BITS * (left - 1)):
                node[w][v] = Counter(dict(zip((keys[a:b] & (1 << ID_BITS * (left - 1)) - 1).tolist(), counts[a:b].tolist(), strict=True)))
        return grown

    def _entries(self, node: dict, rest: int, left: int, out: list) -> None:
        """``(rest, count)`` arrays of all phrases below a node, with the words on the way to it in ``rest``."""
        if type(node) is Node:
            for w, child in node.items():
                self._entries(child, rest | w << ID_BITS * (left - 1), left - 1, out)
        elif node:
            out.append((np.fromiter(node.keys(), np.int64, len(node)) | rest, np.fromiter(node.values(), np.int64, len(node))))

    def leave(self, keep: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Take the largest subtrees out until at most ``keep`` entries stay; returns their phrases by column, and counts."""
        firsts, rests, counts = [], [], []
        for w in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.size <= keep:
                break
            out: list = []
            self._entries(self.root.pop(w), 0, self.n - 1, out)
            rests += [r for r, _ in out]
            counts += [c for _, c in out]
            firsts.append(np.full(sum(len(r) for r, _ in out), w, np.int64))
            self.size -= self.sizes.pop(w)
        first, rest, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, rests, counts))
        return [first, *unpacked(rest, self.n - 1)], count


def packed(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0]
    for c in columns[1:]:
        key = key << ID_BITS | c
    return key


def unpacked(key: np.ndarray, n: int) -> list[np.ndarray]:
    return [key >> ID_BITS * (n - 1 - k) & (1 << ID_BITS) - 1 for k in range(n)]


def _by_first(rests: np.ndarray, left: int) -> Iterator[tuple[int, np.ndarray]]:
    """Packed rests of ``left`` words by their first word."""
    rests = np.sort(rests)
    for v, a, b in segments(rests >> ID_BITS * (left - 1)):
        yield v, rests[a:b] & (1 << ID_BITS * (left - 1)) - 1


def _narrow(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col], F.lit(UNKNOWN)).alias("lang"), docs[text_col].alias("text")).filter("text <> ''")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, of in texts.items():
        yield lang, words_of(of)


def read_words(texts: DataFrame, seed: int) -> DataFrame:
    """One pass over ``texts`` (``lang, text``). Rows of two kinds: ``w1`` (hash), ``lang``, ``word``, ``f`` count the words of a part
    of the texts; ``ids, hashes`` hold about ``CHUNK`` words of text, ids from 1 into the sorted hashes and 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        hashes: list[int] = [0]

        class Ids(dict):
            def __init__(self, lang: str):
                super().__init__({b".": 0})
                self.lang = lang.encode()

            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(hashes)
                hashes.append(word_hash(self.lang, word, seed))
                return n

        totals, chunk, held = np.zeros(0, np.int64), [], 0
        names = ["w1", "lang", "word", "f", "ids", "hashes"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]

        def row(n: int, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], names)

        def text() -> pa.RecordBatch:
            """The chunk held; its words are counted, too."""
            nonlocal totals, chunk, held
            ids = np.concatenate(chunk)
            counts = np.bincount(ids, minlength=len(hashes))
            totals = np.concatenate([totals, np.zeros(len(counts) - len(totals), np.int64)]) + counts
            there = np.flatnonzero(counts)
            there = there[there > 0]
            of = np.array([hashes[i] for i in there.tolist()], np.uint64)
            order = np.argsort(of)
            place = np.zeros(len(counts), np.uint32)
            place[there[order]] = np.arange(1, len(there) + 1)
            small = place[ids].astype("<u2" if len(there) < 1 << 16 else "<u4")
            chunk, held = [], 0
            return row(1, None, None, None, None, pa.array([small.tobytes()], pa.binary()), pa.array([of[order].astype("<u8").tobytes()], pa.binary()))

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal totals
            for lang, ids in known.items():
                words = [w for w in ids if w != b"."]
                at = [ids[w] for w in words]
                of = np.array([hashes[i] for i in at], np.uint64).view(np.int64)
                yield row(len(words), pa.array(of), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                          pa.array(totals[at], pa.int64()), None, None)
            known.clear()
            hashes[1:], totals = [], np.zeros(0, np.int64)

        for b in batches:
            for lang, words in _by_lang(b):
                if lang not in known:
                    known[lang] = Ids(lang)
                chunk += [np.fromiter(map(known[lang].__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
                held += len(words) + 1
            if held >= CHUNK or len(hashes) > WORDS:
                yield text()
            if len(hashes) > WORDS:
                yield from counted()
        if held:
            yield text()
        yield from counted()

    return texts.mapInArrow(run, "w1 long, lang string, word string, f long, ids binary, hashes binary")


def count_phrases(chunks: DataFrame, n: int, words: Sieve, shorter: Sieve | None, min_count: int, parts: int, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """``w1 .. wn, f`` of the phrases of ``n`` words with ``f >= min_count``, among those whose words (and, if given, both
    phrases one word shorter) pass the sieves.

    Subtrees leave a task as sorted runs, cut by a hash of the first two words into ``parts``; a part's runs are merged by
    the task that gets it, in the order of their first phrases."""
    names = [f"w{k + 1}" for k in range(n)]
    given = chunks.sparkSession.sparkContext.broadcast((words, shorter))  # 32 MB at most

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shorter = given.value
        known: dict[int, int] = {}  # word hash -> id in this trie, from 1
        trie = Trie(n, burst)

        def runs(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
            of = np.fromiter(known, np.uint64, len(known))
            columns = [of[c - 1] for c in columns]
            part = (mixed(columns[:2]) % np.uint64(parts)).astype(np.int64)
            table = [c.view(np.int64) for c in columns] + [counts]
            order = np.lexsort([*table[n - 1::-1], part])
            part, table = part[order], np.array(table)[:, order]
            cuts = [(p, c, min(c + RUN, e)) for p, a, e in segments(part) for c in range(a, e, RUN)] if len(part) else []
            return pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in cuts], pa.int32()), pa.array([int(table[0, c[1]]) for c in cuts], pa.int64()),
                 pa.array([table[:, c[1]:c[2]].astype("<i8").tobytes() for c in cuts], pa.binary())], ["part", "first", "run"])

        def windows(ids: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
            """Columns of the occurrences to count, as places in ``hashes`` (from 1)."""
            m = len(ids) - n + 1
            if m <= 0:
                return [ids[:0]] * n
            if shorter is None:
                ok = np.logical_and.reduce([ids[k:m + k] != 0 for k in range(n)])
            else:
                inside = np.logical_and.reduce([ids[k:m + 1 + k] != 0 for k in range(n - 1)])
                at = np.flatnonzero(inside)
                inside[at] = shorter.test(mixed([hashes[ids[at + k] - 1] for k in range(n - 1)]))
                ok = inside[:-1] & inside[1:]
            at = np.flatnonzero(ok)
            return [ids[at + k] for k in range(n)]

        for b in batches:
            for packed_ids, packed_hashes in zip(b.column(0), b.column(1), strict=True):
                hashes = np.frombuffer(packed_hashes.as_buffer(), "<u8")
                ids = np.frombuffer(packed_ids.as_buffer(), "<u2" if len(hashes) < 1 << 16 else "<u4")
                passed = words.test(hashes)
                place = np.concatenate([[0], np.where(passed, np.arange(1, len(hashes) + 1), 0)])
                ids = place[ids]
                for a in range(0, len(ids), CHUNK):  # one text may be longer than a chunk
                    columns = windows(ids[a:a + CHUNK + n - 1], hashes)
                    used = np.unique(np.concatenate(columns))
                    if len(known) + len(used) >= 1 << ID_BITS:
                        yield runs(*trie.leave(0))
                        known.clear()
                    mine = np.zeros(len(hashes) + 1, np.int64)
                    mine[used] = [known.setdefault(x, len(known) + 1) for x in hashes[used - 1].tolist()]
                    trie.add([mine[c] for c in columns])
                    if trie.size > entries:
                        yield runs(*trie.leave(entries // 2))
        yield runs(*trie.leave(0))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # tables of words and counts: what is not yet complete
        at, size, limit = None, 0, MERGED

        def summed() -> np.ndarray:
            table = np.concatenate(held, axis=1) if held else np.zeros((n + 1, 0), np.int64)
            table = table[:, np.lexsort(table[n - 1::-1])]
            new = np.concatenate([[True], (table[:n, 1:] != table[:n, :-1]).any(axis=0)])[:table.shape[1]]
            start = np.flatnonzero(new)
            return np.concatenate([table[:n, start], np.add.reduceat(table[n], start)[None]]) if len(start) else table

        def done(table: np.ndarray) -> pa.RecordBatch:
            table = table[:, table[n] >= min_count]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(table)], [*names, "f"])

        for b in batches:
            for part, first, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != at:
                    yield done(summed())
                    held, size, at, limit = [], 0, part, MERGED
                elif size >= limit:  # first words below this run's are complete
                    table = summed()
                    cut = int(np.searchsorted(table[0], first))
                    yield done(table[:, :cut])
                    held, size = [table[:, cut:]], table.shape[1] - cut
                    limit = max(MERGED, 2 * size)
                held.append(np.frombuffer(run.as_buffer(), "<i8").reshape(n + 1, -1))
                size += held[-1].shape[1]
        yield done(summed())

    spilled = chunks.select("ids", "hashes").mapInArrow(spill, "part int, first long, run binary")
    dealt = spilled.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "first")
    return dealt.mapInArrow(merge, ", ".join(f"{w} long" for w in names) + ", f long")


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text",
                 entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate has 2 to ``longest`` (at most 4) words and ``a >= min_count`` occurrences, overlaps included. Cut after its first
    k words it scores ``floor(2000000 a / (l + r))``, l and r the occurrences of the two parts; its lowest-scoring cut
    counts (ties: smallest k). Candidates inside a longer one with at least 80 % of their occurrences are dropped.
    Order: score, a (both descending), phrase by UTF-8 bytes; ``n`` is the number of words of the language.

    A null language is ``und``, a null or empty text has no words, repeated rows count as often as they stand there,
    and an empty table (or one without frequent phrases) gives an empty result. Other columns are not read.
    """
    ready(docs)
    texts = _narrow(docs, lang_col, text_col)
    for seed in range(100):
        read = staged(read_words(texts, seed), "words-read")
        words = read.filter("w1 is not null").repartition("w1").groupBy("w1", "lang", "word").agg(F.sum("f").alias("f"))
        words = staged_keys(words, "words")
        if words.groupBy("w1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("no hash seed keeps all words apart")
    chunks = read.filter("ids is not null")
    frequent = [words.filter(F.col("f") >= min_count)]
    n_words = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_words // PART_WORDS + 1)
    word_sieve, shorter = sieve_of(frequent[0], 1), None
    for n in range(2, longest + 1):
        found = staged_keys(count_phrases(chunks, n, word_sieve, shorter, min_count, parts, entries, burst), f"phrases-{n}")
        frequent.append(found)
        if n < longest:
            shorter = sieve_of(found, n)

    def keyed(df: DataFrame, n: int) -> DataFrame:
        lang = F.col("lang") if n == 1 else F.lit(None).cast("string").alias("lang")
        return df.select(F.array(*[f"w{k + 1}" for k in range(n)]).alias("w"), "f", lang)

    phrases = keyed(frequent[0], 1)
    for n in range(2, longest + 1):
        phrases = phrases.unionByName(keyed(frequent[n - 1], n))
    candidates = phrases.filter(F.size("w") > 1).select("w", F.col("f").alias("a"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("left", F.slice("w", F.lit(1), F.col("k"))).withColumn("right", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")))
    cuts = (cuts.join(phrases.select(F.col("w").alias("left"), F.col("f").alias("l"), "lang"), "left")
            .join(phrases.select(F.col("w").alias("right"), F.col("f").alias("r")), "right"))
    score = F.expr("(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    scored = cuts.groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.max("lang").alias("lang"))

    longer = candidates.filter(F.size("w") > 2)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda at: F.slice("w", at, m))))
    inside = longer.select(F.explode(parts).alias("w"), "a").groupBy("w").agg(F.max("a").alias("most"))
    kept = scored.join(inside, "w", "left").filter(
        F.col("most").isNull() | (_big("most") * F.lit(100).cast("decimal(3,0)") < _big("a") * F.lit(COVERED).cast("decimal(3,0)")))

    order = [F.col("score").desc(), F.col("a").desc()]
    kept = kept.select("w", "a", "lang", "cut.score", "cut.l", "cut.r")
    kept = kept.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= top)  # ties stay: their words decide
    spelt = kept.select("w", F.posexplode("w").alias("at", "w1")).join(words.select("w1", "word"), "w1")
    spelt = spelt.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    best = kept.drop("at").join(spelt, "w").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.filter(F.col("rank") <= top).join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The query in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda m: list_transform(range(1, greatest(len(ws) - m + 2, 1)), lambda i: ws[i:i + m - 1])))) AS ph FROM w),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1 AND f >= {min_count}),
k AS (SELECT c.*, unnest(range(1, len(ph))) AS k FROM c),
s AS (SELECT k.lang, k.ph, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.ph = k.ph[:k.k] JOIN f y ON y.lang = k.lang AND y.ph = k.ph[k.k + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
u AS (SELECT lang, unnest(flatten(list_transform(range(2, len(ph)), lambda m: list_transform(range(1, len(ph) - m + 2), lambda i: ph[i:i + m - 1])))) AS ph, a FROM c WHERE len(ph) > 2),
i AS (SELECT lang, ph, max(a) AS most FROM u GROUP BY ALL),
z AS (SELECT m.lang, array_to_string(m.ph, ' ') AS phrase, m.a, m.l, m.r, m.score FROM m LEFT JOIN i ON i.lang = m.lang AND i.ph = m.ph
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * m.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {top}
"""
