"""Language identification by compression.

Each language gets a raw-content dictionary: a bounded, deterministic sample of its labelled texts. A text
is reduced to its words and cut into segments, and every segment is encoded with every dictionary; the language with the smallest
total wins. How much the winner saves over the runner-up, beyond what words of random letters save by chance, is the
score, and a narrow margin is a rejection. Chance is learned from the dictionaries' own letters.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import ready

#: Labelled rows sampled for a language at most, and characters taken of one of them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 600
#: Bytes of a dictionary, and of a segment of text that is encoded at once.
DICT_BYTES, SEGMENT_BYTES = 96 << 10, 1 << 10
LEVEL = 6
#: Below this saving, beyond chance, the decision is rejected.
MIN_MARGIN = 0.002
#: Words of the random texts that the margin is learned from, and texts of each length and kind.
NOISE_WORDS, NOISE_TEXTS = (5, 10, 20, 50, 150, 500, 1500), 60
UNKNOWN = "und"
NO_LETTER = re.compile(r"[\W\d_]+")
#: Numerals that a pattern's word characters include, of any script; like digits they are no letters.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
BLANKED = {ord(c): " " for c in NUMERALS}


def letters(text: str) -> str:
    """The text in lower case with one blank for all between two words: case, digits and marks tell no language."""
    text = text.lower()
    if not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(BLANKED)
    return NO_LETTER.sub(" ", text).strip()


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 on division by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary per language from rows with an id, a text and a language, held-out rows excepted.

    The sample is the rows with the smallest hash of the id: a share of each language by its row count,
    chosen by a filter in the scan, then cut to ``rows``. At most ``rows`` x ``chars`` characters a language
    reach the driver, however large the table.
    """
    known = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = (F.xxhash64("doc_id", F.lit(7)) / F.lit(2.0 ** 64) + 0.5).alias("place")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * rows / n + 100.0 / n))])
    sample = (known.select("lang", place, "text").filter(F.col("place") < share[F.col("lang")])
              .select("lang", "place", F.substring(F.trim("text"), 1, chars).alias("text")).distinct().orderBy("lang", "place").collect())
    texts: dict[str, list[str]] = {k: [] for k in sorted(counts)}
    for r in sample:
        if len(texts[r["lang"]]) < rows:
            texts[r["lang"]].append(r["text"])
    # the end of a dictionary is the cheapest to refer to, so what does not fit is lost at its start
    return {k: " ".join(letters(t) for t in v).encode()[-size:] for k, v in texts.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, segment: int = SEGMENT_BYTES, chance: tuple[float, float] | None = None):
        import zstandard

        self.by_share, self.by_root = noise(dictionaries) if chance is None else chance
        self.langs, self.segment, self.encoders = list(dictionaries), segment, []
        for content in dictionaries.values():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=raw, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def judge(self, text: str | None) -> tuple[str, int, int]:
        """The language, the bytes that it saves over the runner-up, and the runner-up's bytes."""
        data = letters(text).encode() if text else b""
        if not data or not self.langs:
            return UNKNOWN, 0, 1
        cut = [data[i:i + self.segment] for i in range(0, len(data), self.segment)]
        sizes = [sum([len(encode(c)) for c in cut]) for encode in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], sizes[0], sizes[0]
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], second - sizes[best], second

    def __call__(self, text: str | None) -> tuple[str, float]:
        lang, saved, of = self.judge(text)
        return lang, max(0.0, saved - self.by_share * of - self.by_root * math.sqrt(of)) / of


def noise(dictionaries: dict[str, bytes], seed: int = 7) -> tuple[float, float]:
    """What a text without a language may save, by chance: a share of the runner-up's bytes, and on top of it
    bytes per square root of them.

    Measured on words of random letters: the letters of all dictionaries together, as often as they stand there, and
    all of them equally often. The share is the mean of the longest texts (letters alone favour a language a little), the
    rest is the largest saving beyond it; as chance savings grow as the square root, it counts most for short texts.
    """
    if len(dictionaries) < 2:
        return 0.0, 0.0
    c, random = Classifier(dictionaries, chance=(0.0, 0.0)), np.random.RandomState(seed)
    pool = "".join("".join(content.decode(errors="ignore").split()) for content in dictionaries.values())
    if not pool:
        return 0.0, 0.0
    by_share, found = 0.0, []
    for source in (pool, sorted(set(pool))):
        for words in NOISE_WORDS:
            for _ in range(NOISE_TEXTS):
                drawn = "".join(source[i] for i in random.randint(0, len(source), 9 * words))
                ends = np.cumsum(random.randint(2, 10, words)).tolist()
                found.append(c.judge(" ".join(drawn[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)))[1:])
        by_share = max(by_share, float(np.mean([saved / of for saved, of in found[-NOISE_TEXTS:]])))
    return by_share, max(0.0, *[(saved - by_share * of) / math.sqrt(of) for saved, of in found])


_LAST: list = []


def classifier(dictionaries: dict[str, bytes], chance: tuple[float, float]) -> Classifier:
    """A worker keeps the classifier of the dictionaries it saw last."""
    key = tuple(sorted(dictionaries.items()))
    if not _LAST or _LAST[0] != key:
        _LAST[:] = [key, Classifier(dictionaries, chance=chance)]
    return _LAST[1]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1: the share of the
    runner-up's bytes that the winner saves beyond the :func:`noise` of the dictionaries), ``accepted`` (that is at
    least ``min_margin``).

    Only the text decides, and the whole text. A null text or one without a letter is ``und``, score 0, not
    accepted; so is every row if nothing was learned. Ties go to the first language by name with score 0. A
    null id is not held out. Repeated rows are judged each on their own; an empty table gives an empty
    result; other columns of ``docs`` are not read.
    """
    ready(docs)
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out"))
    chance = noise(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classifier(dictionaries, chance)
        for b in batches:
            found = [c(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[0] != UNKNOWN and x[1] >= min_margin for x in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language :func:`predict` accepts."""
    ready(docs)
    at = docs.columns.index(text_col)
    chance = noise(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = classifier(dictionaries, chance)
        for b in batches:
            found = [c(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([x[0] != UNKNOWN and x[1] >= min_margin for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
