"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other by logistic regressions on the same features; each later
model also gets the earlier categories' probabilities. It learns from out-of-fold probabilities: those
that a model gave which had not seen the row. So it trusts them no more than it can at prediction.

Features: for each of the words that the labelled rows show to go with a category, how often it stands in the
text, and a few measures of the writing. Words and weights are learned from a bounded sample of labelled
rows; statistics over words are Spark aggregates, and only the chosen words and the sample's few counts per
row reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import ready, staged

#: Labelled rows learned from at most, words chosen per category, rows that must have a chosen word, folds, ridge.
SAMPLE_ROWS, WORDS, LEAST_ROWS, FOLDS, RIDGE = 12_000, 96, 4, 4, 1.0
#: Least log-likelihood ratio (G squared) of a word and a category: chance gives as much to one word in 100,000.
LEAST_G2 = 20.0
WORD = re.compile(r"[^\W\d_]+")
MEASURES = ("upper", "marks", "digits", "lines", "repeated", "length")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def measures(text: str, words: list[str]) -> list[float]:
    n = max(len(text), 1)
    letters = max(sum(map(len, words)), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    digits = sum(map(text.count, "0123456789"))
    return [sum(map(text.count, _UPPER)) / letters, (n - letters - text.count(" ") - digits) / n, digits / n, len(lines) / max(len(words), 1),
            1 - len(set(lines)) / max(len(lines), 1), math.log1p(len(words)) / 10]


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Chain:
    """Learned words, and for each category its weights: bias, words, measures, earlier probabilities."""

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    scale: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.ones(0))

    def features(self, texts: list[str | None]) -> np.ndarray:
        place = {w: k for k, w in enumerate(self.words)}
        out = np.zeros((len(texts), len(place) + len(MEASURES)))
        for row, text in zip(out, texts, strict=True):
            found = words_of(text or "")
            for w, n in Counter([w for w in found if w in place]).items():
                row[place[w]] = math.log1p(n)
            row[len(place):] = measures(text or "", found)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(x), 1)), (x - self.scale[0]) / self.scale[1]])
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w)[:, None]])
        return x[:, x.shape[1] - len(self.weights):]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the bias and is hardly shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(chain: Chain, x: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: float = RIDGE) -> Chain:
    """Fit ``chain`` on the features ``x`` (rows x features) and labels ``y`` (rows x categories, NaN: not known)."""
    chain.scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    x = np.hstack([np.ones((len(x), 1)), (x - chain.scale[0]) / chain.scale[1]])
    for c in range(y.shape[1]):
        known = ~np.isnan(y[:, c])
        out = np.zeros(len(x))
        for f in np.unique(fold):
            learn = known & (fold != f)
            out[fold == f] = sigmoid(x[fold == f] @ logistic(x[learn], y[learn, c], ridge)) if learn.any() else 0.5
        chain.weights.append(logistic(x[known], y[known, c], ridge) if known.any() else np.zeros(x.shape[1]))
        x = np.hstack([x, out[:, None]])
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit a chain on the labelled rows with the smallest hashes of the id, ``rows`` at most.

    A row counts for the categories whose label is not null; of repeated ids the largest labels and one text
    count, of equal texts one. Without labelled rows every probability is 0.5.
    """
    ready(docs)
    place = F.xxhash64("doc_id", F.lit(11))
    labels = labels.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)])
    ys = [f"y{k}" for k in range(len(categories))]
    chosen = (labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
              .filter(F.coalesce(*ys).isNotNull()).orderBy(place, "doc_id").limit(rows))
    # bounded by rows, so the documents need no shuffle
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = staged(texts.dropDuplicates(["doc_id"]).dropDuplicates(["text"]), "labelled")  # copies would count as evidence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(words_of(t))) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *[b.column(b.schema.get_field_index(y)) for y in ys]], ["words", *ys])

    cuts = texts.mapInArrow(cut, "words array<string>, " + ", ".join(f"{y} double" for y in ys)).select(F.explode("words").alias("word"), *ys)
    counts = cuts.groupBy("word").agg(*[F.sum(y).alias(f"with_{y}") for y in ys], *[F.sum(1 - F.col(y)).alias(f"without_{y}") for y in ys])
    counts = staged(counts.filter(sum(F.coalesce(f"with_{y}", F.lit(0)) + F.coalesce(f"without_{y}", F.lit(0)) for y in ys) >= LEAST_ROWS), "words")
    totals = texts.agg(*[F.sum(y).alias(f"with_{y}") for y in ys], *[F.sum(1 - F.col(y)).alias(f"without_{y}") for y in ys]).first().asDict()
    words: set[str] = set()
    for y in ys:
        a, b = F.coalesce(F.col(f"with_{y}"), F.lit(0.0)), F.coalesce(F.col(f"without_{y}"), F.lit(0.0))
        yes, no = float(totals[f"with_{y}"] or 0), float(totals[f"without_{y}"] or 0)
        if not yes or not no:
            continue
        cells = ((a, yes, a + b), (b, no, a + b), (yes - a, yes, yes + no - a - b), (no - b, no, yes + no - a - b))
        g2 = 2 * sum(F.when(x > 0, x * F.log(x * (yes + no) / (row * column))).otherwise(0.0) for x, row, column in cells)
        words |= {r["word"] for r in counts.filter(g2 >= LEAST_G2).orderBy(g2.desc(), "word").limit(WORDS).collect()}
    chain = Chain(categories, sorted(words))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = chain.features(b.column(b.schema.get_field_index("text")).to_pylist())
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), *[b.column(b.schema.get_field_index(y)) for y in ys],
                 pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at, strict=True)], pa.list_(pa.float64()))],
                ["doc_id", *ys, "at", "value"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows_ = texts.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{y} double" for y in ys) + ", at array<int>, value array<double>")
    got = rows_.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FOLDS))).orderBy("doc_id").collect()
    x = np.zeros((len(got), len(chain.words) + len(MEASURES)))
    for k, r in enumerate(got):
        x[k, r["at"]] = r["value"]
    y = np.array([[np.nan if r[c] is None else r[c] for c in ys] for r in got], float).reshape(len(got), len(ys))
    if not len(got):
        chain.scale = (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        chain.weights = [np.zeros(1 + x.shape[1] + c) for c in range(len(ys))]
        return chain
    return fit_chain(chain, x, y, np.array([r["fold"] for r in got]))


def predict(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``p_<category>`` and ``is_<category>`` for each category.

    A null text counts as empty and gets the chain's answer for it; a null id stays null; repeated rows are
    judged each on their own; an empty table gives an empty result; other columns of ``docs`` are not read.
    Texts are read whole.
    """
    ready(docs)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities(chain.features(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k], pa.float64()) for k in range(len(names))]], ["doc_id", *names])

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({f"is_{c}": F.col(f"p_{c}") >= threshold for c in chain.categories})
