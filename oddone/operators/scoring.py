"""Batch scoring of prompts with a user-supplied model function.

``score_prompts`` keeps the reference's batching law — prompts sorted by length (stable on the id), cut into
consecutive batches of ``batch_size``.  The ranking's range partitions hold contiguous runs of batches, so the
scorer runs there, once per batch, over Arrow batches.  A batch that a partition boundary cuts is left out by
both sides and scored in a second pass, which gets those very rows, dealt by batch: no prompt is looked up
again by a user's key, so NULL and repeated ids are safe.  Prompts are shuffled once, ranked and counted in the same
job.  Both passes are checkpointed, so later actions never call the model again; they keep the answers, and
prompts only of rows that wait for the second pass.  Prompt text before and cleaning and choice after are built-in
column expressions.

Scorer contract (any Python callable, one call per batch):

* ``mode="tokens"``: ``scorer(batch: pandas.DataFrame) -> list[str]`` (generated text per row)
* ``mode="logits"``: ``scorer(batch) -> pandas.DataFrame`` with ``lp_y1, lp_z1, y_tok, z_tok``

The batch frame holds ``id, text, head, y, z, batch_id, batch_pos`` plus any ``pass_cols``; with ``chat=True`` also
``messages``, the user turn for the model's chat template; an image column goes along as one of the ``pass_cols``.  The
scorer is pickled to the workers: define it in a module the workers can import (or inline, so it is sent by value).
A model that takes time to load is wrapped as ``LoadOnce(factory)``.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddone.functions.prompts import add_suffix, chat_messages, vlm_prompt
from oddone.functions.text import clean_generation, match_first, resolve_choice, strip_label, strip_think
from oddone.functions.vectors import logprob_choice
from oddone.operators.indexing import dense_index
from oddone.session import ensure_checkpoint_dir, ship_package

MODES = ("tokens", "logits")


def batch_ids(df: DataFrame, id_col: str, text_col: str, batch_size: int,
              use_length_bucketing: bool = True, len_col: str | None = None, counted: Observation | None = None) -> DataFrame:
    """``batch_id``/``batch_pos``: rank in (length(text), id) order (or id order), cut by batch_size.  Rows that tie
    (NULL or repeated ids) are numbered as they stand in the checkpointed order: each once.  With ``len_col`` the lengths
    are there already and ``df`` needs no texts.  ``counted`` gets the number of rows, ``n``."""
    if batch_size < 1:
        raise ValueError(f"a batch needs at least one prompt, not {batch_size}")
    keyed = df.withColumn("_len", F.col(len_col) if len_col else F.length(text_col)) if use_length_bucketing else df
    order = ["_len", id_col] if use_length_bucketing else [id_col]
    ranked = dense_index(keyed, order, "_ord", counted=counted)
    out = (ranked.withColumn("batch_id", F.floor(F.col("_ord") / batch_size).cast("long"))
           .withColumn("batch_pos", F.pmod(F.col("_ord"), F.lit(batch_size)).cast("long"))
           .drop("_ord"))
    return out.drop("_len") if use_length_bucketing else out


#: The model that this worker process holds: that of the last :class:`LoadOnce` it ran.
_LOADED: dict[str, Callable] = {}


class LoadOnce:
    """A scorer whose model is set up once per worker process: ``factory()`` returns the scorer proper and is called with
    the first batch; later batches and tasks of the process use the same.  A process holds one model at a time."""

    def __init__(self, factory: Callable[[], Callable]):
        self.factory, self.key = factory, uuid.uuid4().hex

    def __call__(self, batch: pd.DataFrame):
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = self.factory()
        return _LOADED[self.key](batch)


def batch_progress(batched: DataFrame, batch_size: int, n_total: int | None = None) -> DataFrame:
    """Per batch: its size and prompts processed once it has run.  Batches are dense and full
    except the last, so the running total is ``min((batch_id + 1) * batch_size, n)`` — no window."""
    n_total = n_total if n_total is not None else batched.count()
    per = batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_n"))
    return per.withColumn("processed", F.least((F.col("batch_id") + 1) * batch_size, F.lit(n_total)).cast("long"))


_RESULT = {"tokens": [("raw", pa.string())],
           "logits": [("lp_y1", pa.float64()), ("lp_z1", pa.float64()), ("y_tok", pa.int32()), ("z_tok", pa.int32())]}
_RESULT_SQL = {"tokens": "raw string", "logits": "lp_y1 double, lp_z1 double, y_tok int, z_tok int"}


def _runner(scorer: Callable, mode: str, n_total: int, batch_size: int, edges: bool):
    """Over rows sorted by batch: score the batches whose rows are all here; with ``edges`` emit the rows of the
    others unscored (``done`` false), else every batch must be whole."""
    last_id = (n_total - 1) // batch_size
    last_size = n_total - last_id * batch_size

    def call(batch: pa.Table) -> pd.DataFrame:
        frame = batch.to_pandas(integer_object_nulls=True)
        got = scorer(frame)
        got = pd.DataFrame({"raw": list(got)}) if mode == "tokens" else pd.DataFrame(got).reset_index(drop=True)
        if len(got) != len(frame):
            raise ValueError(f"the scorer answered {len(got)} of {len(frame)} prompts of a batch")
        return got

    def scored(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("batch_id").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        parts, done = [], np.zeros(len(ids), bool)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            whole = b - a == (last_size if ids[a] == last_id else batch_size)
            if not whole and not edges:
                raise ValueError(f"batch {ids[a]} came with {b - a} rows")
            done[a:b] = whole
            parts.append(call(rows.slice(a, b - a)) if whole else None)
        for name, kind in _RESULT[mode]:
            cells = [pa.nulls(b - a, kind) if p is None else pa.array(p[name], kind, from_pandas=True)
                     for p, a, b in zip(parts, bounds[:-1].tolist(), bounds[1:].tolist())]
            rows = rows.append_column(name, pa.concat_arrays(cells))
        return rows.append_column("done", pa.array(done)).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the batch cut by an Arrow boundary
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*held, b])
            ids = rows.column("batch_id").to_numpy()
            at = int(np.searchsorted(ids, ids[-1]))
            if at:
                yield scored(rows.slice(0, at))
            held = rows.slice(at).combine_chunks().to_batches()
        if held:
            yield scored(pa.Table.from_batches(held))

    return run


def score_prompts(df: DataFrame, scorer: Callable, mode: str = "tokens", batch_size: int = 6,
                  instr: str | None = None, id_col: str = "triplet_id", prompt_col: str = "format_str",
                  head_col: str = "item_x", y_col: str = "item_y", z_col: str = "item_z",
                  strip_prompt_echo: bool = True, use_length_bucketing: bool = True,
                  pass_cols: tuple = (), vision: bool = False, chat: bool = False) -> DataFrame:
    """Score prompts batch-wise and resolve each answer to (head, winner, loser).

    tokens -> ``id, batch_id, head, winner, loser, raw_generation`` (cleaned text);
    logits -> ``id, batch_id, head, winner, loser, lp_y1, lp_z1, y_tok, z_tok``; both with the ``pass_cols``.
    ``vision`` frames the prompt for an image model and cleans by label and tag; ``chat`` hands the scorer the
    message column."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    if vision and mode == "logits":
        raise NotImplementedError("an image model answers in tokens mode only")
    for c in (id_col, prompt_col, head_col, y_col, z_col):
        if c not in df.columns:
            raise ValueError(f"the prompts have no column {c!r}")
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    text = vlm_prompt(F.col(prompt_col), instr) if vision else add_suffix(F.col(prompt_col), instr)
    extra = [chat_messages(F.col(prompt_col), instr).alias("messages")] if chat else []
    base = df.select(F.col(id_col).alias("id"), text.alias("text"), F.col(head_col).cast("string").alias("head"),
                     F.col(y_col).cast("string").alias("y"), F.col(z_col).cast("string").alias("z"), *extra, *pass_cols)
    passed = base.columns[5 + len(extra):]
    counted = Observation()
    batched = batch_ids(base, "id", "text", batch_size, use_length_bucketing, counted=counted).sortWithinPartitions("batch_id", "batch_pos")
    out = T.StructType([*batched.schema.fields, *T.StructType.fromDDL(_RESULT_SQL[mode] + ", done boolean").fields])
    answer = ["raw_generation"] if mode == "tokens" else ["lp_y1", "lp_z1", "y_tok", "z_tok"]

    def one_pass(rows: DataFrame, edges: bool) -> DataFrame:
        """Scored and resolved in one job; prompts are kept of rows left for the second pass only."""
        scored = rows.mapInArrow(_runner(scorer, mode, counted.get["n"], batch_size, edges), out)
        if mode == "tokens":
            cleaned = strip_think(strip_label(F.col("raw"))) if vision else clean_generation(F.col("text"), F.col("raw"), strip_prompt_echo)
            scored = scored.withColumn("raw_generation", cleaned)
            winner, loser = resolve_choice(match_first(F.col("raw_generation"), F.col("y"), F.col("z")), F.col("y"), F.col("z"))
        else:
            winner, loser = logprob_choice(F.col("lp_y1"), F.col("lp_z1"), F.col("y"), F.col("z"))
        left = [F.when(~F.col("done"), F.col(c)).alias(c) for c in ("text", "y", "z", *(["messages"] if chat else []))]
        return scored.select("id", "head", *left, *passed, "batch_id", "batch_pos", winner.alias("winner"), loser.alias("loser"), *answer, "done").checkpoint(eager=True)

    first = one_pass(batched, True)
    cut = first.filter(~F.col("done")).select(*batched.columns).repartition("batch_id").sortWithinPartitions("batch_id", "batch_pos")
    scored = first.filter("done").unionByName(one_pass(cut, False))
    return scored.select("id", "batch_id", "head", "winner", "loser", *answer, *passed)
