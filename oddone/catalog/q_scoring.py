"""Scoring queries: F1 (tokens, logits), W2 length buckets, A6/W3 batch progress, J10, K1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog import sqltext as S
from oddone.catalog.fixtures import read
from oddone.catalog.q_prompts import SUFFIX, render_sql, rendered
from oddone.catalog.q_sampling import STIMULI_CTES
from oddone.functions.prompts import TRIPLET_TEMPLATE
from oddone.operators.scoring import LoadOnce, batch_ids, batch_progress, score_prompts

BATCH = 4  # shipped batch size


def nearer_text_scorer(batch: pd.DataFrame) -> list[str]:
    """Deterministic stand-in model: echoes the prompt and names the item nearer to x."""
    nearer = batch["y"].where(batch["dist_x_y"] <= batch["dist_x_z"], batch["z"])
    return (batch["text"] + " The answer is " + nearer + ".").tolist()


def nearer_logits_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in logits: log-prob = minus the distance; token id = length of the item name."""
    return pd.DataFrame({"lp_y1": -batch["dist_x_y"], "lp_z1": -batch["dist_x_z"],
                         "y_tok": batch["y"].str.len().astype("int32"), "z_tok": batch["z"].str.len().astype("int32")})


def _scored(spark, d, mode, more=(), **kw):
    scorer = nearer_text_scorer if mode == "tokens" else nearer_logits_scorer
    kw.setdefault("instr", SUFFIX)
    return score_prompts(rendered(spark, d), kw.pop("scorer", scorer), mode=mode, batch_size=BATCH,
                         pass_cols=(F.col("dist_x_y"), F.col("dist_x_z"), *more), **kw)


_TEXT = f"({render_sql(TRIPLET_TEMPLATE)} || '{SUFFIX}')"
_SCORED_CTES = STIMULI_CTES + f""",
pr AS (SELECT *, {_TEXT} AS text FROM st),
bt AS (SELECT *, ((row_number() OVER (ORDER BY length(text), triplet_id) - 1) // {BATCH})::BIGINT AS batch_id FROM pr),
gen AS (SELECT *, text || ' The answer is ' || CASE WHEN dist_x_y <= dist_x_z THEN item_y ELSE item_z END || '.' AS raw
        FROM bt),
cl AS (SELECT *, {S.strip_echo('text', S.strip_think('raw'))} AS raw_generation FROM gen),
ch AS (SELECT *, {S.match_first('raw_generation', 'item_y', 'item_z')} AS chosen FROM cl)"""


@query("score_tokens", _SCORED_CTES + """
SELECT triplet_id AS id, batch_id, item_x AS head,
       CASE WHEN chosen = item_y THEN item_y WHEN chosen = item_z THEN item_z END AS winner,
       CASE WHEN chosen = item_y THEN item_z WHEN chosen = item_z THEN item_y END AS loser, raw_generation
FROM ch""")
def q_score_tokens(spark, d):
    return _scored(spark, d, "tokens").drop("dist_x_y", "dist_x_z")


@query("score_logits", STIMULI_CTES + f""",
pr AS (SELECT *, {_TEXT} AS text FROM st),
bt AS (SELECT *, ((row_number() OVER (ORDER BY length(text), triplet_id) - 1) // {BATCH})::BIGINT AS batch_id FROM pr)
SELECT triplet_id AS id, batch_id, item_x AS head,
       CASE WHEN -dist_x_y > -dist_x_z THEN item_y WHEN -dist_x_z > -dist_x_y THEN item_z END AS winner,
       CASE WHEN -dist_x_y > -dist_x_z THEN item_z WHEN -dist_x_z > -dist_x_y THEN item_y END AS loser,
       round(-dist_x_y, 6) AS lp_y1, round(-dist_x_z, 6) AS lp_z1, length(item_y)::INTEGER AS y_tok,
       length(item_z)::INTEGER AS z_tok
FROM bt""")
def q_score_logits(spark, d):
    out = _scored(spark, d, "logits").drop("dist_x_y", "dist_x_z")
    return out.withColumn("lp_y1", F.round("lp_y1", 6)).withColumn("lp_z1", F.round("lp_z1", 6))


@query("answers_in_order", _SCORED_CTES + """
SELECT triplet_id, attempt_id, item_x, item_y, item_z,
       CASE WHEN chosen = item_y THEN item_y WHEN chosen = item_z THEN item_z END AS winner,
       CASE WHEN chosen = item_y THEN item_z WHEN chosen = item_z THEN item_y END AS loser
FROM ch""")
def q_answers_in_order(spark, d):
    sc = _scored(spark, d, "tokens", (F.col("attempt_id"), F.col("item_x"), F.col("item_y"), F.col("item_z")))
    return sc.select(F.col("id").alias("triplet_id"), "attempt_id", "item_x", "item_y", "item_z", "winner", "loser")


def image_scorer(batch: pd.DataFrame) -> list[str]:
    """Stand-in image model: echoes its frame, thinks, and names the nearer item."""
    nearer = batch["y"].where(batch["dist_x_y"] <= batch["dist_x_z"], batch["z"])
    return (batch["text"] + " " + batch["head"] + "? <think> so \n" + nearer + " ").tolist()


def chat_scorer(batch: pd.DataFrame) -> list[str]:
    """Stand-in chat model: answers the user's turn."""
    nearer = batch["y"].where(batch["dist_x_y"] <= batch["dist_x_z"], batch["z"])
    return [f"{len(m)} {m[0]['role']} {len(m[0]['content'])}: {n}" for m, n in zip(batch["messages"], nearer)]


@query("score_vision", STIMULI_CTES + f""",
pr AS (SELECT *, 'User:<image>' || chr(10) || {_TEXT} || ' Falcon:' AS text FROM st),
bt AS (SELECT *, ((row_number() OVER (ORDER BY length(text), triplet_id) - 1) // {BATCH})::BIGINT AS batch_id FROM pr),
cl AS (SELECT *, 'so ' || chr(10) || CASE WHEN dist_x_y <= dist_x_z THEN item_y ELSE item_z END AS raw_generation FROM bt),
ch AS (SELECT *, {S.match_first('raw_generation', 'item_y', 'item_z')} AS chosen FROM cl)
SELECT triplet_id AS id, batch_id, item_x AS head,
       CASE WHEN chosen = item_y THEN item_y WHEN chosen = item_z THEN item_z END AS winner,
       CASE WHEN chosen = item_y THEN item_z WHEN chosen = item_z THEN item_y END AS loser, raw_generation FROM ch""")
def q_score_vision(spark, d):
    return _scored(spark, d, "tokens", scorer=image_scorer, vision=True).drop("dist_x_y", "dist_x_z")


@query("score_chat", STIMULI_CTES + f""",
pr AS (SELECT *, {_TEXT} AS text FROM st),
bt AS (SELECT *, ((row_number() OVER (ORDER BY length(text), triplet_id) - 1) // {BATCH})::BIGINT AS batch_id FROM pr),
cl AS (SELECT *, '1 user ' || length(text) || ': ' || CASE WHEN dist_x_y <= dist_x_z THEN item_y ELSE item_z END AS raw_generation FROM bt),
ch AS (SELECT *, {S.match_first('raw_generation', 'item_y', 'item_z')} AS chosen FROM cl)
SELECT triplet_id AS id, batch_id, item_x AS head,
       CASE WHEN chosen = item_y THEN item_y WHEN chosen = item_z THEN item_z END AS winner,
       CASE WHEN chosen = item_y THEN item_z WHEN chosen = item_z THEN item_y END AS loser, raw_generation FROM ch""")
def q_score_chat(spark, d):
    return _scored(spark, d, "tokens", scorer=LoadOnce(lambda: chat_scorer), chat=True, strip_prompt_echo=False).drop("dist_x_y", "dist_x_z")


@query("export_stimuli", STIMULI_CTES + f"""
SELECT triplet_id, item_x, item_y, item_z, round(dist_x_y, 6) AS dist_x_y, round(dist_x_z, 6) AS dist_x_z,
       round(dist_y_z, 6) AS dist_y_z, shuffled_item_y, shuffled_item_z, {render_sql(TRIPLET_TEMPLATE)} AS format_str
FROM st""")
def q_export_stimuli(spark, d):
    st = rendered(spark, d)
    for c in ("dist_x_y", "dist_x_z", "dist_y_z"):
        st = st.withColumn(c, F.round(c, 6))
    return st.select("triplet_id", "item_x", "item_y", "item_z", "dist_x_y", "dist_x_z", "dist_y_z",
                     "shuffled_item_y", "shuffled_item_z", "format_str")


def _lengths(spark, d):
    """Ids and lengths of the documents: batches are numbered without moving a text."""
    return read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("len"))


@query("length_buckets", f"""
SELECT doc_id, length(text)::BIGINT AS len,
       ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // {BATCH})::BIGINT AS batch_id,
       ((row_number() OVER (ORDER BY length(text), doc_id) - 1) % {BATCH})::BIGINT AS batch_pos
FROM documents""")
def q_length_buckets(spark, d):
    return batch_ids(_lengths(spark, d), "doc_id", "text", BATCH, len_col="len").select("doc_id", "len", "batch_id", "batch_pos")


@query("batch_progress", f"""
WITH b AS (SELECT ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // {BATCH})::BIGINT AS batch_id FROM documents),
g AS (SELECT batch_id, count(*) AS batch_n FROM b GROUP BY batch_id)
SELECT batch_id, batch_n, (sum(batch_n) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS processed
FROM g""")
def q_batch_progress(spark, d):
    counted = Observation()
    batched = batch_ids(_lengths(spark, d), "doc_id", "text", BATCH, len_col="len", counted=counted)
    return batch_progress(batched, BATCH, counted.get["n"])


# Flagship: the minimum slice end to end — items and vectors -> constrained draw -> y/z shuffle ->
# prompt -> batch scoring -> answer resolution -> how often each item wins.
@query("wins_per_item", _SCORED_CTES + """
SELECT item, count(*) AS wins FROM (
  SELECT CASE WHEN chosen = item_y THEN item_y WHEN chosen = item_z THEN item_z END AS item FROM ch) w
WHERE item IS NOT NULL GROUP BY item""")
def q_wins_per_item(spark, d):
    sc = _scored(spark, d, "tokens")
    return sc.filter(F.col("winner").isNotNull()).groupBy(F.col("winner").alias("item")).agg(
        F.count(F.lit(1)).alias("wins"))
