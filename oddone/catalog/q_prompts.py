"""Prompt queries: X1 render, P9 preview, X8 suffix, X9 chat messages, X10 image prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import PROMPTS_SQL, prompts, with_sql
from oddone.catalog.q_sampling import STIMULI_CTES, shuffled_stimuli
from oddone.functions.prompts import TRIPLET_TEMPLATE, add_suffix, chat_messages, preview, render_template, vlm_prompt

SUFFIX = "Answer: "


def render_sql(template: str, x="item_x", y="shuffled_item_y", z="shuffled_item_z") -> str:
    import string
    parts = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            parts.append("'" + lit.replace("'", "''") + "'")
        if field is not None:
            parts.append({"item_x": x, "item_y": y, "item_z": z}[field])
    return " || ".join(parts)


def rendered(spark, d):
    st = shuffled_stimuli(spark, d)
    return st.withColumn("format_str", render_template(TRIPLET_TEMPLATE, {
        "item_x": "item_x", "item_y": "shuffled_item_y", "item_z": "shuffled_item_z"}))


@query("render_prompt", STIMULI_CTES + f"""
SELECT triplet_id, {render_sql(TRIPLET_TEMPLATE)} AS format_str FROM st""")
def q_render_prompt(spark, d):
    return rendered(spark, d).select("triplet_id", "format_str")


@query("prompt_preview", with_sql(PROMPTS_SQL, body="""
SELECT conv_id, turn, left(prompt, 80) || CASE WHEN length(prompt) > 80 THEN '...' ELSE '' END AS preview FROM prompts"""))
def q_prompt_preview(spark, d):
    return prompts(spark, d).select("conv_id", "turn", preview("prompt").alias("preview"))


def _instr():
    return F.when(F.pmod("conv_id", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.lit(SUFFIX))

_INSTR_SQL = f"CASE WHEN conv_id % 3 = 0 THEN NULL ELSE '{SUFFIX}' END"


@query("add_suffix", with_sql(PROMPTS_SQL, body=f"""
SELECT conv_id, turn, prompt || coalesce({_INSTR_SQL}, '') AS text FROM prompts"""))
def q_add_suffix(spark, d):
    return prompts(spark, d).select("conv_id", "turn", add_suffix("prompt", _instr()).alias("text"))


@query("chat_messages", with_sql(PROMPTS_SQL, body=f"""
SELECT conv_id, turn, to_json([{{'role': 'user', 'content': prompt || coalesce({_INSTR_SQL}, '')}}])::VARCHAR AS messages
FROM prompts"""))
def q_chat_messages(spark, d):
    return prompts(spark, d).select("conv_id", "turn", F.to_json(chat_messages("prompt", _instr())).alias("messages"))


@query("vlm_prompt", with_sql(PROMPTS_SQL, body=f"""
SELECT conv_id, turn, 'User:<image>' || chr(10) || prompt || coalesce({_INSTR_SQL}, '') || ' Falcon:' AS vlm FROM prompts"""))
def q_vlm_prompt(spark, d):
    return prompts(spark, d).select("conv_id", "turn", vlm_prompt("prompt", _instr()).alias("vlm"))
