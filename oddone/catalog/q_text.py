"""Answer-cleaning and choice queries: X2-X7, A3, X17-X19, K7."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog import sqltext as S
from oddone.catalog.fixtures import TURNS_SQL, read, turns, with_sql
from oddone.functions import text as T
from oddone.functions.vectors import first_token, log_softmax_at, logprob_choice

Y, Z, Z2 = "the", "of", "and"


@query("match_first", f"SELECT doc_id, {S.match_first('text', repr(Y), repr(Z))} AS chosen FROM documents")
def q_match_first(spark, d):
    doc = read(spark, d, "documents")
    return doc.select("doc_id", T.match_first("text", F.lit(Y), F.lit(Z)).alias("chosen"))


@query("match_first_n", f"""
SELECT doc_id, (SELECT c FROM (VALUES ('{Y}', 0), ('{Z}', 1), ('{Z2}', 2)) v(c, o)
                WHERE strpos(lower(text), c) > 0 ORDER BY strpos(lower(text), c), o LIMIT 1) AS chosen
FROM documents""")
def q_match_first_n(spark, d):
    doc = read(spark, d, "documents")
    return doc.select("doc_id", T.match_first_n("text", [F.lit(Y), F.lit(Z), F.lit(Z2)]).alias("chosen"))


@query("resolve_answers", f"""
SELECT doc_id, doc_id::VARCHAR AS head,
       CASE ch WHEN '{Y}' THEN '{Y}' WHEN '{Z}' THEN '{Z}' END AS winner,
       CASE ch WHEN '{Y}' THEN '{Z}' WHEN '{Z}' THEN '{Y}' END AS loser
FROM (SELECT doc_id, {S.match_first('text', repr(Y), repr(Z))} AS ch FROM documents) t""")
def q_resolve_answers(spark, d):
    doc = read(spark, d, "documents")
    chosen = T.match_first("text", F.lit(Y), F.lit(Z))
    w, l_ = T.resolve_choice(chosen, F.lit(Y), F.lit(Z))
    return doc.select("doc_id", F.col("doc_id").cast("string").alias("head"), w.alias("winner"), l_.alias("loser"))


def _think_gen():
    return F.concat(F.col("prompt"), F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit(" <think> ")).otherwise(F.lit(" ")),
                    F.col("reply"))


_THINK_GEN_SQL = "prompt || CASE WHEN conv_id % 2 = 0 THEN ' <think> ' ELSE ' ' END || reply"


@query("strip_think", with_sql(TURNS_SQL, body=f"""
SELECT conv_id, turn, {S.strip_think(_THINK_GEN_SQL)} AS cleaned FROM turns"""))
def q_strip_think(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.strip_think(_think_gen()).alias("cleaned"))


@query("strip_echo", with_sql(TURNS_SQL, body=f"""
SELECT conv_id, turn, {S.strip_echo('prompt', 'generation')} AS cleaned FROM turns"""))
def q_strip_echo(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.strip_echo("prompt", "generation").alias("cleaned"))


_LABEL_GEN_SQL = "('User: ' || prompt || ' Falcon: ' || reply)"


@query("strip_label", with_sql(TURNS_SQL, body=f"""
SELECT conv_id, turn, {S.strip_label(_LABEL_GEN_SQL)} AS cleaned FROM turns"""))
def q_strip_label(spark, d):
    g = F.concat(F.lit("User: "), F.col("prompt"), F.lit(" Falcon: "), F.col("reply"))
    return turns(spark, d).select("conv_id", "turn", T.strip_label(g).alias("cleaned"))


@query("logprob_pick", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS l, list_max(embedding::DOUBLE[]) AS m FROM embeddings),
s AS (SELECT *, ln(list_sum(list_transform(l, lambda v: exp(v - m)))) AS lse FROM e)
SELECT vec_id, round(l[label + 1] - m - lse, 6) AS lp_y, round(l[(vec_id % 64) + 1] - m - lse, 6) AS lp_z FROM s""")
def q_logprob_pick(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("l"))
    return e.select("vec_id", F.round(log_softmax_at("l", F.col("label")), 6).alias("lp_y"),
                    F.round(log_softmax_at("l", F.pmod("vec_id", F.lit(64))), 6).alias("lp_z"))


@query("logprob_choice", """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE l_discount END AS lp_y,
                  l_tax AS lp_z FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CASE WHEN isnan(lp_y) OR isnan(lp_z) THEN NULL WHEN lp_y > lp_z THEN 'discount' WHEN lp_z > lp_y THEN 'tax' END AS winner,
       CASE WHEN isnan(lp_y) OR isnan(lp_z) THEN NULL WHEN lp_y > lp_z THEN 'tax' WHEN lp_z > lp_y THEN 'discount' END AS loser
FROM t""")
def q_logprob_choice(spark, d):
    li = read(spark, d, "lineitem")
    lp_y = F.when(F.pmod("l_partkey", F.lit(17)) == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    w, l_ = logprob_choice(lp_y, F.col("l_tax"), F.lit("discount"), F.lit("tax"))
    return li.select("l_orderkey", "l_linenumber", w.alias("winner"), l_.alias("loser"))


# token ids of a text = lengths of its words longer than six characters; EOS id = -1
@query("first_token", f"""
SELECT conv_id, turn,
       coalesce(list_transform(list_filter({S.split('text')}, lambda w: length(w) > 6), lambda w: length(w))[1], -1)::BIGINT AS first_tok
FROM conversations""")
def q_first_token(spark, d):
    c = read(spark, d, "conversations")
    ids = F.transform(F.filter(T.py_split("text"), lambda w: F.length(w) > 6), lambda w: F.length(w).cast("long"))
    return c.select("conv_id", "turn", first_token(ids, F.lit(-1).cast("long")).alias("first_tok"))


@query("safe_name", "SELECT p_partkey, translate(p_brand || '/' || p_name, '/ ', '__') AS safe FROM part")
def q_safe_name(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", T.safe_name(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"))).alias("safe"))
