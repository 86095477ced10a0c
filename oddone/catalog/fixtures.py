"""Adapters from the driver tables to the reference's inputs, stated twice: as Spark
DataFrames and as SQL common-table expressions for the oracle.

* items   embeddings -> key ``'item_'||vec_id``, dense ``row_idx`` by vec_id, ``vec`` DOUBLE[]
* names   part -> ``row_idx`` = dense rank of p_partkey, ``key`` = p_name (duplicates on purpose)
* turns   each user turn of conversations with the assistant's next turn
* answers triplets ``(v, (7v+3)%n, (11v+5)%n)`` over vec_id as model answers (see below)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddone.operators.indexing import dense_index

SEED = 42


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- items
def items(spark, d) -> DataFrame:
    emb = read(spark, d, "embeddings").select("vec_id", "embedding")
    out = emb.select(F.concat(F.lit("item_"), F.col("vec_id").cast("string")).alias("key"),
                     F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return dense_index(out, ["vec_id"], "row_idx").drop("vec_id")


ITEMS_SQL = """items AS (
  SELECT 'item_' || vec_id AS key, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_idx,
         embedding::DOUBLE[] AS vec
  FROM embeddings)"""


# ---------------------------------------------------------------- names
def names(spark, d) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return dense_index(p, ["p_partkey"], "row_idx").select("row_idx", F.col("p_name").alias("key"))


NAMES_SQL = """names AS (
  SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS row_idx, p_name AS key FROM part)"""


# ---------------------------------------------------------------- turns
def turns(spark, d) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id", "turn", "prompt", "reply",
        F.concat(F.col("prompt"), F.lit(" "), F.col("reply")).alias("generation"))


TURNS_SQL = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS reply, u.text || ' ' || a.text AS generation
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


# ---------------------------------------------------------------- prompts
# every row of conversations, its text as the prompt
def prompts(spark, d) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))


PROMPTS_SQL = "prompts AS (SELECT conv_id, turn, text AS prompt FROM conversations)"


# ---------------------------------------------------------------- answers
# head v, winner (7v+3) % n, loser (11v+5) % n over all n embeddings; rows whose three ids are not
# distinct are dropped; winner and loser are NULL (unresolved answer) when v % 17 = 0; the loser is
# the missing-item sentinel '-1' when v % 19 = 0; run = v % 4.
def answers(spark, d) -> DataFrame:
    emb = read(spark, d, "embeddings").select("vec_id")
    n = F.lit(emb.count())  # scalar, one small job
    v = F.col("vec_id")
    w = F.pmod(v * 7 + 3, n)
    l_ = F.pmod(v * 11 + 5, n)
    base = emb.select(v.alias("v"), w.alias("w"), l_.alias("l")).filter(
        (F.col("v") != F.col("w")) & (F.col("v") != F.col("l")) & (F.col("w") != F.col("l")))

    def item(c):
        return F.concat(F.lit("item_"), F.col(c).cast("string"))

    unresolved = F.pmod(F.col("v"), F.lit(17)) == 0
    return base.select(
        F.col("v").alias("answer_id"), F.pmod(F.col("v"), F.lit(4)).alias("run"),
        item("v").alias("head"),
        F.when(unresolved, F.lit(None).cast("string")).otherwise(item("w")).alias("winner"),
        F.when(unresolved, F.lit(None).cast("string"))
         .when(F.pmod(F.col("v"), F.lit(19)) == 0, F.lit("-1")).otherwise(item("l")).alias("loser"))


ANSWERS_SQL = """answers AS (
  SELECT v AS answer_id, v % 4 AS run, 'item_' || v AS head,
         CASE WHEN v % 17 = 0 THEN NULL ELSE 'item_' || w END AS winner,
         CASE WHEN v % 17 = 0 THEN NULL WHEN v % 19 = 0 THEN '-1' ELSE 'item_' || l END AS loser
  FROM (SELECT vec_id AS v, (7 * vec_id + 3) % n AS w, (11 * vec_id + 5) % n AS l
        FROM embeddings, (SELECT count(*) AS n FROM embeddings) c) t
  WHERE v <> w AND v <> l AND w <> l)"""


def hash_sql(*parts: str) -> str:
    """DuckDB form of :func:`oddone.functions.hashing.seeded_hash`."""
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body

