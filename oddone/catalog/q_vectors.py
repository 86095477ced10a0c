"""Concept / vector queries: S1, S2, J1, A2, K3, K4, P4 (+J3 counts), J2."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.sinks.writers import wide_embedding
from oddone.catalog.fixtures import ANSWERS_SQL, ITEMS_SQL, NAMES_SQL, answers, items, names, read, with_sql
from oddone.functions.vectors import from_text, to_text, vec_sum
from oddone.operators.indexing import dense_index
from oddone.operators.vectors import candidates, first_vector, near_far_counts, triplet_distances, zip_matrix
from oddone.sources.files import parse_matrix_lines

NEAR, FAR = 1.35, 1.45


def _matrix(spark, d):
    """Matrix rows of the embeddings table: ``(row_idx, vec)`` in vec_id order."""
    return items(spark, d).select("row_idx", "vec")


@query("scan_concepts", """
SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS row_idx, p_name AS key,
       p_brand AS brand, p_type AS type, p_size::VARCHAR AS size
FROM part""")
def q_scan_concepts(spark, d):
    p = read(spark, d, "part")
    p = dense_index(p, ["p_partkey"], "row_idx")
    return p.select("row_idx", F.col("p_name").cast("string").alias("key"), F.col("p_brand").cast("string").alias("brand"),
                    F.col("p_type").cast("string").alias("type"), F.col("p_size").cast("string").alias("size"))


@query("zip_matrix", with_sql(NAMES_SQL, ITEMS_SQL, body="""
SELECT n.row_idx, n.key, len(i.vec)::BIGINT AS dim, round(list_sum(i.vec), 6) AS vec_sum
FROM names n JOIN items i ON i.row_idx = n.row_idx"""))
def q_zip_matrix(spark, d):
    z = zip_matrix(names(spark, d), _matrix(spark, d))
    return z.select("row_idx", "key", F.size("vec").cast("long").alias("dim"), F.round(vec_sum("vec"), 6).alias("vec_sum"))


@query("first_vector", with_sql(NAMES_SQL, ITEMS_SQL, body="""
, z AS (SELECT n.row_idx, n.key, i.vec FROM names n JOIN items i ON i.row_idx = n.row_idx)
SELECT key, min(row_idx) AS first_row_idx, count(*) AS n_rows, round(list_sum(arg_min(vec, row_idx)), 6) AS vec_sum
FROM z GROUP BY key"""))
def q_first_vector(spark, d):
    fv = first_vector(zip_matrix(names(spark, d), _matrix(spark, d)))
    return fv.select("key", "first_row_idx", "n_rows", F.round(vec_sum("vec"), 6).alias("vec_sum"))


# Text lines of a vector file formed from the tables: one line per embedding (every tenth
# with a trailing comment), comment lines from region and whitespace-only lines from nation.
def _matrix_text(spark, d):
    emb = read(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    data = emb.select((F.col("vec_id") * 3 + 2).alias("line_no"),
                      F.concat(to_text(v), F.when(F.pmod(F.col("vec_id"), F.lit(10)) == 0, F.lit("  # trailing"))
                               .otherwise(F.lit(""))).alias("value"))
    com = read(spark, d, "region").select((F.col("r_regionkey") * 3 * 97).cast("long").alias("line_no"),
                                         F.concat(F.lit("# "), F.col("r_name")).alias("value"))
    blank = read(spark, d, "nation").select((F.col("n_nationkey") * 3 * 19 + 1).cast("long").alias("line_no"),
                                           F.lit("  \t ").alias("value"))
    return data.unionByName(com).unionByName(blank)


_MATRIX_TEXT_SQL = """lines AS (
  SELECT vec_id * 3 + 2 AS line_no,
         array_to_string(list_transform(embedding::DOUBLE[], lambda x: x::VARCHAR), ' ')
           || CASE WHEN vec_id % 10 = 0 THEN '  # trailing' ELSE '' END AS value FROM embeddings
  UNION ALL SELECT r_regionkey * 3 * 97, '# ' || r_name FROM region
  UNION ALL SELECT n_nationkey * 3 * 19 + 1, '  \t ' FROM nation),
parsed AS (
  SELECT line_no, trim(regexp_replace(value, '#.*$', ''), ' \t\r\n') AS t FROM lines),
mat AS (
  SELECT (row_number() OVER (ORDER BY line_no) - 1)::BIGINT AS row_idx,
         list_transform(regexp_split_to_array(t, '\\s+'), lambda x: x::DOUBLE) AS vec
  FROM parsed WHERE t <> '')"""


@query("scan_matrix", with_sql(_MATRIX_TEXT_SQL, body="""
SELECT row_idx, len(vec)::BIGINT AS dim, round(list_sum(vec), 6) AS vec_sum FROM mat"""))
def q_scan_matrix(spark, d):
    m = parse_matrix_lines(_matrix_text(spark, d))
    return m.select("row_idx", F.size("vec").cast("long").alias("dim"), F.round(vec_sum("vec"), 6).alias("vec_sum"))


@query("embedding_stringify", with_sql(ITEMS_SQL, body="""
, s AS (SELECT key AS item, array_to_string(list_transform(vec, lambda x: x::VARCHAR), ' ') AS embedding FROM items)
SELECT item, len(string_split(embedding, ' '))::BIGINT AS n_values,
       round(list_sum(list_transform(string_split(embedding, ' '), lambda x: x::DOUBLE)), 6) AS value_sum
FROM s"""))
def q_embedding_stringify(spark, d):
    it = items(spark, d)
    fv = first_vector(it)
    s = fv.select(F.col("key").alias("item"), to_text("vec").alias("embedding"))
    back = from_text("embedding")
    return s.select("item", F.size(back).cast("long").alias("n_values"), F.round(vec_sum(back), 6).alias("value_sum"))


def _dims(spark, d) -> int:
    return read(spark, d, "embeddings").select(F.size("embedding")).first()[0]


def _wide_sql(dim: int) -> str:
    cols = ", ".join(f"round(vec[{i + 1}], 6) AS dim_{i}" for i in range(dim))
    return with_sql(ITEMS_SQL, body=f"""
SELECT key AS item, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS id, {cols} FROM items""")


@query("embedding_wide", _wide_sql(64))
def q_embedding_wide(spark, d):
    it = items(spark, d)
    dim = _dims(spark, d)
    idx = dense_index(it.select(F.col("key").alias("item"), "vec"), ["item"], "id")
    wide = wide_embedding(idx, dim)
    return wide.withColumns({f"dim_{i}": F.round(f"dim_{i}", 6) for i in range(dim)})


@query("near_far_counts", with_sql(ITEMS_SQL, body=f"""
, p AS (SELECT x.key, list_distance(x.vec, o.vec) AS d FROM items x JOIN items o ON o.key <> x.key)
SELECT key, count(*) AS n_cand, count(*) FILTER (WHERE d < {NEAR}) AS n_near,
       count(*) FILTER (WHERE d > {FAR}) AS n_far, count(*) FILTER (WHERE d < {NEAR} AND d > {FAR}) AS n_both,
       round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist
FROM p GROUP BY key"""))
def q_near_far_counts(spark, d):
    it = items(spark, d)
    cand = candidates(it, first_vector(it))
    out = near_far_counts(cand, NEAR, FAR)
    return out.withColumn("min_dist", F.round("min_dist", 6)).withColumn("max_dist", F.round("max_dist", 6))


@query("triplet_distances", with_sql(ITEMS_SQL, ANSWERS_SQL, body="""
SELECT a.answer_id, a.head, a.winner, a.loser,
       round(list_distance(h.vec, w.vec), 6) AS dist_head_winner,
       round(list_distance(h.vec, l.vec), 6) AS dist_head_loser,
       round(list_distance(w.vec, l.vec), 6) AS dist_winner_loser
FROM answers a JOIN items h ON h.key = a.head JOIN items w ON w.key = a.winner JOIN items l ON l.key = a.loser"""))
def q_triplet_distances(spark, d):
    it = items(spark, d)
    a = answers(spark, d).select("answer_id", "head", "winner", "loser")
    n_items = it.count()
    out = triplet_distances(a, it.select("key", "vec"), "head", "winner", "loser", n_vec_rows=n_items)
    out = out.filter(F.col("dist_head_winner").isNotNull() & F.col("dist_head_loser").isNotNull())
    for c in ("dist_head_winner", "dist_head_loser", "dist_winner_loser"):
        out = out.withColumn(c, F.round(c, 6))
    return out
