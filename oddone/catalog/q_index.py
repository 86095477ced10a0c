"""Answer-table queries: S3, S4, A1/W1/U1/U2/P3 item index, J5, J4, A5, H4."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import ANSWERS_SQL, ITEMS_SQL, answers, items, read, with_sql
from oddone.catalog.q_sampling import STIMULI_CTES, stimuli
from oddone.operators.embedding import item_index, map_lenient, map_strict, split_train_test
from oddone.functions.text import safe_name
from oddone.operators.indexing import dense_index
from oddone.operators.manifest import parse_manifest
from oddone.session import checkpoint_dir, ensure_checkpoint_dir
from oddone.sinks.writers import wide_embedding, write_answers, write_embedding
from oddone.sources.files import read_answers, read_results

SEED = 42

_IDX_SQL = """idx AS (
  SELECT run, item, (row_number() OVER (PARTITION BY run ORDER BY item) - 1)::BIGINT AS id
  FROM (SELECT DISTINCT run, item FROM (
          SELECT run, head AS item FROM answers UNION ALL SELECT run, winner FROM answers
          UNION ALL SELECT run, loser FROM answers) u
        WHERE item IS NOT NULL AND item <> '-1') d)"""


@query("scan_answers", with_sql(ANSWERS_SQL, body="SELECT answer_id, run, head, winner, loser FROM answers"))
def q_scan_answers(spark, d):
    """Through the reader: the answers are written as CSV (columns in another order) and read back."""
    a = answers(spark, d)
    tag = F.concat_ws(":", "answer_id", "run").alias("raw_generation")
    back = read_answers(spark, _written(spark, a.select(tag, "loser", "winner", "head")))
    tags = F.split("raw_generation", ":")
    return back.select(F.get(tags, F.lit(0)).cast("long").alias("answer_id"), F.get(tags, F.lit(1)).cast("long").alias("run"),
                       "head", "winner", "loser")


def _written(spark, df) -> str:
    """A folder of CSV files below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


# a folder of answer files, one run per file: the runs as the files' names tell them, with their answers and files
@query("folder_runs", with_sql(ANSWERS_SQL, body="""
SELECT run, count(*) AS n_rows, 1::BIGINT AS n_files FROM answers GROUP BY run"""))
def q_folder_runs(spark, d):
    """The number in a file's name is that of the task that wrote it, and task k writes run k: ``run`` is read from the
    name alone, while the rows under it are those whose own text names that run."""
    a = answers(spark, d).select("head", "winner", "loser", F.col("run").cast("int").alias("n"))
    n_runs = (a.agg(F.max("n")).first()[0] or 0) + 1
    path = _written(spark, a.repartitionById(n_runs, "n").select("head", "winner", "loser", F.col("n").cast("string").alias("raw_generation")))
    runs = read_answers(spark, path, run_from_file=True)
    runs = runs.withColumn("named", F.regexp_extract("run", "^part-0*(\\d+)-", 1).cast("long"))
    return runs.filter(F.col("named") == F.col("raw_generation").cast("long")).groupBy(F.col("named").alias("run")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run").alias("n_files"))


# the same answers as a table by (version, model, stimulus), written twice as a rerun does, and read by a manifest
def _written_by_model(spark, d):
    a = answers(spark, d)
    ensure_checkpoint_dir(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    model = F.concat(F.lit("org/m"), F.col("run").cast("string"))
    text = F.concat(F.when(F.col("run") % 3 == 0, F.lit("triplet_run_1_a ")).otherwise(F.lit("embedding_1_a ")), model, F.lit(" THINGS version_dir=1a"))
    lines = parse_manifest(a.select("run").distinct().select(F.col("run").alias("line_no"), text.alias("value")))
    return a.withColumn("model", model), path, lines.filter(F.col("experiment") == "embedding_1_a")


@query("answers_by_manifest", with_sql(ANSWERS_SQL, body="""
SELECT '1a' AS version, 'org/m' || run AS model, 'THINGS' AS stimulus, count(*) AS n_rows, count(winner) AS n_resolved, count(DISTINCT head) AS n_heads
FROM answers WHERE run % 3 <> 0 GROUP BY run"""))
def q_answers_by_manifest(spark, d):
    a, path, lines = _written_by_model(spark, d)
    for _ in range(2):
        write_answers(a.select("head", "winner", "loser", "model"), path, version="1a", stimulus="THINGS")
    return read_results(spark, path, lines).groupBy("version", "model", "stimulus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("winner").alias("n_resolved"), F.countDistinct("head").alias("n_heads"))


# embeddings by (version, model) as the model experiment leaves them, read back by the same manifest
@query("embedding_layout", with_sql(ANSWERS_SQL, ITEMS_SQL, _IDX_SQL, body="""
SELECT '1a' AS version, 'org_m' || run AS model, x.item, x.id::INTEGER AS id, round(i.vec[1], 6) AS dim_0, round(i.vec[2], 6) AS dim_1
FROM idx x JOIN items i ON i.key = x.item WHERE run % 3 <> 0"""))
def q_embedding_layout(spark, d):
    a, path, lines = _written_by_model(spark, d)
    vectors = items(spark, d).select(F.col("key").alias("item"), "vec")
    named = item_index(a, "model").join(vectors, "item").withColumns({"version": F.lit("1a"), "model": safe_name("model")})
    wide = wide_embedding(named, 2, keys=("version", "model", "item", "id"))
    for _ in range(2):
        write_embedding(wide, path, partition_cols=("version", "model"))
    back = read_results(spark, path, lines.withColumn("model", safe_name("model")), ("version", "model"), "csv", header=True)
    return back.select("version", "model", "item", F.col("id").cast("int").alias("id"), F.round(F.col("dim_0").cast("double"), 6).alias("dim_0"),
                       F.round(F.col("dim_1").cast("double"), 6).alias("dim_1"))


@query("item_index", with_sql(ANSWERS_SQL, _IDX_SQL, body="SELECT run, item, id FROM idx"))
def q_item_index(spark, d):
    return item_index(answers(spark, d), "run").select("run", "item", F.col("id").cast("long"))


@query("triplets_lenient", with_sql(ANSWERS_SQL, _IDX_SQL, body="""
SELECT a.run, a.answer_id, h.id::INTEGER AS h, w.id::INTEGER AS w, l.id::INTEGER AS l
FROM answers a JOIN idx h ON h.run = a.run AND h.item = a.head
JOIN idx w ON w.run = a.run AND w.item = a.winner JOIN idx l ON l.run = a.run AND l.item = a.loser"""))
def q_triplets_lenient(spark, d):
    a = answers(spark, d)
    return map_lenient(a, item_index(a, "run"), "run").select("run", "answer_id", "h", "w", "l")


@query("triplets_strict", STIMULI_CTES + """,
cidx AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::INTEGER AS id FROM (SELECT DISTINCT key FROM items) k)
SELECT st.triplet_id, x.id AS item_x_id, y.id AS item_y_id, z.id AS item_z_id
FROM st JOIN cidx x ON x.key = st.item_x JOIN cidx y ON y.key = st.item_y JOIN cidx z ON z.key = st.item_z""")
def q_triplets_strict(spark, d):
    keys = items(spark, d).select(F.col("key").alias("item")).distinct()
    cidx = dense_index(keys, ["item"], "id")
    st = stimuli(spark, d).select("triplet_id", "item_x", "item_y", "item_z")
    out = map_strict(st, cidx, ["item_x", "item_y", "item_z"])
    return out.select("triplet_id", "item_x_id", "item_y_id", "item_z_id")


@query("validate_counts", with_sql(ANSWERS_SQL, _IDX_SQL, body="""
, trip AS (SELECT a.answer_id FROM answers a JOIN idx h ON h.run = a.run AND h.item = a.head
           JOIN idx w ON w.run = a.run AND w.item = a.winner JOIN idx l ON l.run = a.run AND l.item = a.loser)
SELECT (SELECT count(*) FROM answers) AS n_rows,
       (SELECT count(*) FROM answers WHERE winner IS NULL) AS n_unresolved,
       (SELECT count(*) FROM answers WHERE loser = '-1') AS n_sentinel,
       (SELECT count(*) FROM idx) AS n_index_rows,
       (SELECT count(DISTINCT run) FROM answers) AS n_runs,
       (SELECT count(*) FROM trip) AS n_triplets"""))
def q_validate_counts(spark, d):
    a = answers(spark, d)
    idx = item_index(a, "run")
    trip = map_lenient(a, idx, "run")
    counts = a.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count(F.when(F.col("winner").isNull(), 1)).alias("n_unresolved"),
                   F.count(F.when(F.col("loser") == "-1", 1)).alias("n_sentinel"),
                   F.countDistinct("run").alias("n_runs"))
    names = ["n_rows", "n_unresolved", "n_sentinel", "n_index_rows", "n_runs", "n_triplets"]
    parts = counts.unionByName(idx.agg(F.count(F.lit(1)).alias("n_index_rows")), allowMissingColumns=True).unionByName(
        trip.agg(F.count(F.lit(1)).alias("n_triplets")), allowMissingColumns=True)  # three rows, each with its own counts
    return parts.agg(*[F.max(n).alias(n) for n in names])


@query("train_test_split", f"""
WITH k AS (SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS key FROM lineitem),
h AS (SELECT *, ('0x' || substr(md5(concat_ws(':', {SEED}, 'split', key)), 1, 15))::BIGINT AS hv FROM k)
SELECT l_orderkey, l_linenumber,
       row_number() OVER (ORDER BY hv, key) <= ceil(0.2 * (SELECT count(*) FROM k)) AS is_test
FROM h""")
def q_train_test_split(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    li = li.withColumn("key", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return split_train_test(li, "key", seed=SEED, test_size=0.2).select("l_orderkey", "l_linenumber", "is_test")

