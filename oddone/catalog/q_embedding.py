"""Ordinal-embedding queries: A9 loss and gradient, F5 accuracy, F3 distributed fit, F4 per-run fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import ANSWERS_SQL, ITEMS_SQL, answers, hash_sql, items, with_sql
from oddone.functions.hashing import HASH_SPACE
from oddone.operators.joins import checked_broadcast
from oddone.operators.vectors import matrix_row_bytes
from oddone.operators.embedding import item_index, map_lenient, split_train_test
from oddone.operators.fitting import embedding_frame, fit, heldout_accuracy, item_gradients, triplet_terms

DIM = 64  # vector dimension of the driver's embeddings table
FIT_D, FIT_EPOCHS, FIT_LR = 4, 3, 0.05
SEED = 42


def _terms(spark, d):
    it = items(spark, d).select("key", "vec")
    n = it.count()
    it = checked_broadcast(it, n, matrix_row_bytes(DIM))  # vectors are a dimension table
    a = answers(spark, d).select("answer_id", "head", "winner", "loser")
    for c, v in (("head", "h_vec"), ("winner", "w_vec"), ("loser", "l_vec")):
        a = a.join(it.select(F.col("key").alias(c), F.col("vec").alias(v)), c)
    return triplet_terms(a)


def _sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


_TERMS_SQL = f""", t AS (
  SELECT a.answer_id, a.head, a.winner, a.loser, h.vec AS hv, w.vec AS wv, l.vec AS lv
  FROM answers a JOIN items h ON h.key = a.head JOIN items w ON w.key = a.winner JOIN items l ON l.key = a.loser),
m AS (SELECT *, {_sq('hv', 'wv')} AS dhw, {_sq('hv', 'lv')} AS dhl FROM t),
s AS (SELECT *, CASE WHEN dhw - dhl > 30 THEN dhw - dhl ELSE ln(1 + exp(dhw - dhl)) END AS loss,
             1.0 / (1.0 + exp(-(dhw - dhl))) AS s FROM m)"""


@query("triplet_loss", with_sql(ITEMS_SQL, ANSWERS_SQL, body=_TERMS_SQL + """
SELECT count(*) AS n, round(sum(loss), 6) AS loss, round(avg(loss), 6) AS mean_loss FROM s"""))
def q_triplet_loss(spark, d):
    t = _terms(spark, d)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 6).alias("loss"),
                  F.round(F.avg("loss"), 6).alias("mean_loss"))


@query("triplet_accuracy", with_sql(ITEMS_SQL, ANSWERS_SQL, body=_TERMS_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE dhw < dhl) AS n_correct,
       round(count(*) FILTER (WHERE dhw < dhl) / count(*), 6) AS accuracy FROM s"""))
def q_triplet_accuracy(spark, d):
    t = _terms(spark, d)
    n_ok = F.count(F.when(F.col("correct"), 1))
    return t.agg(F.count(F.lit(1)).alias("n"), n_ok.alias("n_correct"),
                 F.round(n_ok / F.count(F.lit(1)), 6).alias("accuracy"))


@query("triplet_grad_step", with_sql(ITEMS_SQL, ANSWERS_SQL, body=_TERMS_SQL + f""",
g AS (SELECT head AS item, i AS dim, 2 * s * (lv[i + 1] - wv[i + 1]) AS v FROM s, range(0, {DIM}) r(i)
      UNION ALL SELECT winner, i, 2 * s * (wv[i + 1] - hv[i + 1]) FROM s, range(0, {DIM}) r(i)
      UNION ALL SELECT loser, i, 2 * s * (hv[i + 1] - lv[i + 1]) FROM s, range(0, {DIM}) r(i))
SELECT item, dim::INTEGER AS dim, round(sum(v), 6) + 0.0 AS grad FROM g GROUP BY item, dim"""))
def q_triplet_grad_step(spark, d):
    g = item_gradients(_terms(spark, d), DIM, "head", "winner", "loser", out="item")
    return g.select("item", F.posexplode("grad").alias("dim", "grad")).withColumn("grad", F.round("grad", 6) + F.lit(0.0))


def _fit_sql(run: str, body: str) -> str:
    """The fit's epochs unrolled; ``run`` is the run column or a constant."""
    init = ", ".join(f"({hash_sql(str(SEED), chr(39) + 'init' + chr(39), 'id', str(k))} - {HASH_SPACE // 2}) * (2.0 / (sqrt({FIT_D}) * {HASH_SPACE}))"
                     for k in range(FIT_D))
    ctes = [f"""a AS (SELECT answer_id, {run} AS run, head, winner, loser FROM answers),
idx AS (SELECT run, item, (row_number() OVER (PARTITION BY run ORDER BY item) - 1)::BIGINT AS id
        FROM (SELECT DISTINCT run, item FROM (SELECT run, head AS item FROM a UNION ALL SELECT run, winner FROM a UNION ALL SELECT run, loser FROM a) u
              WHERE item IS NOT NULL AND item <> '-1') q),
tr AS (SELECT a.run, a.answer_id, h.id AS h, w.id AS w, l.id AS l, {hash_sql(str(SEED), "'split'", 'a.answer_id')} AS hv
       FROM a JOIN idx h ON h.run = a.run AND h.item = a.head JOIN idx w ON w.run = a.run AND w.item = a.winner
       JOIN idx l ON l.run = a.run AND l.item = a.loser),
sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hv, answer_id) <= ceil(0.2 * count(*) OVER (PARTITION BY run)) AS is_test FROM tr),
kk AS (SELECT run, count(*) AS k FROM sp WHERE NOT is_test GROUP BY run),
m0 AS MATERIALIZED (SELECT run, id, [{init}] AS x, [{", ".join(["0.0::DOUBLE"] * FIT_D)}] AS m, [{", ".join(["0.0::DOUBLE"] * FIT_D)}] AS v FROM idx)"""]
    for e in range(1, FIT_EPOCHS + 1):
        ctes.append(f"""t{e} AS MATERIALIZED (SELECT *, 1.0 / (1.0 + exp(-(dhw - dhl))) AS g FROM (
  SELECT sp.run, sp.h, sp.w, sp.l, h.x AS hx, w.x AS wx, l.x AS lx, {_sq('h.x', 'w.x')} AS dhw, {_sq('h.x', 'l.x')} AS dhl
  FROM sp JOIN m{e - 1} h ON h.run = sp.run AND h.id = sp.h JOIN m{e - 1} w ON w.run = sp.run AND w.id = sp.w
  JOIN m{e - 1} l ON l.run = sp.run AND l.id = sp.l WHERE NOT is_test) q),
p{e} AS (SELECT run, h AS id, i, 2 * g * (hx[i] - wx[i]) - 2 * g * (hx[i] - lx[i]) AS v FROM t{e}, range(1, {FIT_D + 1}) r(i)
  UNION ALL SELECT run, w, i, -2 * g * (hx[i] - wx[i]) FROM t{e}, range(1, {FIT_D + 1}) r(i)
  UNION ALL SELECT run, l, i, 2 * g * (hx[i] - lx[i]) FROM t{e}, range(1, {FIT_D + 1}) r(i)),
s{e} AS (SELECT run, id, i, sum(v) AS v FROM p{e} GROUP BY run, id, i),
u{e} AS (SELECT o.run, o.id, r.i, o.x[r.i] AS x, 0.9 * o.m[r.i] + 0.1 * coalesce(s.v, 0) / k AS m,
                0.999 * o.v[r.i] + 0.001 * (coalesce(s.v, 0) / k) * (coalesce(s.v, 0) / k) AS v
  FROM m{e - 1} o JOIN kk ON kk.run = o.run CROSS JOIN range(1, {FIT_D + 1}) r(i)
  LEFT JOIN s{e} s ON s.run = o.run AND s.id = o.id AND s.i = r.i),
m{e} AS MATERIALIZED (SELECT run, id,
  list(x - {FIT_LR} * (m / (1 - pow(0.9, {e}))) / (sqrt(v / (1 - pow(0.999, {e}))) + 1e-8) ORDER BY i) AS x,
  list(m ORDER BY i) AS m, list(v ORDER BY i) AS v FROM u{e} GROUP BY run, id)""")
    return with_sql(ANSWERS_SQL, *ctes, body=body)


_DIMS_SQL = ", ".join(f"round(m.x[{k + 1}], 6) + 0.0 AS dim_{k}" for k in range(FIT_D))
_LABELLED = "JOIN idx ON idx.run = m.run AND idx.id = m.id"


def _split(spark, d, run=None):
    a = answers(spark, d)
    idx = item_index(a, run)
    return idx, split_train_test(map_lenient(a, idx, run), "answer_id", seed=SEED, group_col=run)


def _fitted(spark, d, run=None, **kw):
    idx, trip = _split(spark, d, run)
    keys = (run,) if run else ()
    return idx, trip, fit(trip.filter(~F.col("is_test")), idx, FIT_D, FIT_EPOCHS, FIT_LR, SEED, keys=keys, **kw)


def _rounded(emb):
    return emb.withColumns({f"dim_{k}": F.round(f"dim_{k}", 6) + F.lit(0.0) for k in range(FIT_D)})


@query("fit_embedding", _fit_sql("0", f"SELECT idx.item, m.id, {_DIMS_SQL} FROM m{FIT_EPOCHS} m {_LABELLED}"))
def q_fit_embedding(spark, d):
    idx, _, model = _fitted(spark, d)
    return _rounded(embedding_frame(model, idx, FIT_D))


@query("fit_per_run", _fit_sql("run", f"SELECT m.run, idx.item, m.id, {_DIMS_SQL} FROM m{FIT_EPOCHS} m {_LABELLED}"))
def q_fit_per_run(spark, d):
    idx, _, model = _fitted(spark, d, "run")
    return _rounded(embedding_frame(model, idx, FIT_D, ("run",)))


@query("fit_loss", _fit_sql("run", f"""
SELECT t.run, any_value(k) AS n_train, round(sum(ln(1 + exp(dhw - dhl))) / any_value(k), 6) AS mean_loss
FROM t{FIT_EPOCHS} t JOIN kk ON kk.run = t.run GROUP BY t.run"""))
def q_fit_loss(spark, d):
    """By the plan for runs too large for a task: a job an epoch."""
    _, trip, model = _fitted(spark, d, "run", pack_triplets=0)
    sizes = trip.filter(~F.col("is_test")).groupBy("run").agg(F.count(F.lit(1)).alias("n_train"))
    sums = model.groupBy("run").agg(F.sum("loss").alias("loss"))
    return sums.join(sizes, "run").select("run", "n_train", F.round(F.col("loss") / F.col("n_train"), 6).alias("mean_loss"))


@query("fit_heldout_accuracy", _fit_sql("run", f"""
SELECT sp.run, count(*) AS n_test, count(*) FILTER (WHERE {_sq('h.x', 'w.x')} < {_sq('h.x', 'l.x')}) AS n_correct,
       round(count(*) FILTER (WHERE {_sq('h.x', 'w.x')} < {_sq('h.x', 'l.x')}) / count(*), 6) AS accuracy
FROM sp JOIN m{FIT_EPOCHS} h ON h.run = sp.run AND h.id = sp.h JOIN m{FIT_EPOCHS} w ON w.run = sp.run AND w.id = sp.w
JOIN m{FIT_EPOCHS} l ON l.run = sp.run AND l.id = sp.l WHERE is_test GROUP BY sp.run"""))
def q_fit_heldout_accuracy(spark, d):
    _, trip, model = _fitted(spark, d, "run")
    found = heldout_accuracy(trip.filter("is_test"), model, FIT_D, ("run",))
    return found.withColumn("accuracy", F.round("accuracy", 6))
