"""Sampling queries: constrained draw (H1), unconstrained draw (H2), y/z shuffle (H3), subset (H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import ITEMS_SQL, NAMES_SQL, SEED, hash_sql, items, names, with_sql
from oddone.operators.sampling import draw_triplets, shuffle_yz, subset_k
from oddone.operators.vectors import candidates, first_vector

# Fixed parameters of the checked runs: the shipped run size, and thresholds between the
# 5 % and 95 % distance quantiles of the driver's vectors.
N_ITEMS = 35000
NEAR, FAR = 1.35, 1.45
DRAWS = 32
SUBSET_K = 16


def _round_dists(df):
    for c in ("dist_x_y", "dist_x_z", "dist_y_z"):
        df = df.withColumn(c, F.round(c, 6))
    return df


def stimuli(spark, d):
    it = items(spark, d)
    cand = candidates(it, first_vector(it))
    return draw_triplets(cand, N_ITEMS, NEAR, FAR, seed=SEED, draws=DRAWS)


def _draw_sql(cand_cte: str, use_vectors: bool, n_attempts: str, near_below=NEAR, far_above=FAR, feasible: bool = False, draws: int = DRAWS) -> str:
    """``feasible``: x is drawn from the rows that have a near and another far row, as Spark does once fewer than
    half of a first wave over all rows succeed."""
    if use_vectors:
        valid = "c.key <> dr.x_key AND c.vec IS NOT NULL AND dr.x_vec IS NOT NULL"
        dist = f"CASE WHEN {valid} THEN list_distance(dr.x_vec, c.vec) END"
        near, far = f"d < {near_below}", f"d > {far_above}"
        tvalid = "c.key <> ax.x_key AND c.vec IS NOT NULL AND ax.x_vec IS NOT NULL"
        tdist = f"CASE WHEN {tvalid} THEN list_distance(ax.x_vec, c.vec) END"
    else:
        dist = "CASE WHEN c.key <> dr.x_key THEN 0.0 END"
        near = far = "d IS NOT NULL"
        tdist = "CASE WHEN c.key <> ax.x_key THEN 0.0 END"
    xs = f"""att AS (SELECT a, {hash_sql(str(SEED), "'x'", 'a')} % n AS x_pos FROM range(0, {n_attempts}) t(a), nn)"""
    if feasible:
        xs = f"""pr AS (SELECT x.pos, list_distance(x.vec, c.vec) AS d FROM cand x JOIN cand c ON c.key <> x.key AND c.key <> ''),
fk AS (SELECT pos, count(*) FILTER (WHERE {near}) AS nr, count(*) FILTER (WHERE {far}) AS fr, count(*) FILTER (WHERE {near} AND {far}) AS nf
       FROM pr GROUP BY pos),
feas AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i FROM fk WHERE nr > 0 AND fr > 0 AND (nr > 1 OR fr > 1 OR nf = 0)),
att AS (SELECT a, f.pos AS x_pos FROM (SELECT a, {hash_sql(str(SEED), "'x'", 'a')} % (SELECT count(*) FROM feas) AS i
        FROM range(0, {n_attempts}) t(a)) q JOIN feas f ON f.i = q.i)"""
    return f""",
{cand_cte},
nn AS (SELECT count(*) AS n FROM cand),
{xs},
ax AS (SELECT att.a, c.key AS x_key, c.vec AS x_vec FROM att JOIN cand c ON c.pos = att.x_pos),
dr AS (SELECT ax.a, ax.x_key, ax.x_vec, k, {hash_sql(str(SEED), "'draw'", 'ax.a', 'k')} % n AS c_pos
       FROM ax, range(0, {draws}) r(k), nn),
dj AS (SELECT dr.a, dr.k, c.pos, c.key, {dist} AS d FROM dr JOIN cand c ON c.pos = dr.c_pos),
fy AS (SELECT ax.a, arg_min(pos, k) FILTER (WHERE {near}) AS y_pos FROM ax LEFT JOIN dj ON dj.a = ax.a GROUP BY ax.a),
fz AS (SELECT fy.a, fy.y_pos, arg_min(dj.pos, dj.k) FILTER (WHERE {far.replace('d ', 'dj.d ')}
              AND dj.pos IS DISTINCT FROM fy.y_pos) AS z_pos
       FROM fy LEFT JOIN dj ON dj.a = fy.a GROUP BY fy.a, fy.y_pos),
un AS (SELECT a, y_pos, z_pos FROM fz WHERE y_pos IS NULL OR z_pos IS NULL),
tc AS (SELECT un.a, c.pos, {tdist} AS d FROM un JOIN ax ON ax.a = un.a CROSS JOIN cand c),
li AS (SELECT a, coalesce(list(pos ORDER BY pos) FILTER (WHERE {near}), []) AS nl, coalesce(list(pos ORDER BY pos) FILTER (WHERE {far}), []) AS fl,
              coalesce(list(pos ORDER BY pos) FILTER (WHERE {near} AND {far}), []) AS bl,
              coalesce(list(pos ORDER BY pos) FILTER (WHERE {far} AND NOT ({near})), []) AS ol FROM tc GROUP BY a),
yf AS (SELECT un.a, un.y_pos IS NULL AS no_y, un.z_pos, li.* EXCLUDE (a),
              coalesce(un.y_pos, nl[1 + {hash_sql(str(SEED), "'ty'", 'un.a')} % nullif(len(nl), 0)]) AS y FROM un JOIN li ON li.a = un.a),
yb AS (SELECT *, list_contains(fl, y)::INTEGER AS yfar, len(bl) - list_contains(fl, y)::INTEGER AS b, len(ol) AS o FROM yf WHERE y IS NOT NULL),
yr AS (SELECT *, CASE WHEN NOT no_y THEN fl WHEN b + o = 0 THEN []
                      WHEN {hash_sql(str(SEED), "'tc'", 'a')} % ((b + o) * (b + o + 1)) < b * (b + 1) THEN bl ELSE ol END AS zl FROM yb),
ym AS (SELECT *, len(zl) - list_contains(zl, y)::INTEGER AS m FROM yr),
ye AS (SELECT *, zl[1 + {hash_sql(str(SEED), "'tz'", 'a')} % nullif(m, 0)] AS e FROM ym),
tz AS (SELECT a, y AS y_t, coalesce(z_pos, CASE WHEN e = y THEN zl[len(zl)] ELSE e END) AS z_t FROM ye),
res AS (SELECT fz.a, coalesce(fz.y_pos, y_t) AS y_pos, coalesce(fz.z_pos, z_t) AS z_pos FROM fz LEFT JOIN tz ON tz.a = fz.a),
ok AS (SELECT res.a, ax.x_key, ax.x_vec, cy.key AS y_key, cy.vec AS y_vec, cz.key AS z_key, cz.vec AS z_vec
       FROM res JOIN ax ON ax.a = res.a JOIN cand cy ON cy.pos = res.y_pos JOIN cand cz ON cz.pos = res.z_pos
       WHERE {"cy.key <> '' AND cz.key <> ''" if use_vectors else "true"}),
ranked AS (SELECT *, (row_number() OVER (ORDER BY a) - 1)::BIGINT AS triplet_id FROM ok)"""


# The oracle evaluates attempts 0 .. 2*N_ITEMS-1 and keeps the first N_ITEMS successes (Spark runs
# waves until it has them).  On this data nearly every attempt succeeds; a shortfall would
# show up as a row-count mismatch, never as a silent pass.
DRAW_SQL = with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(2 * N_ITEMS)) + f"""
SELECT triplet_id, a AS attempt_id, x_key AS item_x, y_key AS item_y, z_key AS item_z,
       round(list_distance(x_vec, y_vec), 6) AS dist_x_y, round(list_distance(x_vec, z_vec), 6) AS dist_x_z,
       round(list_distance(y_vec, z_vec), 6) AS dist_y_z
FROM ranked WHERE triplet_id < {N_ITEMS}""")


@query("draw_triplets", DRAW_SQL)
def q_draw_triplets(spark, d):
    return _round_dists(stimuli(spark, d))


# Thresholds under which few rows have any near row: x is drawn from those alone.
SPARSE_ITEMS, SPARSE_NEAR, SPARSE_FAR = 2000, 1.05, 1.45


@query("draw_sparse", with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(SPARSE_ITEMS), SPARSE_NEAR, SPARSE_FAR, feasible=True) + f"""
SELECT triplet_id, a AS attempt_id, x_key AS item_x, y_key AS item_y, z_key AS item_z,
       round(list_distance(x_vec, y_vec), 6) AS dist_x_y, round(list_distance(x_vec, z_vec), 6) AS dist_x_z,
       round(list_distance(y_vec, z_vec), 6) AS dist_y_z
FROM ranked WHERE triplet_id < {SPARSE_ITEMS}"""))
def q_draw_sparse(spark, d):
    it = items(spark, d)
    return _round_dists(draw_triplets(candidates(it, first_vector(it)), SPARSE_ITEMS, SPARSE_NEAR, SPARSE_FAR, seed=SEED, draws=DRAWS))


# The same law without any draws: y and z by index from the near and far rows of every x.  The second pair of thresholds
# overlaps (a row can be near and far) and leaves far rows that are not near.
LIST_ITEMS, LIST_NEAR, LIST_FAR = 5000, 1.43, 1.40
_LIST_BODY = f"""
SELECT triplet_id, a AS attempt_id, x_key AS item_x, y_key AS item_y, z_key AS item_z,
       round(list_distance(x_vec, y_vec), 6) AS dist_x_y, round(list_distance(x_vec, z_vec), 6) AS dist_x_z,
       round(list_distance(y_vec, z_vec), 6) AS dist_y_z
FROM ranked WHERE triplet_id < {LIST_ITEMS}"""


def _drawn_by_lists(spark, d, near, far):
    it = items(spark, d)
    return _round_dists(draw_triplets(candidates(it, first_vector(it)), LIST_ITEMS, near, far, seed=SEED, draws=0))


@query("draw_lists", with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(2 * LIST_ITEMS), draws=0) + _LIST_BODY))
def q_draw_lists(spark, d):
    return _drawn_by_lists(spark, d, NEAR, FAR)


@query("draw_lists_overlap", with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(2 * LIST_ITEMS), LIST_NEAR, LIST_FAR, draws=0) + _LIST_BODY))
def q_draw_lists_overlap(spark, d):
    return _drawn_by_lists(spark, d, LIST_NEAR, LIST_FAR)


UNCONSTRAINED_SQL = with_sql(NAMES_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, NULL::DOUBLE[] AS vec FROM names)", False, str(2 * N_ITEMS)) + f"""
SELECT triplet_id, a AS attempt_id, x_key AS item_x, y_key AS item_y, z_key AS item_z
FROM ranked WHERE triplet_id < {N_ITEMS}""")


@query("draw_unconstrained", UNCONSTRAINED_SQL)
def q_draw_unconstrained(spark, d):
    cand = candidates(names(spark, d), None)
    out = draw_triplets(cand, N_ITEMS, seed=SEED, draws=DRAWS, use_vectors=False)
    return out.select("triplet_id", "attempt_id", "item_x", "item_y", "item_z")


SHUFFLE_SQL = with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(2 * N_ITEMS)) + f""",
st AS (SELECT triplet_id, y_key AS item_y, z_key AS item_z FROM ranked WHERE triplet_id < {N_ITEMS})
SELECT triplet_id,
       CASE WHEN {hash_sql(str(SEED), "'shuffle'", 'triplet_id')} % 2 = 1 THEN item_z ELSE item_y END AS shuffled_item_y,
       CASE WHEN {hash_sql(str(SEED), "'shuffle'", 'triplet_id')} % 2 = 1 THEN item_y ELSE item_z END AS shuffled_item_z
FROM st""")


@query("shuffle_yz", SHUFFLE_SQL)
def q_shuffle_yz(spark, d):
    return shuffle_yz(stimuli(spark, d), seed=SEED).select("triplet_id", "shuffled_item_y", "shuffled_item_z")


SUBSET_SQL = with_sql(NAMES_SQL, body=f"""
, keys AS (SELECT DISTINCT key FROM names),
chosen AS (SELECT key FROM keys ORDER BY {hash_sql(str(SEED), "'subset'", 'key')} LIMIT {SUBSET_K})
SELECT row_idx, key FROM names WHERE key IN (SELECT key FROM chosen)""")


@query("subset_k", SUBSET_SQL)
def q_subset_k(spark, d):
    return subset_k(names(spark, d), SUBSET_K, seed=SEED).select("row_idx", "key")


# Stimuli as a CTE chain ending in `st` (D4 columns, unrounded distances, shuffled y/z), for the
# prompt and scoring oracles.
STIMULI_CTES = with_sql(ITEMS_SQL, body=_draw_sql(
    "cand AS (SELECT row_idx AS pos, key, vec FROM items)", True, str(2 * N_ITEMS)) + f""",
st0 AS (SELECT triplet_id, a AS attempt_id, x_key AS item_x, y_key AS item_y, z_key AS item_z,
               list_distance(x_vec, y_vec) AS dist_x_y, list_distance(x_vec, z_vec) AS dist_x_z,
               list_distance(y_vec, z_vec) AS dist_y_z
        FROM ranked WHERE triplet_id < {N_ITEMS}),
st AS (SELECT *,
       CASE WHEN {hash_sql(str(SEED), "'shuffle'", 'triplet_id')} % 2 = 1 THEN item_z ELSE item_y END AS shuffled_item_y,
       CASE WHEN {hash_sql(str(SEED), "'shuffle'", 'triplet_id')} % 2 = 1 THEN item_y ELSE item_z END AS shuffled_item_z
       FROM st0)""")


def shuffled_stimuli(spark, d):
    return shuffle_yz(stimuli(spark, d), seed=SEED)
