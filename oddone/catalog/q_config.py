"""Config, manifest and model-metadata queries: S5, S6/P6/X21, S9, J7, J8, X11-X15/X23/A8."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddone.catalog import query
from oddone.catalog.fixtures import read
from oddone.functions.metadata import HUB_PREFIX, arch_columns, model_id_norm, parsed_maps
from oddone.functions.prompts import TRIPLET_TEMPLATE
from oddone.operators.manifest import dangling, manifest_args, parse_manifest, resolve
from oddone.sources.files import EXP_SCHEMA, MODEL_SCHEMA, STIM_SCHEMA, explode_config

# The shipped experiment battery.
EXPERIMENT_BATTERY = {
    "triplet_run_1_a": {"instruct_prompt": TRIPLET_TEMPLATE, "n_items": 35000, "euclid_min": 10000000000,
                        "euclid_max": 0, "batch_size": 4},
    "embedding_1_a": {"d": 30, "max_epochs": 1000, "embeddings_name": "1a_salmon_embeddings"},
    "embedding_from_folder": {"d": 30, "max_epochs": 500, "embeddings_name": "1a_salmon_embeddings"},
}


# ---------------------------------------------------------------- model battery from part
# one JSON document per part row: {"m<key>": {model fields}}
def _battery_docs(spark, d):
    p = read(spark, d, "part")
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    mname = F.concat(F.col("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"))
    cfg = F.struct(mname.alias("model_name"), mname.alias("tokenizer_name"),
                   (F.pmod("p_size", F.lit(2)) == 0).alias("do_chat_template"), F.lit("direct").alias("model_load"),
                   F.when(F.pmod("p_size", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.lit("Answer: "))
                   .alias("answer_format"),
                   F.when(F.pmod("p_size", F.lit(5)) == 0, F.lit("logits")).otherwise(F.lit("tokens")).alias("choose_mode"),
                   F.concat(F.col("p_size").cast("string"), F.lit("B")).alias("params"))
    return p.select(F.to_json(F.create_map(name, cfg)).alias("doc"))


def models(spark, d):
    return explode_config(_battery_docs(spark, d), "doc", MODEL_SCHEMA)


_MODELS_SQL = """models AS (
  SELECT 'm' || p_partkey AS name, p_brand || '/' || replace(p_name, ' ', '-') AS model_name,
         p_brand || '/' || replace(p_name, ' ', '-') AS tokenizer_name, p_size % 2 = 0 AS do_chat_template,
         'direct' AS model_load, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Answer: ' END AS answer_format,
         CASE WHEN p_size % 5 = 0 THEN 'logits' ELSE 'tokens' END AS choose_mode, p_size || 'B' AS params
  FROM part)"""


@query("config_explode", f"WITH {_MODELS_SQL} SELECT * FROM models")
def q_config_explode(spark, d):
    return models(spark, d)


def experiments(spark):
    import json
    doc = spark.createDataFrame([(json.dumps(EXPERIMENT_BATTERY),)], "doc string")
    return explode_config(doc, "doc", EXP_SCHEMA)


# A stimulus battery of the shipped form.
STIMULUS_BATTERY = {"THINGS": {"items_tsv": "things.csv", "human_embeddings": "things.txt", "src_key": "uniqueID"},
                    "ROUND": {"items_tsv": "round.csv", "human_embeddings": None, "src_key": "concept"}}


def stimuli_battery(spark):
    import json
    doc = spark.createDataFrame([(json.dumps(STIMULUS_BATTERY),)], "doc string")
    return explode_config(doc, "doc", STIM_SCHEMA)


_STIM_SQL = """stims AS (SELECT * FROM (VALUES ('THINGS', 'uniqueID'), ('ROUND', 'concept')) v(name, src_key))"""
_EXP_SQL = """exps AS (SELECT * FROM (VALUES ('triplet_run_1_a', 35000, NULL), ('embedding_1_a', NULL, 30),
                                   ('embedding_from_folder', NULL, 30)) v(name, n_items, d))"""


# ---------------------------------------------------------------- manifest lines from part / nation / region
def _lines(spark, d):
    p = read(spark, d, "part")
    exp = (F.when(F.pmod("p_partkey", F.lit(50)) == 7, F.lit("unknown_exp"))
           .when(F.pmod("p_size", F.lit(3)) == 0, F.lit("triplet_run_1_a"))
           .when(F.pmod("p_size", F.lit(3)) == 1, F.lit("embedding_1_a")).otherwise(F.lit("embedding_from_folder")))
    model = F.when(F.pmod("p_partkey", F.lit(40)) == 9, F.lit(" x")).otherwise(F.lit(" m"))  # x… is in no battery
    stimulus = F.when(F.pmod("p_partkey", F.lit(30)) == 11, F.lit("\tNOWHERE k=")).otherwise(F.lit("\tTHINGS k="))
    line = F.concat(F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.lit("  ")).otherwise(F.lit("")), exp, model,
                    F.col("p_partkey").cast("string"), stimulus, F.col("p_size").cast("string"),
                    F.lit(" junk k="), F.lower("p_type"), F.lit(" expr=a=b version_dir=v"),
                    F.pmod("p_partkey", F.lit(3)).cast("string"), F.lit(" \t"))
    body = p.select((F.col("p_partkey") * 2 + 1).alias("line_no"), line.alias("value"))
    com = read(spark, d, "nation").select((F.col("n_nationkey") * 80).cast("long").alias("line_no"),
                                         F.concat(F.lit("  # "), F.col("n_name")).alias("value"))
    blank = read(spark, d, "region").select((F.col("r_regionkey") * 194 + 2).cast("long").alias("line_no"),
                                           F.lit(" \t ").alias("value"))
    return body.unionByName(com).unionByName(blank)


_LINES_SQL = """lines AS (
  SELECT p_partkey * 2 + 1 AS line_no,
         CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE '' END
         || CASE WHEN p_partkey % 50 = 7 THEN 'unknown_exp' WHEN p_size % 3 = 0 THEN 'triplet_run_1_a'
                 WHEN p_size % 3 = 1 THEN 'embedding_1_a' ELSE 'embedding_from_folder' END
         || CASE WHEN p_partkey % 40 = 9 THEN ' x' ELSE ' m' END || p_partkey || chr(9)
         || CASE WHEN p_partkey % 30 = 11 THEN 'NOWHERE k=' ELSE 'THINGS k=' END || p_size || ' junk k=' || lower(p_type)
         || ' expr=a=b version_dir=v' || (p_partkey % 3) || ' ' || chr(9) AS value
  FROM part
  UNION ALL SELECT n_nationkey * 80, '  # ' || n_name FROM nation
  UNION ALL SELECT r_regionkey * 194 + 2, ' ' || chr(9) || ' ' FROM region),
t AS (SELECT line_no, regexp_replace(value, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM lines),
tok AS (SELECT line_no, regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+') AS tk FROM t WHERE t <> '' AND NOT starts_with(t, '#')),
parsed AS (SELECT line_no, tk[1] AS experiment, tk[2] AS model, tk[3] AS stimulus,
                  regexp_replace(tk[-1], 'version_dir=', '') AS version, tk[4:] AS args FROM tok)"""


def parsed(spark, d):
    return parse_manifest(_lines(spark, d))


@query("manifest_parse", f"""WITH {_LINES_SQL}
SELECT line_no, experiment, model, stimulus, version, version || '_' || model || '_' || experiment || '.log' AS log_name
FROM parsed""")
def q_manifest_parse(spark, d):
    return parsed(spark, d).select("line_no", "experiment", "model", "stimulus", "version", "log_name")


@query("manifest_args", f"""WITH {_LINES_SQL},
kv AS (SELECT line_no, pos, a, split_part(a, '=', 1) AS key, substr(a, strpos(a, '=') + 1) AS value
       FROM (SELECT line_no, unnest(args) AS a, generate_subscripts(args, 1) AS pos FROM parsed) u WHERE contains(a, '='))
SELECT line_no, key, arg_max(value, pos) AS value FROM kv GROUP BY line_no, key""")
def q_manifest_args(spark, d):
    return manifest_args(parsed(spark, d))


@query("manifest_resolve", f"""WITH {_MODELS_SQL}, {_EXP_SQL}, {_STIM_SQL}, {_LINES_SQL}
SELECT p.line_no, p.experiment, p.model, p.stimulus, m.model_name, m.choose_mode, coalesce(e.n_items, -1) AS n_items,
       coalesce(e.d, -1) AS d, s.src_key
FROM parsed p JOIN exps e ON e.name = p.experiment JOIN models m ON m.name = p.model JOIN stims s ON s.name = p.stimulus""")
def q_manifest_resolve(spark, d):
    r = resolve(parsed(spark, d), models(spark, d), experiments(spark), stimuli_battery(spark))
    return r.select("line_no", "experiment", "model", "stimulus", "model_name", "choose_mode",
                    F.coalesce("n_items", F.lit(-1)).alias("n_items"), F.coalesce("d", F.lit(-1)).alias("d"), "src_key")


@query("manifest_dangling", f"""WITH {_MODELS_SQL}, {_EXP_SQL}, {_STIM_SQL}, {_LINES_SQL}
SELECT * FROM (SELECT line_no, experiment, model,
  CASE WHEN experiment NOT IN (SELECT name FROM exps) THEN 'unknown experiment'
       WHEN model NOT IN (SELECT name FROM models) THEN 'unknown model'
       WHEN stimulus NOT IN (SELECT name FROM stims) THEN 'unknown stimulus' END AS reason FROM parsed) q
WHERE reason IS NOT NULL""")
def q_manifest_dangling(spark, d):
    return dangling(parsed(spark, d), models(spark, d), experiments(spark), stimuli_battery(spark))


# ---------------------------------------------------------------- model configs from part
def _cfg_exprs():
    """JSON config text per part row; aliases rotate with the row so every fallback is used."""
    s, k = F.col("p_size"), F.col("p_partkey")

    def pick(keys, by):
        e = None
        for i, key in enumerate(keys):
            c = F.pmod(by, F.lit(len(keys))) == i
            e = F.when(c, F.lit(key)) if e is None else e.when(c, F.lit(key))
        return e

    def kv(key, val):
        return F.concat(F.lit('"'), key, F.lit('": '), val)

    parts = [
        F.when(F.pmod(s, F.lit(7)) != 0, kv(F.lit("model_type"), F.concat(F.lit('"'), F.lower("p_type"), F.lit('"')))),
        kv(F.lit("architectures"), F.when(F.pmod(s, F.lit(5)) == 0, F.lit("[]"))
           .otherwise(F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]')))),
        F.when(F.pmod(s, F.lit(11)) == 0, F.lit('"num_hidden_layers": null, "n_layer": 3'))
         .otherwise(kv(pick(["num_hidden_layers", "n_layer", "num_layers", "n_layers"], s), s.cast("string"))),
        kv(pick(["num_attention_heads", "n_head", "num_heads", "attention_heads"], k), F.pmod(s, F.lit(8)).cast("string")),
        F.when(F.pmod(s, F.lit(2)) == 0, kv(pick(["num_key_value_heads", "n_kv_head", "num_kv_heads"], k),
                                            F.lit("2"))),
        kv(pick(["hidden_size", "n_embd", "d_model", "embedding_size"], F.floor(k / 4)), (s * 64).cast("string")),
        F.when(F.pmod(s, F.lit(3)) == 0, kv(pick(["vocab_size", "vocabulary_size", "n_vocab"], k),
                                            (k + 1000).cast("string"))),
        kv(pick(["max_position_embeddings", "n_positions", "max_sequence_length"], s), F.lit("2048")),
        F.when(F.pmod(s, F.lit(13)) != 0, kv(pick(["intermediate_size", "n_inner", "ffn_dim", "feed_forward_size"], k),
                                             (s * 256).cast("string"))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    cfg = F.when(F.pmod(k, F.lit(89)) == 0, F.lit(None).cast("string")).when(F.pmod(k, F.lit(97)) == 0, F.lit("{}")) \
        .otherwise(body)
    tok_cfg = F.when(F.pmod(s, F.lit(3)) == 1, F.concat(F.lit('{"vocab_size": '), (s * 100).cast("string"), F.lit("}")))
    tok_json = (F.when(F.pmod(s, F.lit(4)) == 0, F.lit('{"model": {"vocab": {}}}'))
                .when(F.pmod(k, F.lit(2)) == 0, F.lit('{"model": {"vocab": {"a": 0, "b": 1}}}'))
                .otherwise(F.lit('{"vocab": ["x", "y", "z"]}')))
    return cfg, tok_cfg, tok_json


_CFG_SQL = """cfgs AS (
  SELECT p_partkey, CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN '{}' ELSE
    '{' || concat_ws(', ',
      CASE WHEN p_size % 7 <> 0 THEN '"model_type": "' || lower(p_type) || '"' END,
      '"architectures": ' || CASE WHEN p_size % 5 = 0 THEN '[]' ELSE '["' || p_brand || '"]' END,
      CASE WHEN p_size % 11 = 0 THEN '"num_hidden_layers": null, "n_layer": 3'
           ELSE '"' || ['num_hidden_layers', 'n_layer', 'num_layers', 'n_layers'][p_size % 4 + 1] || '": ' || p_size END,
      '"' || ['num_attention_heads', 'n_head', 'num_heads', 'attention_heads'][p_partkey % 4 + 1] || '": ' || (p_size % 8),
      CASE WHEN p_size % 2 = 0 THEN '"' || ['num_key_value_heads', 'n_kv_head', 'num_kv_heads'][p_partkey % 3 + 1] || '": 2' END,
      '"' || ['hidden_size', 'n_embd', 'd_model', 'embedding_size'][(p_partkey // 4) % 4 + 1] || '": ' || (p_size * 64),
      CASE WHEN p_size % 3 = 0 THEN '"' || ['vocab_size', 'vocabulary_size', 'n_vocab'][p_partkey % 3 + 1] || '": ' || (p_partkey + 1000) END,
      '"' || ['max_position_embeddings', 'n_positions', 'max_sequence_length'][p_size % 3 + 1] || '": 2048',
      CASE WHEN p_size % 13 <> 0 THEN '"' || ['intermediate_size', 'n_inner', 'ffn_dim', 'feed_forward_size'][p_partkey % 4 + 1] || '": ' || (p_size * 256) END
    ) || '}' END AS cfg,
    CASE WHEN p_size % 3 = 1 THEN '{"vocab_size": ' || (p_size * 100) || '}' END AS tok_cfg,
    CASE WHEN p_size % 4 = 0 THEN '{"model": {"vocab": {}}}' WHEN p_partkey % 2 = 0 THEN '{"model": {"vocab": {"a": 0, "b": 1}}}'
         ELSE '{"vocab": ["x", "y", "z"]}' END AS tok_json
  FROM part)"""


def _has(j, k):
    return f"(json_extract({j}, '$.\"{k}\"') IS NOT NULL)"


def _first_sql(j, keys):
    whens = " ".join(f"WHEN {_has(j, k)} THEN TRY_CAST(json_extract_string({j}, '$.\"{k}\"') AS BIGINT)" for k in keys)
    return f"CASE {whens} END"


def _jlen(x):
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN len(json_keys({x})) WHEN 'ARRAY' THEN json_array_length({x}) END"


_ARCH_SQL = f"""WITH {_CFG_SQL},
f AS (SELECT p_partkey, cfg, tok_cfg, tok_json,
  CASE WHEN cfg IS NULL OR len(json_keys(cfg)) = 0 THEN 'Could not fetch model configuration' END AS error,
  CASE WHEN {_has('cfg', 'model_type')} THEN json_extract_string(cfg, '$.model_type') ELSE 'Unknown' END AS model_type,
  CASE WHEN json_array_length(json_extract(cfg, '$.architectures')) > 0 THEN json_extract_string(cfg, '$.architectures[0]')
       ELSE 'Unknown' END AS architecture,
  {_first_sql('cfg', ['num_hidden_layers', 'n_layer', 'num_layers', 'n_layers'])} AS num_layers,
  {_first_sql('cfg', ['num_attention_heads', 'n_head', 'num_heads', 'attention_heads'])} AS num_attention_heads,
  {_first_sql('cfg', ['num_key_value_heads', 'n_kv_head', 'num_kv_heads'])} AS num_key_value_heads,
  {_first_sql('cfg', ['hidden_size', 'n_embd', 'd_model', 'embedding_size'])} AS embedding_dimensions,
  CASE WHEN {' OR '.join(_has('cfg', k) for k in ['vocab_size', 'vocabulary_size', 'n_vocab'])}
       THEN {_first_sql('cfg', ['vocab_size', 'vocabulary_size', 'n_vocab'])}
       WHEN tok_cfg IS NOT NULL AND len(json_keys(tok_cfg)) > 0 AND {_has('tok_cfg', 'vocab_size')}
       THEN TRY_CAST(json_extract_string(tok_cfg, '$.vocab_size') AS BIGINT)
       ELSE nullif(CASE WHEN {_has('tok_json', 'model')} AND {_has("json_extract(tok_json, '$.model')", 'vocab')}
                        THEN {_jlen("json_extract(tok_json, '$.model.vocab')")}
                        WHEN {_has('tok_json', 'vocab')} THEN {_jlen("json_extract(tok_json, '$.vocab')")} END, 0)
  END AS vocabulary_size,
  {_first_sql('cfg', ['max_position_embeddings', 'n_positions', 'max_sequence_length'])} AS max_position_embeddings,
  {_first_sql('cfg', ['intermediate_size', 'n_inner', 'ffn_dim', 'feed_forward_size'])} AS intermediate_size
  FROM cfgs)
SELECT 'part/' || p_partkey AS model_id,
  CASE WHEN error IS NULL THEN model_type ELSE '' END AS model_type,
  CASE WHEN error IS NULL THEN architecture ELSE '' END AS architecture,
  coalesce(CASE WHEN error IS NULL THEN num_layers END, -1) AS num_layers,
  coalesce(CASE WHEN error IS NULL THEN num_attention_heads END, -1) AS num_attention_heads,
  coalesce(CASE WHEN error IS NULL THEN num_key_value_heads END, -1) AS num_key_value_heads,
  coalesce(CASE WHEN error IS NULL THEN embedding_dimensions END, -1) AS embedding_dimensions,
  coalesce(CASE WHEN error IS NULL THEN (embedding_dimensions // nullif(num_attention_heads, 0)) END, -1)::BIGINT AS attention_dimensionality,
  coalesce(CASE WHEN error IS NULL THEN vocabulary_size END, -1)::BIGINT AS vocabulary_size,
  coalesce(CASE WHEN error IS NULL THEN max_position_embeddings END, -1) AS max_position_embeddings,
  coalesce(CASE WHEN error IS NULL THEN intermediate_size END, -1) AS intermediate_size,
  coalesce(error, '') AS error
FROM f"""


@query("model_arch", _ARCH_SQL)
def q_model_arch(spark, d):
    p = read(spark, d, "part")
    cfg, tok_cfg, tok_json = _cfg_exprs()
    p = p.select("p_partkey", *parsed_maps(cfg, tok_cfg, tok_json))
    cols = arch_columns()
    ok = cols["error"].isNull()
    out = [F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("model_id")]
    for c in ("model_type", "architecture"):
        out.append(F.when(ok, cols[c]).otherwise(F.lit("")).alias(c))
    for c in ("num_layers", "num_attention_heads", "num_key_value_heads", "embedding_dimensions",
              "attention_dimensionality", "vocabulary_size", "max_position_embeddings", "intermediate_size"):
        out.append(F.coalesce(F.when(ok, cols[c]), F.lit(-1).cast("long")).alias(c))
    out.append(F.coalesce(cols["error"], F.lit("")).alias("error"))
    return p.select(*out)


@query("model_id_norm", f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url
                                ELSE '{HUB_PREFIX}' || regexp_replace(url, '^https?://[^/]+/', '') END AS raw FROM pages)
SELECT page_id, CASE WHEN starts_with(raw, '{HUB_PREFIX}')
                     THEN array_to_string(string_split(replace(raw, '{HUB_PREFIX}', ''), '/')[1:2], '/') ELSE raw END AS model_id
FROM u""")
def q_model_id_norm(spark, d):
    pg = read(spark, d, "pages")
    raw = F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("url")).otherwise(
        F.concat(F.lit(HUB_PREFIX), F.regexp_replace("url", "^https?://[^/]+/", "")))
    return pg.select("page_id", model_id_norm(raw).alias("model_id"))
