"""Model-architecture fields from config JSON text, with the reference's alias fallbacks.

A key that is *present* wins even when its value is JSON null (the reference tests
``key in config``), so the fallbacks are ``map_contains_key`` chains, not ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias lists, in the reference's order.
LAYER_KEYS = ["num_hidden_layers", "n_layer", "num_layers", "n_layers"]
HEAD_KEYS = ["num_attention_heads", "n_head", "num_heads", "attention_heads"]
KV_HEAD_KEYS = ["num_key_value_heads", "n_kv_head", "num_kv_heads"]
DIM_KEYS = ["hidden_size", "n_embd", "d_model", "embedding_size"]
VOCAB_KEYS = ["vocab_size", "vocabulary_size", "n_vocab"]
POSITION_KEYS = ["max_position_embeddings", "n_positions", "max_sequence_length"]
FFN_KEYS = ["intermediate_size", "n_inner", "ffn_dim", "feed_forward_size"]

# Hub URL prefix stripped from model ids, and the error text of an unusable config.
HUB_PREFIX = "https://huggingface.co/"
CONFIG_ERROR = "Could not fetch model configuration"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_map(j) -> Column:
    """Top-level JSON object -> ``MAP<STRING,STRING>`` (nested values stay JSON text)."""
    return F.from_json(_c(j), "map<string,string>")


def first_present(m, keys: list[str]) -> Column:
    """Value of the first key present in map ``m`` (present-but-null wins); NULL when none."""
    m = _c(m)
    out = None
    for k in keys:
        cond = F.map_contains_key(m, F.lit(k))
        out = F.when(cond, m[k]) if out is None else out.when(cond, m[k])
    return out


def any_present(m, keys: list[str]) -> Column:
    m = _c(m)
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))
    return cond


def as_long(c) -> Column:
    return _c(c).try_cast("bigint")


def json_len(j) -> Column:
    """``len()`` of a JSON object or array given as text; NULL otherwise."""
    j = _c(j)
    return F.coalesce(F.size(F.json_object_keys(j)), F.json_array_length(j))


def parsed_maps(cfg, tok_cfg=None, tok_json=None) -> list[Column]:
    """The maps that :func:`arch_columns` reads, each text parsed once: select these first, the fields from them."""
    none = F.lit(None).cast("string")
    texts = json_map(tok_json if tok_json is not None else none)
    return [json_map(cfg).alias("cfg_map"), json_map(tok_cfg if tok_cfg is not None else none).alias("tok_map"),
            texts.alias("file_map")]


def vocab_size(cm, tm, jm) -> Column:
    """Config aliases -> tokenizer_config.vocab_size -> len(tokenizer.model.vocab) ->
    len(tokenizer.vocab); the last two count 0 as missing.  Arguments are parsed maps."""
    cm, tm, jm = _c(cm), _c(tm), _c(jm)

    def has(m, k):
        return F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))

    vocab_of_model = F.get_json_object(jm["model"], "$.vocab")
    from_file = F.nullif(F.when(has(jm, "model") & vocab_of_model.isNotNull(), json_len(vocab_of_model))
                         .when(has(jm, "vocab"), json_len(jm["vocab"])), F.lit(0))
    tok_has = (F.size(tm) > 0) & has(tm, "vocab_size")
    return (F.when(any_present(cm, VOCAB_KEYS), as_long(first_present(cm, VOCAB_KEYS)))
            .when(tok_has, as_long(tm["vocab_size"]))
            .otherwise(from_file))


def architecture(m) -> Column:
    """``architectures[0]`` of a parsed config, 'Unknown' when missing or empty."""
    arr = F.from_json(_c(m)["architectures"], "array<string>")
    return F.when(F.size(arr) > 0, F.get(arr, 0)).otherwise(F.lit("Unknown"))


def model_type(m) -> Column:
    m = _c(m)
    return F.when(F.map_contains_key(m, F.lit("model_type")), m["model_type"]).otherwise(F.lit("Unknown"))


def config_error(m) -> Column:
    """Error text for a missing or empty parsed config, NULL otherwise."""
    m = _c(m)
    return F.when(m.isNull() | (F.size(m) == 0), F.lit(CONFIG_ERROR))


def model_id_norm(c) -> Column:
    """Hub URL -> ``owner/name``; other ids unchanged."""
    c = _c(c)
    parts = F.slice(F.split(F.replace(c, F.lit(HUB_PREFIX), F.lit("")), "/"), 1, 2)
    return F.when(F.startswith(c, F.lit(HUB_PREFIX)), F.array_join(parts, "/")).otherwise(c)


def arch_columns(cfg_map="cfg_map", tok_map="tok_map", file_map="file_map") -> dict[str, Column]:
    """All architecture fields as typed columns (missing numeric -> NULL), from the maps of :func:`parsed_maps`."""
    m = _c(cfg_map)
    dims, heads = as_long(first_present(m, DIM_KEYS)), as_long(first_present(m, HEAD_KEYS))
    return {
        "model_type": model_type(m),
        "architecture": architecture(m),
        "num_layers": as_long(first_present(m, LAYER_KEYS)),
        "num_attention_heads": heads,
        "num_key_value_heads": as_long(first_present(m, KV_HEAD_KEYS)),
        "embedding_dimensions": dims,
        "attention_dimensionality": F.floor(dims / F.nullif(heads, F.lit(0))).cast("bigint"),
        "vocabulary_size": vocab_size(m, tok_map, file_map),
        "max_position_embeddings": as_long(first_present(m, POSITION_KEYS)),
        "intermediate_size": as_long(first_present(m, FFN_KEYS)),
        "error": config_error(m),
    }
