"""Model-architecture records (E3) as one projection over a table of fetched config texts:
``(model_id, config_json, tokenizer_config_json, tokenizer_json)`` -> typed architecture fields.
Fetching the files is outside the library; missing numbers are NULL (render "Not found" at display)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.functions.metadata import arch_columns, model_id_norm, parsed_maps

ARCH_FIELDS = ["model_type", "architecture", "num_layers", "num_attention_heads", "num_key_value_heads",
               "embedding_dimensions", "attention_dimensionality", "vocabulary_size", "max_position_embeddings",
               "intermediate_size"]


def model_arch(configs: DataFrame, id_col: str = "model_id", cfg: str = "config_json",
               tok_cfg: str = "tokenizer_config_json", tok_json: str = "tokenizer_json") -> DataFrame:
    def col(c):
        return F.col(c) if c in configs.columns else F.lit(None).cast("string")

    cols = arch_columns()
    ok = cols["error"].isNull()
    parsed = configs.select(id_col, *parsed_maps(col(cfg), col(tok_cfg), col(tok_json)))  # each text once
    return parsed.select(model_id_norm(F.col(id_col)).alias("model_id"),
                          *[F.when(ok, cols[f]).alias(f) for f in ARCH_FIELDS], cols["error"].alias("error"))


def display(arch: DataFrame) -> DataFrame:
    """Presentation form: missing values as the reference prints them ('Not found')."""
    return arch.select("model_id", *[F.coalesce(F.col(f).cast("string"), F.lit("Not found")).alias(f)
                                     for f in ARCH_FIELDS], "error")
