"""Registered queries over the driver tables, each with its SQL oracle (or none).

``REGISTRY[name] = (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Modules register on import; :func:`load_all` imports them all.
"""

from __future__ import annotations

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    from oddone.catalog import (  # noqa: F401
        q_config, q_embedding, q_index, q_prompts, q_runlog, q_sampling, q_scoring, q_text, q_vectors)
    return REGISTRY
