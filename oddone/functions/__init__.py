"""Column expressions. Every function takes and returns ``pyspark.sql.Column``."""

from oddone.functions.hashing import seeded_hash  # noqa: F401
