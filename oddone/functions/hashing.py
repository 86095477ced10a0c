"""Seeded, partition-independent pseudo-random numbers.

All draws are keyed by ``seed:purpose:id…`` and hashed with md5, so the result
of a draw depends only on its key — never on partitioning, task order or retry —
and the same number can be computed by any SQL engine with md5 and hex parsing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number of hex digits of the md5 digest used as the random integer
# (15 hex digits = 60 bits, fits a signed BIGINT in every engine).
HASH_HEX_DIGITS = 15
HASH_SPACE = 16 ** HASH_HEX_DIGITS


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def seeded_hash(seed, purpose, *parts) -> Column:
    """Uniform BIGINT in ``[0, 2**60)`` from ``md5('seed:purpose:part…')``."""
    key = F.concat_ws(":", *[_lit(p).cast("string") for p in (seed, purpose, *parts)])
    return F.conv(F.substring(F.md5(key), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def seeded_choice(n: Column, seed, purpose, *parts) -> Column:
    """Uniform position in ``[0, n)`` (modulo bias below n / 2**60)."""
    return F.pmod(seeded_hash(seed, purpose, *parts), n.cast("bigint"))
