"""Dense-vector expressions on ``ARRAY<DOUBLE>`` columns (JVM side, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_euclid(a, b) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, x: acc + x)


def euclid(a, b) -> Column:
    """``numpy.linalg.norm(a - b)``."""
    return F.sqrt(sq_euclid(a, b))


def vec_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x)


def to_text(v) -> Column:
    """Space-joined decimal text of a vector (round-trips exactly through :func:`from_text`)."""
    return F.array_join(F.transform(_c(v), lambda x: x.cast("string")), " ")


def from_text(t) -> Column:
    """Whitespace-separated floats -> ``ARRAY<DOUBLE>``."""
    return F.transform(F.split(F.trim(_c(t)), "\\s+"), lambda x: x.cast("double"))


def log_softmax_at(logits, idx) -> Column:
    """``log_softmax(logits)[idx]`` with the max-shift for stability."""
    lg = _c(logits)
    m = F.array_max(lg)
    lse = F.log(F.aggregate(lg, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return F.get(lg, _c(idx)) - m - lse


def logprob_choice(lp_y, lp_z, y, z) -> tuple[Column, Column]:
    """(winner, loser) by larger log-prob; NaN in either or a tie -> both NULL."""
    lp_y, lp_z, y, z = _c(lp_y), _c(lp_z), _c(y), _c(z)
    nan = F.isnan(lp_y) | F.isnan(lp_z)
    winner = F.when(nan, F.lit(None)).when(lp_y > lp_z, y).when(lp_z > lp_y, z)
    loser = F.when(nan, F.lit(None)).when(lp_y > lp_z, z).when(lp_z > lp_y, y)
    return winner.cast("string"), loser.cast("string")


def first_token(ids, eos) -> Column:
    """First token id, or the EOS id for an empty encoding."""
    return F.coalesce(F.get(_c(ids), 0), eos if isinstance(eos, Column) else F.lit(eos))
