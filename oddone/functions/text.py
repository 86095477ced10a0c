"""String semantics of the answer-cleaning steps, expressed with built-in functions.

The reference cleans generations with Python ``str`` methods; these helpers keep
Python's meaning (Unicode whitespace for ``strip``/``split``, code-point offsets,
case-insensitive substring search) while staying inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.isspace() accepts (what strip()/split() remove).
PY_WHITESPACE = (
    "\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
WS_CLASS = "[" + PY_WHITESPACE + "]"

# Fixed values used by the reference's answer cleaning.
THINK_TAG = "<think>"
VLM_LABEL = "Falcon:"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``s.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def py_split(c) -> Column:
    """Python ``s.split()``: runs of whitespace separate, empty pieces dropped."""
    return F.filter(F.split(_c(c), WS_CLASS + "+"), lambda w: w != F.lit(""))


def strip_think(g) -> Column:
    """Keep everything after the first ``<think>`` tag (then strip); unchanged if absent."""
    g = _c(g)
    pos = F.locate(THINK_TAG, g)
    return F.when(pos > 0, py_strip(F.substr(g, pos + F.lit(len(THINK_TAG))))).otherwise(g)


def strip_echo(prompt, g) -> Column:
    """Drop the echoed prompt: the last prompt word found in the output (scanning the prompt's
    words from last to first) marks the cut; keep the text after its last occurrence, stripped."""
    g = _c(g)
    words = F.array_distinct(F.reverse(py_split(_c(prompt))))  # each word once, from the end
    last = F.get(words, 0)
    hit = F.when(F.contains(g, last), last).otherwise(F.get(F.filter(words, lambda w: F.contains(g, w)), 0))
    return F.when(hit.isNull(), py_strip(g)).otherwise(py_strip(F.call_function("substring_index", g, hit, F.lit(-1))))


def strip_label(g) -> Column:
    """Keep the text after the last ``Falcon:`` label, stripped."""
    return py_strip(F.substring_index(_c(g), VLM_LABEL, -1))


def clean_generation(prompt, g, strip_prompt_echo=True) -> Column:
    """The causal-LM cleaning chain: reasoning tag, then prompt echo (or only strip)."""
    t = strip_think(g)
    if isinstance(strip_prompt_echo, Column):
        return F.when(strip_prompt_echo, strip_echo(prompt, t)).otherwise(py_strip(t))
    return strip_echo(prompt, t) if strip_prompt_echo else py_strip(t)


def match_offset(g, cand, word_boundary: bool = False) -> Column:
    """1-based offset of ``cand`` in ``g`` ignoring case, 0 when absent (empty cand -> 1).
    With ``word_boundary`` the candidate must stand as a whole word (``bat`` does not hit ``bathtub``)."""
    if word_boundary:
        pattern = F.concat(F.lit("(?iu)(?<![\\w])\\Q"), F.replace(_c(cand), F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                           F.lit("\\E(?![\\w])"))
        return F.call_function("regexp_instr", _c(g), pattern)
    return F.position(F.lower(_c(cand)), F.lower(_c(g)))


def match_first(g, y, z, word_boundary: bool = False) -> Column:
    """Earliest case-insensitive match of y or z in g; a tie goes to y; none -> NULL.
    Substring matching by default, as the reference does; ``word_boundary=True`` is the fixed variant."""
    py, pz = match_offset(g, y, word_boundary), match_offset(g, z, word_boundary)
    return (F.when((py > 0) & ((pz == 0) | (py <= pz)), _c(y))
            .when(pz > 0, _c(z)))


def match_first_n(g, cands: list) -> Column:
    """n-candidate form: candidate with the smallest offset, ties in list order; none -> NULL."""
    g = _c(g)
    arr = F.array(*[F.struct(match_offset(g, c).alias("pos"), F.lit(i).alias("ord"), _c(c).alias("cand"))
                    for i, c in enumerate(cands)])
    best = F.array_min(F.filter(arr, lambda s: s["pos"] > 0))
    return best["cand"]


def resolve_choice(chosen, y, z) -> tuple[Column, Column]:
    """(winner, loser) from the chosen string; y is checked before z; else both NULL."""
    chosen, y, z = _c(chosen), _c(y), _c(z)
    winner = F.when(chosen == y, y).when(chosen == z, z)
    loser = F.when(chosen == y, z).when(chosen == z, y)
    return winner, loser


#: Characters that a file name may not hold, and what stands for each.
UNSAFE, SAFE = "/ ", "__"


def safe_name(c) -> Column:
    """File-name safe model name: ``/`` and space become ``_``."""
    return F.translate(_c(c), UNSAFE, SAFE)
