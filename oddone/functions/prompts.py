"""Prompt construction: template interpolation, instruction suffix, chat and image prompts."""

from __future__ import annotations

import string
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vision-model prompt frame and the preview width of the reference.
VLM_PREFIX = "User:<image>\n"
VLM_SUFFIX = " Falcon:"
PREVIEW_CHARS = 80

# Fixed value: the shipped triplet instruction template.
TRIPLET_TEMPLATE = (
    "You are a helpful assistant who gives responses to questions. QUESTION: Which item is most "
    "similar to {item_x}: {item_y} or {item_z}? Respond only with the item name. "
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """Split a ``str.format`` template into (literal, field) pieces on the driver."""
    if template is None:
        raise ValueError("there is no template to render")
    pieces = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if field is not None and (spec or conv):
            raise ValueError(f"format spec/conversion not supported in field {{{field}}}")
        if field is not None and (field == "" or field.isdigit() or "." in field or "[" in field):
            raise ValueError(f"positional or attribute field {{{field}}} not supported")
        pieces.append((literal, field))
    return pieces


def render_template(template: str, fields: dict) -> Column:
    """``template.format(**fields)`` as one ``concat``: values are inserted literally (a value that
    itself looks like ``{item_y}`` is not substituted again); ``{{``/``}}`` are escapes; an unknown
    placeholder renders the empty string, as the reference does after its KeyError."""
    pieces = parse_template(template)
    missing = [f for _, f in pieces if f is not None and f not in fields]
    if missing:
        warnings.warn(f"no value for {missing[0]!r}: the prompt is empty")
        return F.lit("")
    parts = []
    for literal, field in pieces:
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(_c(fields[field]).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def add_suffix(prompt, instr) -> Column:
    """``prompt + instr`` when instr is set (NULL and '' are no-ops)."""
    if instr is None:
        return _c(prompt)
    suffix = F.lit(instr) if isinstance(instr, str) else instr
    return F.concat(_c(prompt), F.coalesce(suffix, F.lit("")))


def chat_messages(prompt, instr=None) -> Column:
    """One user turn ``[{role:'user', content}]`` as an array of structs."""
    content = add_suffix(prompt, instr) if instr is not None else _c(prompt)
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def vlm_prompt(prompt, instr=None) -> Column:
    """``User:<image>\\n{prompt[+instr]} Falcon:``."""
    content = add_suffix(prompt, instr) if instr is not None else _c(prompt)
    return F.concat(F.lit(VLM_PREFIX), content, F.lit(VLM_SUFFIX))


def preview(prompt, width: int = PREVIEW_CHARS) -> Column:
    """First ``width`` characters, plus ``...`` when longer."""
    p = _c(prompt)
    return F.concat(F.left(p, F.lit(width)), F.when(F.length(p) > width, F.lit("...")).otherwise(F.lit("")))
