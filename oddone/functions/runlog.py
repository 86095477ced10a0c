"""Run-log line format: ``ts\\tname\\tok=True\\tsecs=1.234\\thost=h[\\terror="…"]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the timing-line layout of the reference (ISO seconds, %.3f seconds).
LINE_PATTERN = r'^([^\t]*)\t([^\t]*)\tok=(True|False)\tsecs=([-0-9.]+|nan)\thost=([^\t]*)(?:\terror="(.*)")?$'
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A field is escaped so that it can hold any text: backslash first, then the line's own separators; NULL is \N.
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
NULL_FIELD = "\\N"


def escape_field(c) -> Column:
    out = _c(c)
    for raw, written in _ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(written))
    return F.coalesce(out, F.lit(NULL_FIELD))


def unescape_field(c) -> Column:
    """Inverse of :func:`escape_field`: cut at escaped backslashes, so that what follows one is no escape."""
    def plain(part: Column) -> Column:
        for raw, written in _ESCAPES[1:]:
            part = F.replace(part, F.lit(written), F.lit(raw))
        return part
    parts = F.transform(F.split(_c(c), r"\\\\"), plain)
    return F.when(_c(c) != NULL_FIELD, F.array_join(parts, "\\"))


def format_line(ts, name, ok, secs, host, error) -> Column:
    """One log line; the error field only when ``ok`` is false.  NULL fields and separators inside a field come
    back from :func:`parse_line` as they were; a NULL ``ok`` counts as failed, NULL seconds are written ``nan``."""
    ok = F.coalesce(_c(ok), F.lit(False))
    secs = F.when(_c(secs).isNull(), F.lit("nan")).otherwise(F.format_string("%.3f", F.bround(_c(secs), 3)))
    base = F.concat(F.coalesce(F.date_format(_c(ts), TS_FORMAT), F.lit(NULL_FIELD)), F.lit("\t"), escape_field(name),
                    F.when(ok, F.lit("\tok=True\tsecs=")).otherwise(F.lit("\tok=False\tsecs=")), secs,
                    F.lit("\thost="), escape_field(host))
    return F.when(ok, base).otherwise(F.concat(base, F.lit('\terror="'), escape_field(error), F.lit('"')))


def parse_line(line) -> dict[str, Column]:
    """Fields of a log line; NULLs for a line that does not match."""
    line = _c(line)

    def grp(i):
        return F.regexp_extract(line, LINE_PATTERN, i)

    matched = line.rlike(LINE_PATTERN)
    return {
        "ts": F.when(matched & (grp(1) != NULL_FIELD), F.to_timestamp_ntz(grp(1), F.lit(TS_FORMAT))),
        "name": F.when(matched, unescape_field(grp(2))),
        "ok": F.when(matched, grp(3) == "True"),
        "secs": F.when(matched & (grp(4) != "nan"), grp(4).try_cast("double")),
        "host": F.when(matched, unescape_field(grp(5))),
        "error": F.when(matched & (grp(3) == "False"), unescape_field(grp(6))),
    }
