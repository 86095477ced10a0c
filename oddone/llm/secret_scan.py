"""Secret scans with multipart credential linking, in DataFrame functions only.

Matches are found with ``regexp_extract_all`` and placed with ``split`` on the same pattern: the pieces
between the matches give each match's start. Besides the strong kinds (assignments, access keys, long hex)
three weak kinds are looked for: short secret values, account identifiers and endpoints. A weak candidate
alone means little. It is reported only where an interval join with the other candidates of its text finds
the parts it lacks inside its scope: they start within ``SCOPE`` code points of it,

* a weak secret needs an identifier (weak or an access key) or an endpoint,
* a weak identifier needs a secret (weak or strong),
* an endpoint needs both an identifier and a secret.

The join runs inside the row, over the candidates sorted by start: matches of one kind don't overlap and have
a least length, so only a bounded number of neighbours can start inside a scope, and looking at those is
exact. Nothing is shuffled, and repeated rows or ids need no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200

#: The strong patterns of the scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Values of an assignment shorter than this are weak secrets, if they have a digit and at least WEAK characters.
STRONG, WEAK = 12, 6

IDENTIFIER = (r"""\b(?i:user(?:name|_id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
              r"""[A-Za-z0-9@+/_.-]{3,}""")
ENDPOINT = r"""\b(?:https?|ftps?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{3,}"""

KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
#: Least lengths of the kinds' matches: key word, sign and value for those with a key.
LEAST = (7 + STRONG - 1, 18, 16, 12, 9, 9)
#: Candidates on one side of another, sorted by start, that can lie inside a scope.
NEIGHBOURS = sum(SCOPE // n + 2 for n in LEAST)

#: Entries of an array that one running fold appends to, and code points of a chunk that spans are cut from.
STEP, CHUNK = 256, 1024

SPAN = "struct<start:int,kind:int,end:int>"


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, fold) -> Column:
    """For each entry of an array of ints, ``fold`` (from 0) over the entries before it. Appending to an array copies it, so the
    fold runs over blocks of ``STEP`` entries first and then inside each."""
    def run(array: Column, first: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, v: F.struct(fold(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(array: Column) -> Column:
        last = F.greatest(F.floor((F.size(array) - 1) / STEP).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(array, k * STEP + 1, F.lit(STEP)))
        return _bound(blocks, lambda bs: F.flatten(F.zip_with(
            bs, run(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), fold)), F.lit(0)), run)))

    return _bound(values, whole)


def _placed(text: Column, pattern: str, found: Column, kind: Column | int, values: Column | None = None) -> Column:
    """The (start, kind, end) of the matches ``found`` of ``pattern``, by the lengths of the pieces between.

    ``kind`` may depend on a match's entry of ``values``; matches of a null kind are dropped."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(pieces: Column) -> Column:
        lengths = F.zip_with(pieces, found, lambda p, f: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(f), F.lit(0)))
        zipped = F.arrays_zip(pieces.alias("piece"), found.alias("found"), (found if values is None else values).alias("value"),
                              _before(lengths, lambda x, y: x + y).alias("at"))

        def span(x: Column) -> Column:
            start = x["at"] + F.length(x["piece"])
            which = F.lit(kind) if isinstance(kind, int) else kind(x["value"])
            return F.struct(start.alias("start"), which.cast("int").alias("kind"), (start + F.length(x["found"])).alias("end"))

        placed = F.transform(F.filter(zipped, lambda x: x["found"].isNotNull()), span)
        return F.filter(placed, lambda s: s["kind"].isNotNull())

    return F.when(F.size(found) > 0, _bound(F.split(text, pattern, -1), spans)).otherwise(none)


def _candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array ``out`` of all strong and weak matches, sorted by start, kind, end."""
    t = F.coalesce(F.col(text), F.lit(""))
    grade = lambda v: F.when(F.length(v) >= STRONG, 0).when((F.length(v) >= WEAK) & v.rlike("[0-9]"), 3)
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "i": IDENTIFIER, "e": ENDPOINT}
    own = {n: f"{out}_{n}" for n in [*patterns, "v"]}
    found = {own[n]: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for n, p in patterns.items()}
    df = df.withColumns(found | {own["v"]: F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))})
    kinds = {"a": grade, "k": 1, "h": 2, "i": 4, "e": 5}
    spans = [_placed(t, patterns[n], F.col(own[n]), kinds[n], F.col(own["v"]) if n == "a" else None) for n in patterns]
    return df.withColumn(out, F.array_sort(F.concat(*spans))).drop(*own.values())


def _linked(candidates: Column) -> Column:
    """The strong candidates, and those weak ones whose complementary parts start within ``SCOPE`` of them."""
    def reported(c: Column, i: Column) -> Column:
        near = F.slice(candidates, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), F.lit(2 * NEIGHBOURS + 1))
        part = lambda *kinds: F.exists(near, lambda d: d["kind"].isin(*kinds) & (F.abs(d["start"] - c["start"]) <= SCOPE))
        secret, identifier, endpoint = part(0, 2, 3), part(1, 4), part(5)
        return (F.when(c["kind"] == 3, identifier | endpoint).when(c["kind"] == 4, secret)
                .when(c["kind"] == 5, identifier & secret).otherwise(F.lit(True)))
    return F.filter(candidates, reported)


def _names(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the strong
    spans as ``kind:start:end``, by start then kind, joined by commas; code points, end exclusive), ``spans`` (all
    reported spans, joined likewise).

    A null or empty text has no spans; a null id stays null; repeated rows are scanned each on their own; an
    empty table gives an empty result; other columns of ``docs`` are not read. Texts are scanned whole. Of
    spans with equal start the kinds come in the order of ``KINDS``.
    """
    found = _candidates(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text", "found")
    found = found.select("doc_id", _linked(F.col("found")).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    base = _names(F.filter("all", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), _names(F.col("all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[redacted]") -> DataFrame:
    """``docs`` with each reported span of ``text_col`` replaced by ``mark``; overlapping spans are replaced once.

    Rows and columns stay as they are; a text without spans, null or empty, is unchanged.
    """
    text, columns = F.col(text_col), docs.columns
    name = next(f"__found{k}" for k in range(len(columns) + 1) if not any(c.startswith(f"__found{k}") for c in columns))
    found = _candidates(docs, text_col, name).withColumn(name, _linked(F.col(name)))

    def cut(chunks: Column) -> Column:
        def piece(a: Column, e: Column) -> Column:
            """The text from a to e, out of its chunks: only the first and the last are searched."""
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(e / CHUNK).cast("int")
            chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
            inner = F.when(last - first > 1, F.array_join(F.slice(chunks, first + 2, last - first - 1), "")).otherwise(F.lit(""))
            return F.when(first == last, chunk(first).substr(a - first * CHUNK + 1, e - a)).otherwise(F.concat(
                chunk(first).substr(a - first * CHUNK + 1, F.lit(CHUNK)), inner, chunk(last).substr(F.lit(1), e - last * CHUNK)))

        spans = F.arrays_zip(F.col(name).alias("s"), _before(F.transform(F.col(name), lambda s: s["end"]), lambda x, y: F.greatest(x, y)).alias("at"))
        kept = F.transform(F.filter(spans, lambda x: x["s"]["start"] >= x["at"]), lambda x: piece(x["at"], x["s"]["start"]))
        end = F.array_max(F.transform(F.col(name), lambda s: s["end"]))
        return F.array_join(F.concat(kept, F.array(piece(end, F.length(text)))), mark)

    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return found.withColumn(text_col, F.when(F.size(name) > 0, _bound(whole, cut)).otherwise(text)).select(*columns)
