"""Licence scan by canonical digest: a whole text against the digests of known licence texts.

Texts are brought to a canonical form (lower case, no copyright lines, no punctuation, one spelling for
words spelt in several ways), hashed, and joined with the digests of the known texts in the same form. The
known texts are a fixed, small table, so that side is broadcast and the documents are not shuffled.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT_LINE = r"\n[ \t*#/;]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[:])|\(c\)[ \t]|©)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Pairs of equivalent spellings, the first replaced by the second.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("acknowledgments", "acknowledgements"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("categorised", "categorized"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"),
    ("judgment", "judgement"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"),
    ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("sub licence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _WARRANTY
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""

#: Known texts by identifier, more than one where a text goes with and without its title.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC}.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_NAMES}\n{_BSD_TAIL}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_NAMES}\n{_BSD_TAIL}"),
)

#: Full texts as files, where their first clause or preamble begins, and the line at the end of their terms.
TEXTS = Path(__file__).parent / "license_texts"
HEAD = re.compile(r"^[ \t]*(?:Preamble|TERMS AND CONDITIONS FOR USE|Statement of Purpose|(?:0|1)\. (?:Definitions|PREAMBLE))", re.M)
END = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", re.M)


def canonical(text: Column) -> Column:
    """The canonical form; null is empty."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))), COPYRIGHT_LINE, "")
    words = F.regexp_replace(F.replace(lines, F.lit("all rights reserved"), F.lit(" ")), NOT_WORD, "  ")
    padded = F.concat(F.lit("  "), words, F.lit("  "))  # two blanks between words: each has a blank of its own on either side
    for old, new in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(padded, " +", " "))


def full_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the files in ``license_texts`` (named by identifier), each whole, without what stands before
    its first clause or preamble (title, version, address), and both also without what follows the end of its terms."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        head = HEAD.search(text)
        for t in (text, text[head.start():] if head else text):
            end = END.search(t)
            out += [(path.stem, t), *([(path.stem, t[:end.start()]), (path.stem, t[:end.end()])] if end else [])]
    return out


def known_texts() -> list[tuple[str, str]]:
    """All known texts, of the query and of its SQL: those in the code and those in files."""
    return [*KNOWN, *full_texts()]


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """``license_id, digest`` of the :func:`known_texts`; a form that two identifiers share goes to the lesser one."""
    known = known_texts() if known is None else known
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    return texts.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_digest`` (SHA-256 of the canonical form), ``license_id`` (null
    if the entire text is no known one).

    A null or empty text, or one of punctuation only, has an empty form and matches none. A null id stays
    null; repeated rows are judged each on their own; an empty table gives an empty result; other columns of
    ``docs`` are not read. ``known`` replaces the fixed table; it is broadcast only if Spark finds it small.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known
    found = docs.select(docs[id_col].alias("doc_id"), F.sha2(canonical(docs[text_col]), 256).alias("text_digest"))
    match = known.select(F.col("digest").alias("text_digest"), "license_id").filter(F.col("text_digest") != F.sha2(F.lit(""), 256))
    return found.join(match, "text_digest", "left").select("doc_id", "text_digest", "license_id")


def sql() -> str:
    """The same in DuckDB SQL over ``documents``, with the same known texts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    def form(text: str) -> str:
        words = f"regexp_replace(replace(regexp_replace(chr(10) || lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '', 'g'), " \
                f"'all rights reserved', ' '), {quote(NOT_WORD)}, '  ', 'g')"
        padded = reduce(lambda s, p: f"replace({s}, {quote(' ' + p[0].replace(' ', '  ') + ' ')}, {quote(' ' + p[1].replace(' ', '  ') + ' ')})",
                        SPELLINGS, f"('  ' || {words} || '  ')")
        return f"sha256(trim(regexp_replace({padded}, ' +', ' ', 'g')))"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())
    return f"""
WITH known AS (SELECT {form('text')} AS digest, min(license_id) AS license_id FROM (VALUES {rows}) AS k(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {form('text')} AS text_digest FROM documents)
SELECT doc_id, text_digest, license_id FROM d LEFT JOIN known ON digest = text_digest AND digest <> sha256('')
"""
