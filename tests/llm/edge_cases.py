"""Rows that every operator on documents must take: nulls, empties, long texts, ties, repeats."""

from __future__ import annotations

LONG_WORD = "x" * 120_000
LONG_TEXT = "The lorry was red. " * 10_000
PROSE = "A plain text about the sea and the ships on it, with enough words to look at. " * 4

#: Names that operators use for columns of their own.
CLASHES = ["score", "kept", "fp", "root", "least", "row", "file", "_row", "_text", "length", "start", "clean_text", "row_number"]

TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (None, PROSE), (3, None), (4, ""), (5, " \t\r\n\x0b\x0c"), (6, None), (None, None),
    (7, LONG_WORD), (8, LONG_TEXT), (9, LONG_TEXT + " "), (10, "ÄÖÜ ñandú ▁ 漢字 \U0001f600 İstanbul"), (11, "..."), (12, "1234"),
]


def documents(spark, rows=TEXTS, clashes=CLASHES):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", `{c}` string" for c in clashes)
    full = [(i, t, "en", None, None if t is None else len(t), *["x"] * len(clashes)) for i, t in rows]
    return spark.createDataFrame(full, schema)


def empty(spark):
    return documents(spark, [])
