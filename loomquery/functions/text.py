"""Text expressions: tokens, stems, substring frequencies and lengths as Columns, or as SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix and replacement in order of trial, and the shortest allowed stem.
SUFFIXES = (
    ("ings", ""), ("tion", ""), ("sion", ""), ("ness", ""), ("ment", ""), ("able", ""), ("ible", ""), ("ally", ""),
    ("ling", ""), ("edly", ""), ("ying", "y"), ("ied", "y"), ("ing", ""), ("ted", ""), ("ed", ""), ("ly", ""),
    ("er", ""), ("es", ""), ("rs", ""), ("ts", ""), ("ns", ""), ("ds", ""), ("s", ""),
)
MIN_STEM = 3
MIN_TOKEN = 2


def stem_sql(word: str) -> str:
    """SQL of the stem of ``word``: the first suffix that leaves a long enough stem is replaced, once."""
    cases = " ".join(
        f"when right({word}, {len(s)}) = '{s}' and length({word}) >= {MIN_STEM + len(s) - len(r)} "
        f"then concat(left({word}, length({word}) - {len(s)}), '{r}')"
        for s, r in SUFFIXES
    )
    return f"case {cases} else {word} end"


def stem(word: Column | str) -> Column:
    """Stem of a lower-case token."""
    word = F.col(word) if isinstance(word, str) else word
    out = None
    for s, r in SUFFIXES:
        fits = F.endswith(word, F.lit(s)) & (F.length(word) >= MIN_STEM + len(s) - len(r))
        cut = F.concat(F.left(word, F.length(word) - len(s)), F.lit(r))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def query_tokens(query: Column | str) -> Column:
    """Lower-case ASCII alphanumeric tokens of two characters or more; everything else separates."""
    query = F.col(query) if isinstance(query, str) else query
    return F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda t: F.length(t) >= MIN_TOKEN)


def query_stems(query: Column | str) -> Column:
    """Distinct stems of a query in order of first appearance."""
    return F.array_distinct(F.transform(query_tokens(query), stem))


def stems_of(query: str) -> list[str]:
    """The same on the driver, for a query known when the plan is built."""
    found = dict.fromkeys(_stem(t) for t in re.split("[^a-z0-9]+", query.lower()) if len(t) >= MIN_TOKEN)
    return list(found)


def _stem(token: str) -> str:
    return next((token[: -len(s)] + r for s, r in SUFFIXES if token.endswith(s) and len(token) - len(s) + len(r) >= MIN_STEM), token)


def space_length(text: Column | str) -> Column:
    """Words estimated as spaces plus one; only U+0020 counts."""
    text = F.col(text) if isinstance(text, str) else text
    return F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1


def substring_tf(text: Column | str, needle: str | Column) -> Column:
    """Non-overlapping occurrences of ``needle`` anywhere in ``text``."""
    text = F.col(text) if isinstance(text, str) else text
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return (F.length(text) - F.length(F.replace(text, needle))) / F.length(needle)


def not_blank(text: Column | str) -> Column:
    """Whether there is a character other than Unicode white space; false for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.rlike(text, F.lit(r"(?U)\S")), F.lit(False))


def word_tokens(text: Column | str) -> Column:
    """Lower-case Unicode words of two characters or more."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def concat_fields(*fields: str) -> Column:
    """Fields joined by single spaces; a null field is empty but keeps its space."""
    return F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def field_list(text: str) -> list[str]:
    """Names in a comma-separated list."""
    return [f.strip() for f in text.split(",")]
