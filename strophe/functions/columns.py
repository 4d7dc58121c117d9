"""Column expressions that operators share."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def seconds(ts: str) -> Column:
    """Seconds since the start of 2024, to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))") / 1e6


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: what JSON and sorting need."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays over their common length."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x - y, F.lit(0.0)), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def similarity_threshold(similarity: Column) -> Column:
    """Distance threshold of a similarity: straight lines through (0.78, 95), (0.86, 80) and
    (0.92, 70), carried on past the ends; input held to 0.65..0.95, result to 1..100."""
    s = clamp(similarity, 0.65, 0.95)
    low = 95.0 + (s - 0.78) / 0.08 * -15.0
    high = 80.0 + (s - 0.86) / 0.06 * -10.0
    return clamp(F.bround(F.when(s <= 0.86, low).otherwise(high), 0), 1.0, 100.0)


@cache
def plain_letters() -> tuple[str, str]:
    """Characters that are one character with marks, and that character, by the canonical
    decomposition of each code point up to U+FFFF."""
    bare = {}
    for k in range(0x80, 0x10000):
        parts = [c for c in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(c)[0] != "M"]
        if len(parts) == 1 and parts[0] != chr(k):
            bare[chr(k)] = parts[0]
    return "".join(bare), "".join(bare.values())


def slug(x: Column, fallback: str = "local-audio") -> Column:
    """Lower-case id of letters and digits without their marks: runs of blanks and of - _ . become one
    dash, other signs and characters beyond U+FFFF go.

    Precomposed letters are mapped by the Unicode tables, as a literal in the plan, so no Python runs. Hangul
    syllables, which come apart to several letters, stay whole.
    """
    text = F.lower(F.regexp_replace(F.translate(x, *plain_letters()), r"[\p{Mn}\x{10000}-\x{10FFFF}]", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}\x{85}\-_.]+", "-"), r"[^\p{L}\p{Nd}\-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"-{2,}", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(fallback)).otherwise(text)
