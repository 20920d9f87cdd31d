"""Column expressions over message texts: token estimates, token sets, overlap scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts whose characters count as one token each, fixed ranges.
WIDE = "[^㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"
#: A sentence cut: a sentence end, closing marks, white space.
CUT = r"""[.!?。！？](["')\]}]*)\s+"""


def estimate_tokens(text: Column) -> Column:
    """At least 1: wide characters count 1, all others a quarter, rounded up over the text. Null: null."""
    wide = F.length(F.regexp_replace(text, WIDE, ""))
    return F.greatest(F.lit(1), F.ceil(wide + (F.length(text) - wide) / 4)).cast("long")


def token_set(text: Column) -> Column:
    """The distinct lower-case runs of letters, digits and underscores that are longer than one character."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def overlap(a: Column, b: Column) -> Column:
    """The overlap coefficient of two token sets: common tokens over the smaller set's, 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def sentence_cuts(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CUT)).cast("long")


def clipped(text: Column, limit: int = 256) -> Column:
    """The text, or its first ``limit`` characters and three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def payload_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def first_difference(a: Column, b: Column) -> Column:
    """Null for equal texts, else the 0-based position of the first character that differs."""
    chars = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    return F.when(a != b, F.element_at(F.filter(chars, lambda i: ~F.substring(a, i, F.lit(1)).eqNullSafe(F.substring(b, i, F.lit(1)))), 1) - 1)


def byte_verdict(a: Column, b: Column) -> Column:
    """``identical``, ``identical-except-final-line-ending`` or ``different``."""
    bare = [F.regexp_replace(x, r"\r?\n$", "") for x in (a, b)]
    return F.when(a == b, "identical").when(bare[0] == bare[1], "identical-except-final-line-ending").otherwise("different")
