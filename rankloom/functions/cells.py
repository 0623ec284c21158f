"""Small null-safe predicates and the canonical form of a text cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, visible or not, and control characters.
INVISIBLE = r"[\s\p{Z}\p{C}]"


def has_content(c: Column) -> Column:
    """True where the text holds more than white space; false for null."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False))


def canonical(c: Column) -> Column:
    """Letters and digits in lower case; null and blank become the empty string."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.replace(F.lower(kept), F.lit("ß"), F.lit("ss"))
