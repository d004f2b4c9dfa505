"""Text expressions. Patterns are Unicode-aware; an absent match is null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# maximal runs of word characters, so no boundary assertions are needed
WORD = r"(?U)\w+"
WORD2 = r"(?U)\w\w+"


def case_or_length(col: str, op: str) -> Column:
    c = F.col(col).cast("string")
    return {"Lowercase": F.lower, "Uppercase": F.upper, "Length": F.length}[op](c)


def extract(col: str, pattern: str) -> Column:
    """First match of the whole pattern, null when there is none."""
    c = F.col(col).cast("string")
    return F.when(c.rlike(pattern), F.regexp_extract(c, f"({pattern})", 1))


def replace(col: str, pattern: str, by: str) -> Column:
    return F.regexp_replace(F.col(col).cast("string"), pattern, by)


def split_keep(col: str, separator: str, n: int) -> Column:
    """N-th part (0-based) after a literal split; out of range is null."""
    return F.get(F.split(F.col(col).cast("string"), re.escape(separator)), F.lit(int(n)))


def clean(col: str | Column, lowercase: bool = True, strip: bool = True, special: bool = True,
          digits: bool = False, spaces: bool = True) -> Column:
    """The text-cleaning steps in their listed order."""
    c = F.col(col) if isinstance(col, str) else col
    if lowercase:
        c = F.lower(c)
    if strip:
        c = F.regexp_replace(c, r"^\s+|\s+$", "")
    if special:
        c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    if digits:
        c = F.regexp_replace(c, r"(?U)\d+", "")
    if spaces:
        c = F.regexp_replace(c, r"\s+", " ")
    return c


def words(col: str | Column, pattern: str = WORD) -> Column:
    """Lower-cased words of the whole text as an array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
