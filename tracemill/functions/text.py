"""Column helpers for text; every function takes and returns columns and maps null to null unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def present(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def tokens(c: Column) -> Column:
    """Words between white space, without empty ones; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda x: x != "")


def occurrences(c: Column, literal: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def to_double(c: Column) -> Column:
    """A number as the usual decimal notation writes it, null for anything else (suffixes, hexadecimal, underscores)."""
    bare = strip(c)
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null (not an empty string) where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
