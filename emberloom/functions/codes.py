"""Expressions over code sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_codes(c: Column) -> Column:
    """Codes trimmed and upper-cased; only G or S with four to six digits stay."""
    folded = F.transform(c, lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda x: x.rlike(r"^[GS]\d{4,6}$"))))


def ignored_codes(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: ~F.upper(F.trim(x)).rlike(r"^[GS]\d{4,6}$")))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 if either is empty or null."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0.0))


def split_values(c: Column) -> Column:
    """'|' or ';' separated values, trimmed, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[|;]"), lambda x: F.trim(x)), lambda x: x != ""))


def code_level(c: Column, digits: int) -> Column:
    return F.array_distinct(F.transform(F.filter(c, lambda x: F.char_length(x) >= digits), lambda x: F.substring(x, 1, digits)))


def union_of(c: Column) -> Column:
    """Aggregate: sorted union of an array column."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
