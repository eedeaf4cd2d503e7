"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once: within a lambda an outer expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column | str) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null where either side is null or the lengths differ."""
    a, b = doubles(a), doubles(b)
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """L2-normalised vector; a zero vector stays as it is."""
    own = doubles(v)
    return let(norm(own), lambda n: F.when(n > 0, F.transform(own, lambda x: x / n)).otherwise(own))


def is_unit(v: Column | str, tolerance: float = 1e-3) -> Column:
    """Finite elements and a norm within tolerance of 1."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite & (F.abs(norm(v) - 1) <= tolerance)


def clip01(x: Column) -> Column:
    """x cut to [0, 1]; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def recalibrated(cosine: Column, base: float) -> Column:
    """A cosine stretched so that base becomes 0; NaN is 0, a base of 1 or more only clips."""
    known = F.nanvl(cosine, F.lit(0.0))
    return clip01(known) if base >= 1 else clip01((known - base) / (1 - base))


#: Lower ends of the similarity bands and the gap that makes a rank uncertain.
STRONG, POSSIBLE, WEAK, GAP = 0.75, 0.55, 0.45, 0.04


def visual_status(top: Column) -> Column:
    return (
        F.when(top >= STRONG, "STRONG_MATCH").when(top >= POSSIBLE, "POSSIBLE_MATCH").when(top >= WEAK, "WEAK_MATCH").otherwise("NO_CLOSE_MATCH")
    )


def uncertainty(n: Column, top: Column, gap: Column) -> Column:
    """Why the first place is uncertain, '' if it is not."""
    return F.when(n < 2, "INSUFFICIENT_CANDIDATES").when((top >= POSSIBLE) & (gap < GAP), "MULTIPLE_CLOSE_CANDIDATES").otherwise("")


def similarity_band(s: Column) -> Column:
    """Half-open strata for labelling packs."""
    return F.when(s < 0.45, "low").when(s < 0.55, "weak").when(s < 0.75, "possible").otherwise("strong")
