"""Rates, percentiles, intervals and vector maths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, n: Column, digits: int = 4) -> Column:
    """hits / n, rounded half to even; null when n is 0."""
    return F.bround(F.try_divide(hits.cast("double"), n.cast("double")), digits)


def rate_struct(condition: Column, over: Column | None = None) -> Column:
    """Aggregate: struct<hits, n, rate> of a condition over the rows (of those where `over` holds)."""
    over = F.lit(True) if over is None else over
    hits, n = F.count_if(F.coalesce(condition, F.lit(False)) & over), F.count_if(over)
    return F.struct(hits.alias("hits"), n.alias("n"), rate(hits, n).alias("rate"))


def nearest_rank(n: Column, percent: int) -> Column:
    """Index from 0 of a percentile among n sorted values: p * (n - 1), rounded half to even."""
    return F.bround(F.lit(percent / 100.0) * (n - 1)).cast("long")


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    return _wilson(hits, n, z, -1)


def wilson_high(hits: Column, n: Column, z: float = 1.96) -> Column:
    return _wilson(hits, n, z, 1)


def _wilson(hits: Column, n: Column, z: float, sign: int) -> Column:
    n = n.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    centre = p + z * z / (2 * F.nullif(n, F.lit(0.0)))
    spread = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n * n, F.lit(0.0))))
    out = (centre + sign * spread) / (1 + z * z / F.nullif(n, F.lit(0.0)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalise(v: Column) -> Column:
    norm = F.coalesce(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / norm)


def confidence(scores: Column, n_citations: Column, grade: Column) -> Column:
    """Mean of the cited passages' known scores times 1 (good) or 0.6 (else), in [0, 1], to 3 digits.

    Without any known score: null where something is cited, 0 where nothing is.
    """
    known = F.filter(scores, lambda s: s.isNotNull())
    return confidence_of_sum(F.aggregate(known, F.lit(0.0), lambda a, s: a + s), F.size(known), n_citations, grade)


def confidence_of_sum(total: Column, known: Column, n_citations: Column, grade: Column) -> Column:
    """confidence, from the sum and the number of known scores."""
    mean = F.try_divide(total, known.cast("double"))
    factor = F.when(grade == "good", F.lit(1.0)).otherwise(F.lit(0.6))
    value = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean * factor)), 3)
    return F.when(known > 0, value).when(n_citations > 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))


def position_between(before: Column, after: Column, now: Column) -> Column:
    """A list position between two neighbours: their middle, 1024 beyond the only one, or now."""
    return (
        F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2)
        .when(before.isNotNull(), before + 1024)
        .when(after.isNotNull(), after - 1024)
        .otherwise(now)
    )
