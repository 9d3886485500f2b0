"""Vector and loss-term expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the norm is floored at 1e-12."""
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def cosine(a: Column, b: Column) -> Column:
    floor = F.lit(1e-12)
    return dot(a, b) / (F.greatest(l2_norm(a), floor) * F.greatest(l2_norm(b), floor))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def logsumexp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(_sum(F.transform(v, lambda x: F.exp(x - top))))


def hinge(distance: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.lit(float(margin)) - distance)


def nll(p: Column) -> Column:
    return -F.ln(p + F.lit(1e-8))
