"""Vector algebra on array<double>."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def is_finite(a: Column, size: int) -> Column:
    """Whether a is a vector of this length without nulls, NaN or infinities."""
    return F.coalesce((F.size(a) == size) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """a over its norm; null for a zero vector."""
    n = norm(a)
    return F.when(n > eps, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def chord(a: Column, b: Column) -> Column:
    """Distance of the unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine(a, b)))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def dims(v: Column) -> Column:
    """Positions and values, to be exploded for per-dimension aggregates."""
    return F.posexplode(v)
