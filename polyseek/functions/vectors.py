"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalise(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def tie(score: Column) -> Column:
    """What rankings compare: scores rounded to 9 digits, so that sums in another order rank alike."""
    return F.round(score, 9)


def pick(weights: list[float], codes: Column) -> Column:
    """The weight of each code."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.transform(codes, lambda c: F.element_at(w, (c + 1).cast("int")))
