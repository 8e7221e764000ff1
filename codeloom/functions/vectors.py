"""Vectors: size, distance, similarity, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def resize(vector: Column | str, dimensions: int) -> Column:
    """Cut, or filled up with zeros."""
    return F.slice(F.concat(_c(vector), F.array_repeat(F.lit(0.0).cast("float"), dimensions)), 1, dimensions)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """In double; null if a vector is null or their lengths differ."""
    parts = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def similarity(d2: Column | str) -> Column:
    return 1 / (1 + _c(d2))


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def average(total: Column | str, count: Column | str) -> Column:
    """Two decimals; 0 of nothing."""
    return F.when(_c(count) == 0, F.lit(0.0)).otherwise(F.round(_c(total) / _c(count), 2))


def two_decimals(score: Column | str) -> Column:
    return F.format_string("%.2f", _c(score))
