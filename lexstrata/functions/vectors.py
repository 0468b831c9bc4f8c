"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column | str) -> Column:
    v = _doubles(v)
    return F.sqrt(_dot(v, v))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Null when either vector is null or has no length."""
    x, y = _doubles(a), _doubles(b)
    return F.try_divide(_dot(x, y), norm(x) * norm(y))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def parse_vector(text: Column | str) -> Column:
    """An array from text such as ``[0.1, 2e-3]``; null where it cannot be read."""
    return F.from_json(col(text), "array<double>")
