"""Distances between embedding columns and a query vector; double arithmetic in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def l2(x: Column, query: Column) -> Column:
    """Squared parts summed in order, then the root; null if either is null."""
    return F.sqrt(F.aggregate(F.zip_with(x.cast("array<double>"), query, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def dot(x: Column, query: Column) -> Column:
    return F.aggregate(F.zip_with(x.cast("array<double>"), query.cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, query: Column) -> Column:
    return dot(x, query) / F.sqrt(dot(x, x) * dot(query, query))
