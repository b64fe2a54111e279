"""Cosine distance of array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clipped(cosine: Column, norms: Column) -> Column:
    """1 - cosine, within 0 and 2; a zero vector has distance 1 to all."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.when(norms == 0, 1.0).otherwise(1.0 - cosine / norms)))


def cosine_distance(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return clipped(dot(a, b), norm(a) * norm(b))


def distance_to(a: Column, vector: list[float], own_norm: Column | None = None) -> Column:
    """Cosine distance to one vector, whose norm is computed once; the row's norm can be given, as a stored column."""
    a = a.cast("array<double>")
    return clipped(dot(a, literal(vector)), (norm(a) if own_norm is None else own_norm) * F.lit(math.sqrt(math.fsum(float(x) * float(x) for x in vector))))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
