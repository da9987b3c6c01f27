"""Vectors as arrays: parsing, norms and products, in built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def parse_vector(json: Column) -> Column:
    """A JSON array as ``array<double>``; broken JSON and null elements give null."""
    v = F.from_json(json, "array<double>")
    return F.when(~F.exists(v, lambda x: x.isNull()), v)


def vector_json(v: Column) -> Column:
    return F.to_json(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` divided by its length (plus a tiny number, so a zero vector stays zero)."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + EPSILON))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
