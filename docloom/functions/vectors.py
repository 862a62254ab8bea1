"""Vector functions over ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are rounded before ranking so that equal vectors tie whatever order they are summed in.
DISTANCE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` in 0..2; NULL when either vector is zero or missing."""
    norms = l2_norm(a) * l2_norm(b)
    return F.round(1.0 - dot(a, b) / F.nullif(norms, F.lit(0.0)), DISTANCE_DIGITS)


def l2_normalize(vector: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def checked_dim(vector: Column, dim: int) -> Column:
    """The vector itself; the job fails on one of another size."""
    return F.when(
        vector.isNull() | (F.size(vector) == dim), vector
    ).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string")))
    )
