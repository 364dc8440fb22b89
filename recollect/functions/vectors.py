"""Vector arithmetic as column expressions: double precision, summed from left to right, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product (VEC15)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a norm is 0 or the lengths differ (VEC14)."""
    lengths = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), 0.0).when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def normalised(a: Column) -> Column:
    """The vector over its norm, which counts as 1e-12 at least (VEC15)."""
    by = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / by)


def sign_code(a: Column) -> Column:
    """One bit for each of up to 64 dimensions, set where the value is positive (VEC8)."""
    bits = F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def to_uint8(a: Column) -> Column:
    """Affine 8-bit codes of values from -1 to 1 (VEC10)."""
    return F.transform(a, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


def from_uint8(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.lit(127.5) - 1.0)


def similarity_from_cosine_distance(d: Column) -> Column:
    """VEC13."""
    return F.lit(1.0) - d


def similarity_from_squared_l2(d: Column) -> Column:
    """Of unit vectors (VEC13)."""
    return F.lit(1.0) - d / 2
