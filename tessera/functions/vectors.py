"""Vector expressions over ARRAY<FLOAT>, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = F.nullif(norm(v), F.lit(0.0))
    # An array of one binds the norm, which would be added up again for each component inside the inner lambda.
    return F.when(n.isNotNull(), F.get(F.transform(F.array(n), lambda m: F.transform(_double(v), lambda x: x / m)), 0))


def is_valid(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def sign_bits(v: Column, dim: int) -> Column:
    """Signs packed into BIGINTs, 32 dimensions each (1 where the component is positive)."""
    words = []
    for lo in range(0, dim, 32):
        part = F.slice(v, lo + 1, min(32, dim - lo))
        words.append(F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0).cast("long")))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8(v: Column, low: Column, high: Column) -> Column:
    """Scalar quantisation of [low, high] to -128..127, clipped."""
    scaled = lambda x: F.round((F.least(F.greatest(x.cast("double"), low), high) - low) / (high - low) * 255) - 128
    return F.transform(v, lambda x: scaled(x).cast("byte"))


def two_bit(v: Column, bound: Column) -> Column:
    """2-bit codes 0..3 with cuts at -bound, 0 and bound."""
    return F.transform(v, lambda x: F.when(x < -bound, 0).when(x < 0, 1).when(x < bound, 2).otherwise(3).cast("byte"))


def pair_bits(v: Column, bound: Column) -> Column:
    """1.5-bit codes: each pair of components as 4 * weight + 2 * sign + sign. weight is 1 if both are `bound` or more in size; a last odd
    component counts with 0."""
    n = F.size(v)
    at = lambda i: F.coalesce(F.get(v, i), F.lit(0.0).cast("float"))
    bit = lambda c: F.when(c, 1).otherwise(0)
    code = lambda i: (bit((F.abs(at(i)) >= bound) & (F.abs(at(i + 1)) >= bound)) * 4 + bit(at(i) > 0) * 2 + bit(at(i + 1) > 0)).cast("byte")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), code)).otherwise(F.array().cast("array<byte>"))


def stored_bytes(n: Column, dim: int, encoding: str, link_bytes: int = 100) -> Column:
    """Estimated bytes of n vectors: their encoding and about link_bytes of index per vector."""
    bits = {"float32": 32, "int8": 8, "2bit": 2, "1.5bit": 1.5, "1bit": 1}[encoding]
    return n * (dim * bits / 8 + link_bytes)


def named_vector(vectors: Column) -> Column:
    """From a map of named vectors: 'default', else '', else any."""
    return F.coalesce(F.try_element_at(vectors, F.lit("default")), F.try_element_at(vectors, F.lit("")), F.get(F.map_values(vectors), 0))
