"""Column builders over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(x + F.lit(EPS))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(F.zip_with(logits, F.array_repeat(top, F.size(logits)), lambda x, m: x - m),
                    lambda x: F.exp(x / F.lit(float(temperature))))
    return F.zip_with(e, F.array_repeat(total(e), F.size(e)), lambda x, s: x / s)


def argmax(v: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
