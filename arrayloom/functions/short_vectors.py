"""Short vectors: fixed-length arrays of numbers, element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lift(f):
    """A binary function of columns on two vectors, or a vector and a scalar."""

    def of(a: Column, b) -> Column:
        if isinstance(b, (int, float)):
            return F.transform(a, lambda x: f(x, F.lit(b)))
        return F.zip_with(a, b, f)

    return of


add, sub, mul, div = (lift(f) for f in (lambda x, y: x + y, lambda x, y: x - y, lambda x, y: x * y, lambda x, y: x / y))


def scale(v: Column, s: Column) -> Column:
    return F.transform(v, lambda x: x * s)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def normalize(v: Column) -> Column:
    """v over its length; the zero vector stays as it is."""
    n = length(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cross(a: Column, b: Column) -> Column:
    def d(i: int, j: int) -> Column:
        return a[i] * b[j] - a[j] * b[i]

    return F.array(d(1, 2), d(2, 0), d(0, 1))


def all_of(v: Column) -> Column:
    """Is the sign bit of every component set?"""
    return F.forall(v, lambda x: x < 0)


def any_of(v: Column) -> Column:
    return F.exists(v, lambda x: x < 0)


def shuffle(v: Column, mask: Column) -> Column:
    return F.transform(mask, lambda i: F.element_at(v, (i % F.size(v) + 1).cast("int")))


def shuffle2(a: Column, b: Column, mask: Column) -> Column:
    return shuffle(F.concat(a, b), mask)


def convert(v: Column, to: str) -> Column:
    return v.cast(f"array<{to}>")


#: fast_* differ in precision only where they come from; here they are the same.
FUNCTIONS = {
    "all": all_of, "any": any_of, "cross": cross, "distance": distance, "dot": dot, "fast_distance": distance, "fast_length": length,
    "fast_normalize": normalize, "length": length, "normalize": normalize, "shuffle": shuffle, "shuffle2": shuffle2,
}
