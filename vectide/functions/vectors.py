"""Vector arithmetic as Spark expressions over ``array<double>`` columns; none of it leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(sq_norm(v))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row; within another lambda's body it would be computed for every element."""
    return F.transform(F.array(value), then)[0]


def normalize(v: Column) -> Column:
    """Unit length; a zero vector has null elements."""
    return bound(v, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def lp(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def squared_l2(sq_a: Column, sq_b: Column, product: Column) -> Column:
    """From stored squared norms and a dot product; never negative."""
    return F.greatest(F.lit(0.0), sq_a + sq_b - 2 * product)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of boolean vectors; two vectors without a set bit are at distance 0."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x & y).cast("int")), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: (x | y).cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - F.coalesce(F.try_divide(both, either), F.lit(1.0))


def packed(bits: Column, width: int = 64) -> Column:
    """A boolean vector of ``width`` elements as bigints of up to 32 bits each, for ``bit_count``."""
    words = []
    for lo in range(0, width, 32):
        part = F.transform(F.slice(bits, lo + 1, 32), lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint")))
        words.append(F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.array(*words)


def packed_jaccard_distance(a: Column, b: Column) -> Column:
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - F.coalesce(F.try_divide(both, either), F.lit(1.0))


def hyperplane_distance(v: Column, w: Column, b: Column) -> Column:
    """Signed, not normalised."""
    return dot(v, w) + b


def hardmax(v: Column) -> Column:
    """One-hot of the (first) greatest element."""
    return bound(v, lambda v: bound(F.array_position(v, F.array_max(v)), lambda at: F.transform(v, lambda _, i: (i + 1 == at).cast("int"))))


def masked_softmax(v: Column, mask: Column) -> Column:
    """``e^x m / sum``; all null where nothing is unmasked."""
    e = F.zip_with(v, mask, lambda x, m: F.exp(x) * m)
    return bound(e, lambda e: bound(total(e), lambda s: F.transform(e, lambda x: F.try_divide(x, s))))


def resample(samples: Column, rate: int, to: int) -> Column:
    """Linear interpolation of evenly spaced samples from one rate to another."""

    def whole(s: Column) -> Column:
        n = F.size(s)
        m = F.floor(n * to / F.lit(rate)).cast("int")

        def at(i: Column) -> Column:
            x = i * F.lit(rate / to)
            lo = F.floor(x).cast("int")
            left = F.element_at(s, F.least(lo + 1, n))
            return left + (F.element_at(s, F.least(lo + 2, n)) - left) * (x - lo)

        return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))

    return bound(samples, whole)


def min_samples(dim: Column | int, error: float = 0.01, uncertainty: float = 0.05) -> Column:
    """Rows a group needs so that a sample stands for it."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    spread = F.lit(4.0) / (F.lit(error) * F.log(F.lit(2.0 / uncertainty)))
    return F.ceil(F.greatest(spread, 8.0 * d / (F.lit(error) * F.log(F.lit(13.0 / error))))).cast("bigint")
