"""Column builders over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    """The sum of an array."""
    return F.aggregate(F.transform(_c(x), lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y))


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column | str, eps: float = 1e-12) -> Column:
    """The vector at length 1; one shorter than eps is divided by eps, so a vector of zeros stays."""
    length = F.greatest(norm(x), F.lit(eps))
    return F.transform(_c(x), lambda v: v.cast("double") / length)


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def divide(a: Column | str, b: Column | str, eps: float = 1e-6) -> Column:
    """a over b, b no less than eps."""
    return _c(a) / F.greatest(_c(b), F.lit(eps))


def softmax(x: Column | str, temperature: float = 1.0) -> Column:
    """Shares by exp of the numbers over temperature, the largest taken off first."""
    powers = F.transform(_c(x), lambda v: F.exp((v.cast("double") - F.array_max(_c(x))) / temperature))
    return F.transform(powers, lambda v: v / total(powers))


def entropy(p: Column | str, eps: float = 1e-5) -> Column:
    """-sum p ln p, with p in the logarithm no less than eps."""
    return -total(F.transform(_c(p), lambda v: v * F.ln(F.greatest(v, F.lit(eps)))))
