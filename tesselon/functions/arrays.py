"""Column builders over arrays: resizing, framing, binning, vectors. Missing values are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN becomes NULL: what enters from float arrays marks missing values by NaN."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def finite(x: Column | str) -> Column:
    """NULL, NaN and infinities become 0."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def segment(values: Column | str, start: Column | str, end: Column | str) -> Column:
    """The half-open range [start, end)."""
    return F.slice(_c(values), _c(start) + 1, F.greatest(F.lit(0), _c(end) - _c(start)))


def pad(values: Column | str, size: int) -> Column:
    values = _c(values)
    return F.concat(values, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def truncate(values: Column | str, size: int) -> Column:
    """Exactly size elements: the first ones, NULLs behind a shorter array."""
    return F.slice(pad(values, size), 1, size)


def decimate(values: Column | str, size: int, steps: tuple[int, ...] = (32, 16, 8, 4, 2)) -> Column:
    """Exactly size elements at an interval: the largest step that is at most length // size, else 1."""
    values = _c(values)
    ratio, step = F.floor(F.size(values) / size), F.lit(1)
    for k in sorted(steps):
        step = F.when(ratio >= k, k).otherwise(step)
    picked = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(values, (i * step).cast("int")))
    return F.when(F.size(values) >= size, picked).otherwise(pad(values, size))


def frames(values: Column | str, size: int, stride: int) -> Column:
    """Overlapping patches; none if the array is shorter than one."""
    values = _c(values)
    last = F.floor((F.size(values) - size) / stride).cast("int")
    return F.when(F.size(values) >= size, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def frame_mask(patches: Column | str) -> Column:
    """True for patches without NULL."""
    return F.transform(_c(patches), lambda p: F.forall(p, lambda v: v.isNotNull()))


def merge_mask(mask: Column | str, groups: int) -> Column:
    """A coarser mask: AND over groups whose bounds are rounded half to even."""
    mask = _c(mask)
    ratio = F.size(mask) / F.lit(float(groups))
    bound = lambda i: F.rint(i * ratio).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.forall(F.slice(mask, bound(i) + 1, F.greatest(F.lit(0), bound(i + 1) - bound(i))), lambda v: v))


def mean(values: Column | str) -> Column:
    """Mean of the non-NULL elements, NULL if there is none."""
    some = F.filter(_c(values), lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))


def deviation(values: Column | str, floor: float) -> Column:
    """Population deviation of the non-NULL elements; 1 where it is below the floor."""
    values = _c(values)
    m = mean(values)
    d = F.sqrt(mean(F.transform(values, lambda v: (v - m) * (v - m))))
    return F.when(d < floor, 1.0).otherwise(d)


def bin_index(z: Column | str, edges: list[float] | Column) -> Column:
    """Right-sided place among the edges, less one, clamped to the bins."""
    z = _c(z)
    if isinstance(edges, list):  # plain comparisons, which Spark compiles
        below = F.lit(-1)
        for e in edges:
            below = below + F.when(z >= float(e), 1).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), below))
    below = F.size(F.filter(edges, lambda b: b <= z)) - 1
    return F.greatest(F.lit(0), F.least(F.size(edges) - 2, below))


def mixed_radix(digits: list[Column], bins: list[int]) -> Column:
    """One number from digits; the first is the least significant."""
    total, stride = F.lit(0).cast("long"), 1
    for d, b in zip(digits, bins, strict=True):
        total = total + d.cast("long") * stride
        stride *= b
    return total


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def interleave(arrays: list[Column], size: int) -> Column:
    """out[i::k] = array i, cut to size // k; zeros where an array ends."""
    k = len(arrays)
    both = F.array(*arrays)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda p: F.when(F.floor(p / k) < size // k, F.coalesce(F.get(F.get(both, (p % k).cast("int")), F.floor(p / k).cast("int")), F.lit(0.0))).otherwise(0.0),
    )
