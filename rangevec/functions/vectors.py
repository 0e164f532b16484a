"""Column builders over vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(x) -> Column:
    """A vector column as doubles."""
    return _col(x).cast("array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def inner_product(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm_sq(a) -> Column:
    return _sum(F.transform(_col(a), lambda x: x * x))


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance, summed from differences: exact at zero, never negative."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(l2_sq(a, b))


def half_norm_score(q, x) -> Column:
    """Larger is nearer: ranks rows as the distance to ``q`` does."""
    return inner_product(q, x) - norm_sq(x) / 2


def normalize(a) -> Column:
    """The vector divided by its length; 1e-12 keeps a zero vector finite."""
    length = F.sqrt(norm_sq(a)) + F.lit(1e-12)
    return F.transform(_col(a), lambda x: x / length)


def alignment(here, there, q) -> Column:
    """Positive if the step from ``here`` to ``there`` heads towards ``q``."""
    step = F.zip_with(_col(there), _col(here), lambda x, y: x - y)
    return inner_product(step, F.zip_with(_col(q), _col(here), lambda x, y: x - y))


def attribute_term(scalar, centre, scale, weight) -> Column:
    gap = (_col(scalar) - _col(centre)) / _col(scale)
    return F.lit(weight) * gap * gap


def span_term(scalar, low, high, scale, weight) -> Column:
    """Penalty for how far the row would widen a list's scalar span."""
    wider = (F.greatest(_col(high), _col(scalar)) - F.least(_col(low), _col(scalar))) / _col(scale)
    return F.lit(weight) * wider * wider


def scale_of(deviation) -> Column:
    """A standard deviation, or one where it is next to nothing."""
    return F.when(_col(deviation) < 1e-6, 1.0).otherwise(_col(deviation))


def in_range(scalar, low, high) -> Column:
    """Inclusive at both ends; a null bound is open; a null scalar lies in no range but the open one."""
    s, lo, hi = _col(scalar), _col(low), _col(high)
    return F.coalesce((lo.isNull() | (s >= lo)) & (hi.isNull() | (s <= hi)), F.lit(False))


def bin_of(scalar, low, high, bins: int = 32) -> Column:
    """Equal-width bin from 0, ends clamped; 0 where the domain has no width."""
    s, lo, hi = _col(scalar), _col(low), _col(high)
    at = F.floor((s - lo) * bins / (hi - lo))
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))).otherwise(0).cast("int")


def checked(a, dims: int) -> Column:
    """The vector, or an error if it hasn't ``dims`` values."""
    v = _col(a)
    return F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.lit(f"a vector hasn't {dims} values")))
