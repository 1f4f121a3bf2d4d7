"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def usable(v, dim: int) -> Column:
    """Not null, `dim` numbers, none of them null or NaN."""
    return F.coalesce((F.size(_c(v)) == dim) & ~F.exists(_c(v), lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1 if a vector is zero."""
    return 1.0 - F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def l2_to_cosine(d2) -> Column:
    """The cosine of unit vectors at a squared distance."""
    return 1.0 - _c(d2) / 2.0


def rounded(v, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x.cast("double"), digits))
