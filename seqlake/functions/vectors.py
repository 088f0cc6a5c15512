"""Vector distances as higher-order-function expressions (V5, V6, V8).

Elements are widened to double before arithmetic so float32 TNF vectors are
compared in double precision.  Evaluated executor-side, inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a, b) -> Column:
    """1 - a.b/(|a||b|); 1.0 when either norm is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / (na * nb))


def euclidean_distance(a, b) -> Column:
    diff2 = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) *
                       (x.cast("double") - y.cast("double")))
    return F.sqrt(_sum(diff2))


def valid_vector(v, dim: int = 136) -> Column:
    """True when the vector has exactly ``dim`` entries."""
    return F.coalesce(F.size(_c(v)) == dim, F.lit(False))
