"""Vector arithmetic as Column expressions.

For whole corpora use `repoquarry.operators.search`, which works on blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NaN for a zero vector, NULL for a NULL one."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    known = a.isNotNull() & b.isNotNull()
    return F.when(
        known, F.coalesce(F.lit(1.0) - F.try_divide(dot(a, b), norms), F.lit(float("nan")))
    )


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(
        v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)).cast("float")
    )
