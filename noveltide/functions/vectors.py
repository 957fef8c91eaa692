"""Vector expressions in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    # the norm is bound to a variable: inside the inner function it would be taken anew for every number
    return F.transform(F.array(norm), lambda n: F.transform(v.cast("array<double>"), lambda x: x / F.when(n == 0, 1.0).otherwise(n)))[0]


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
