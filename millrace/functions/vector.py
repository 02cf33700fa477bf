"""Arithmetic on arrays of numbers, within whole rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The scalar product in double precision: null where a vector is null, an error where lengths differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    wrong = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).otherwise(wrong)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is.

    The length is bound to a struct first: within the function of a ``transform`` it would be computed anew for every number, and
    what the vector is computed from with it.
    """
    bound = F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(1e-12)).alias("length")))
    return F.get(F.transform(bound, lambda b: F.transform(b["v"], lambda x: x.cast("double") / b["length"])), F.lit(0))
