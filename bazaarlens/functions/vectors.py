"""Vector columns (ARRAY<FLOAT>) for the row-wise cases: one vector against many rows, or a joined pair.

All-against-all work goes through `operators.blocks`, which multiplies matrices inside bounded tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector_literal(values) -> Column:
    return F.lit([float(v) for v in values])


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    length = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / length)
