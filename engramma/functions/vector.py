"""Dense vectors as arrays: products, norms, cosine, late interaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def certainty(similarity: Column) -> Column:
    return (1 + similarity) / 2


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for every query vector the best product with a document vector, summed."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: dot(q, d))))
