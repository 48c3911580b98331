"""Vector arithmetic on array columns, in double precision (V-01..V-04)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what stands inside a lambda is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scale = lambda w, n: F.transform(w, lambda x: x / n)
    return bind(as_double(v), lambda w: bind(F.coalesce(F.nullif(norm(w), F.lit(0.0)), F.lit(1.0)), lambda n: scale(w, n)))


def centered(v: Column, mean: Column) -> Column:
    return normalize(F.zip_with(as_double(v), mean, lambda x, m: x - m))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalize(a), normalize(b))


def mean_of(vectors: Column, dims: int) -> Column:
    """Aggregate: the element-wise mean of an array column."""
    return F.array(*[F.avg(F.get(vectors, F.lit(k)).cast("double")) for k in range(dims)])


def combine_document(head: Column, chunk_mean: Column, head_weight: float = 0.5) -> Column:
    """A document's vector from its head's and the mean of its chunks' (null: no chunks)."""
    both = F.zip_with(as_double(head), normalize(chunk_mean), lambda h, c: h * head_weight + c * (1 - head_weight))
    return F.when(chunk_mean.isNull(), as_double(head)).otherwise(normalize(both))
