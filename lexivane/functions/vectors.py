"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many values a product with a constant vector is written out, and then compiled; beyond, it runs over the array.
UNROLLED = 128


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of both; null where either is."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_constant(v: Column, q: Sequence[float]) -> Column:
    """With a vector known to the plan; null where ``v`` is."""
    if len(q) > UNROLLED or not len(q):
        return dot(v, F.array(*[F.lit(float(x)) for x in q]).cast("array<double>"))
    total = F.lit(0.0)
    for k, x in enumerate(q):
        total = total + F.coalesce(F.get(v, F.lit(k)).cast("double"), F.lit(0.0)) * F.lit(float(x))
    return F.when(v.isNotNull(), total)


def squared_distance(a: Column, b: Column) -> Column:
    """Over the shorter of both."""

    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return F.coalesce(d * d, F.lit(0.0))

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of length one; a vector of length 1e-12 or less is unchanged."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def from_bytes(blob: Column) -> Column:
    """An array of 32-bit floats from their little-endian bytes; what is left of a last incomplete one is dropped."""
    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return read(blob)


def to_bytes(v: Column) -> Column:
    @F.pandas_udf("binary")
    def write(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return write(v)
