"""Bounded samples that any run repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """The ``most`` rows of least hash of ``key``, ties to the smaller key.

    Of many rows, only those under a hash that about twice as many fall below are ordered, so that neither a task nor the driver receives
    ``most`` rows from each partition. Should too few fall below it, all are ordered.
    """
    order = F.xxhash64(key, F.lit(seed))
    n = rows.count()
    if n > 4 * most:
        share = 2.0 * most / n + 200.0 / n
        below = rows.where(order < F.lit(int(-(1 << 63) + share * (1 << 64))))
        if below.count() >= most:
            rows = below
    return rows.withColumn("_order", order).orderBy("_order", key).limit(most).drop("_order")
