"""Statistics of response times: mean, percentiles by position, maximum, rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latency_stats(times: DataFrame, value: str, seconds: float | Column, *by: str) -> DataFrame:
    """n, mean, p50, p90, p99, max and per_second of each group; a percentile is the value at position floor(n p) from 0, so nothing is interpolated.

    Values are first counted, so that a group is held as its different values; nulls and values that are no number are left out.
    """
    v = F.col(value).cast("double")
    counts = times.select(*by, v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, "v").agg(F.count("*").alias("n"))
    points = F.sort_array(F.collect_list(F.struct("v", "n")))
    # Percentiles of frequency-weighted values: each is the first value whose running count exceeds floor(n p).
    rows = counts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"), points.alias("points"))

    def at(p: float) -> Column:
        place = F.floor(F.col("n") * F.lit(p))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("x"))

        def step(s: Column, e: Column) -> Column:
            hit = s["x"].isNull() & (s["seen"] + e["n"] > place)
            return F.struct((s["seen"] + e["n"]).alias("seen"), F.when(hit, e["v"]).otherwise(s["x"]).alias("x"))

        return F.aggregate("points", start, step, lambda s: s["x"])

    return rows.select(*by, "n", "mean", at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), "max", (F.col("n") / seconds).alias("per_second"))
