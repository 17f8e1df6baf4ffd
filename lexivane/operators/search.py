"""Nearest documents by dot product: exact, or pruned to the nearest clusters; late fetch of the winners' texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.vectors import dot_constant


def scored(docs: DataFrame, query: Sequence[float], vector: str = "embedding", key: str = "id", missing: float | None = 0.0) -> DataFrame:
    """key, similarity (six decimals). A null vector scores ``missing``, or is dropped if that is None; scores that are no number are dropped."""
    s = F.round(dot_constant(F.col(vector), query), 6)
    rows = docs if missing is not None else docs.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    s = F.coalesce(s, F.lit(missing)) if missing is not None else s
    return rows.select(F.col(key), s.alias("similarity")).where(~F.isnan("similarity"))


def top(scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best, ties to the smaller key; all of them, in order, for a negative k."""
    ranked = scores.orderBy(F.desc("similarity"), key)
    return ranked if k < 0 else ranked.limit(k)


def fetched(best: DataFrame, docs: DataFrame, key: str = "id", columns: Sequence[str] = ("title", "url", "content")) -> DataFrame:
    """The winners with their texts, in order. The ids of a bounded top-k are small, so that the texts of others are not shuffled."""
    return best.join(docs.select(key, *columns), key).orderBy(F.desc("similarity"), key)


def probed(query: Sequence[float], centroids: DataFrame, n: int) -> list[int]:
    """The n clusters with the nearest centroids by squared distance, ties to the smaller number; the driver holds all centroids, of which there are 4 sqrt(rows)."""
    rows = [(r["cluster_id"], np.asarray(r["centroid"], np.float64)) for r in centroids.where("centroid is not null").collect()]
    q = np.asarray(query, np.float64)

    def distance(c: np.ndarray) -> float:
        m = min(len(c), len(q))
        return float(((c[:m] - q[:m]) ** 2).sum())

    return [k for _, k in sorted((distance(c), k) for k, c in rows)[:n]]


def search(docs: DataFrame, query: Sequence[float], k: int, centroids: DataFrame | None = None, probes: int = 5) -> DataFrame:
    """id, similarity of the nearest documents; with centroids, only of the clusters nearest to the query."""
    if centroids is not None:
        near = probed(query, centroids, probes)
        if near:
            docs = docs.where(F.col("cluster_id").isin(near))
    return top(scored(docs, query), k)


def as_json(results: DataFrame) -> DataFrame:
    """One row: the results as a JSON array in their order, keys in alphabetical order."""
    rows = results.select((-F.col("similarity")).alias("r"), "id", F.struct("content", F.col("id").alias("docId"), "similarity", "title", "url").alias("x"))
    ordered = rows.agg(F.sort_array(F.collect_list(F.struct("r", "id", "x"))).alias("a"))
    return ordered.select(F.to_json(F.transform("a", lambda e: e["x"])).alias("json"))
