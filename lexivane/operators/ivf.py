"""The inverted-file index: number of clusters, assignment, centroids, training, inverted lists."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.vectors import squared_distance
from lexivane.sampling import least_hashed
from lexivane.session import written


def choose_k(n: int) -> int:
    """Four times the root of the number of vectors, at least 20, at most half of them, but two at the least."""
    return max(2, min(max(20, math.isqrt(16 * n)), n // 2))


def assigned(vectors: DataFrame, centroids: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """key, cluster_id, distance (nine digits): the nearest centroid of each vector, ties to the smaller number. Null vectors, and those that are no numbers, have no row.

    The centroids, of which there are 4 sqrt(rows), reach the tasks as one matrix; no vector is shuffled.
    """
    rows = centroids.where("centroid is not null").orderBy("cluster_id").toPandas()
    numbers = rows["cluster_id"].to_numpy(np.int64)
    matrix = np.stack([np.asarray(c, np.float64) for c in rows["centroid"]]) if len(rows) else np.empty((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((numbers, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, matrix = shared.value
        for batch in batches:
            fits = batch[batch["v"].map(lambda x: x is not None and len(x) == matrix.shape[1])]
            for start in range(0, len(fits), 1000):
                part = fits.iloc[start : start + 1000]
                x = np.stack([np.asarray(v, np.float64) for v in part["v"]])
                rough = (x * x).sum(1)[:, None] - 2 * x @ matrix.T + (matrix * matrix).sum(1)
                # Distances in nine digits, exact for all that the rounding of the product may have mixed up; ties to the smaller number.
                least = rough.min(1, keepdims=True)
                row, near = np.nonzero(rough <= least + 1e-8 * (1 + np.abs(least)))
                exact = np.round(((x[row] - matrix[near]) ** 2).sum(1), 9)
                order = np.lexsort((numbers[near], exact, row))
                met, first = np.unique(row[order], return_index=True)
                best, dist = np.full(len(x), -1), np.full(len(x), np.nan)
                best[met], dist[met] = numbers[near[order[first]]], exact[order[first]]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "cluster_id": best.astype(np.int32), "distance": dist})

    if not len(rows):
        return vectors.sparkSession.createDataFrame([], f"{key} long, cluster_id int, distance double")
    out = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where("v is not null").mapInPandas(run, "key long, cluster_id int, distance double")
    return out.where("cluster_id >= 0").withColumnRenamed("key", key)


def assigned_by_join(vectors: DataFrame, centroids: DataFrame, key: str = "id", vector: str = "embedding", most: int = 1000) -> DataFrame:
    """The same as a plan of built-in operators alone; for a few centroids. Of more than ``most`` it is ``assigned`` that is run."""
    if centroids.limit(most + 1).count() > most:
        return assigned(vectors, centroids, key, vector)
    pairs = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(centroids))  # counted above
    d = pairs.select(key, "cluster_id", F.round(squared_distance(F.col("v"), F.col("centroid")), 9).alias("distance"))
    return d.groupBy(key).agg(F.min(F.struct("distance", "cluster_id")).alias("m")).select(key, "m.cluster_id", "m.distance")


def means(vectors: DataFrame, assignment: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """cluster_id, centroid, n: the mean of each cluster's vectors. Sums are made in each partition before anything is shuffled."""
    joined = vectors.where(F.col(vector).isNotNull()).select(key, vector).join(assignment.select(key, "cluster_id"), key)
    each = joined.select("cluster_id", F.posexplode(vector).alias("pos", "x"))
    mean = each.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    out = mean.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("n").alias("n"))
    return out.select("cluster_id", F.col("c.x").alias("centroid"), "n")


def changed(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """changed: how many vectors have another cluster than before, or had none."""
    both = new.select(key, F.col("cluster_id").alias("b")).join(old.select(key, F.col("cluster_id").alias("a")), key, "left")
    return both.agg(F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")), F.lit(0)).alias("changed"))


def inverted_lists(assignment: DataFrame, key: str = "id") -> DataFrame:
    """cluster_id, ids: the ids of each cluster in order."""
    return assignment.groupBy("cluster_id").agg(F.sort_array(F.collect_list(key)).alias("ids"))


def _first_centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centroid is a row, drawn by its squared distance from those chosen; rows that repeat a centroid only when no others are left."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = d.sum()
        chosen.append(int(np.searchsorted(np.cumsum(d), rng.random() * total)) if total > 0 else int(rng.integers(len(x))))
        chosen[-1] = min(chosen[-1], len(x) - 1)
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _round(vectors: DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the vectors nearest to each centroid; each partition sends one row for each of its clusters."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    k, dim = matrix.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        half = (c * c).sum(1) / 2
        sums, n = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                x = np.stack(batch["v"].iloc[start : start + 1000].to_list()).astype(np.float64)
                near = (half - x @ c.T).argmin(1)
                order = np.argsort(near, kind="stable")
                met, first, count = np.unique(near[order], return_index=True, return_counts=True)
                sums[met] += np.add.reduceat(x[order], first)
                n[met] += count
        met = np.flatnonzero(n)
        yield pd.DataFrame({"c": met, "n": n[met], "s": [r.tobytes() for r in sums[met]]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, list] = {}
        for batch in batches:
            for c, n, s in zip(batch["c"], batch["n"], batch["s"], strict=True):
                own = got.setdefault(c, [0, np.zeros(dim)])
                own[0] += n
                own[1] += np.frombuffer(s)
        yield pd.DataFrame({"c": list(got), "n": [n for n, _ in got.values()], "s": [s.tobytes() for _, s in got.values()]})

    schema = "c long, n long, s binary"
    rows = vectors.mapInPandas(run, schema).repartition("c").sortWithinPartitions("c").mapInPandas(add, schema).toPandas()
    sums, n = np.zeros((k, dim)), np.zeros(k, np.int64)
    if len(rows):
        sums[rows["c"]], n[rows["c"]] = np.frombuffer(b"".join(rows["s"])).reshape(-1, dim), rows["n"]
    return sums, n


def trained(vectors: DataFrame, key: str = "id", vector: str = "embedding", k: int | None = None, rounds: int = 50, seed: int = 42, sample_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """centroids (cluster_id, centroid) and assignment (key, cluster_id, distance), both written tables; every vector has the nearest centroid.

    Initial centroids by k-means++ on at most ``sample_rows`` rows (or four for each centroid, if that is more), then rounds of assignment and means over all rows
    until the centroids stay. A cluster without rows takes the next one's centroid, moved a little. Null vectors, vectors that are no numbers, and
    those of another length than the longest take no part. The driver holds the centroids, of which there are 4 sqrt(rows).
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).alias("v"))
    dim = usable.agg(F.max(F.size("v"))).first()[0] or 0
    sound = written(usable.where((F.size("v") == dim) & F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))), "vectors")
    n = sound.count()
    if not n or not dim:
        return spark.createDataFrame([], "cluster_id int, centroid array<double>"), spark.createDataFrame([], f"{key} long, cluster_id int, distance double")
    k = min(k or choose_k(n), n)
    some = least_hashed(sound, key, max(sample_rows, 4 * k), seed).select("v").toPandas()
    c = _first_centroids(np.stack(some["v"].to_list()).astype(np.float64), k, seed)
    noise = np.random.default_rng(seed)
    for _ in range(rounds):
        sums, count = _round(sound, c)
        new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], np.roll(c, -1, 0) + noise.uniform(-0.005, 0.005, c.shape))
        moved = np.abs(new - c)[count > 0].max()
        c = new
        if moved < 1e-9:
            break
    centroids = written(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(c)], "cluster_id int, centroid array<double>"), "centroids")
    return centroids, written(assigned(sound, centroids, key, "v"), "assignment")


def to_file(centroids: list[list[float]], assignments: list[int]) -> bytes:
    """The index as bytes: dimension, clusters, vectors, centroids as 32-bit floats, number and cluster of each vector."""
    k, dim = len(centroids), len(centroids[0]) if centroids else 0
    flat = np.asarray(centroids, "<f4").tobytes()
    return struct.pack("<iii", dim, k, len(assignments)) + flat + struct.pack("<i", len(assignments)) + np.asarray(assignments, "<i4").tobytes()


def from_file(data: bytes) -> tuple[list[list[float]], list[int], dict[int, list[int]]]:
    """Centroids, assignments and inverted lists; assignments out of range are in no list. ValueError for a file that ends early."""
    if len(data) < 12:
        raise ValueError("the index file ends within its head")
    dim, k, _ = struct.unpack_from("<iii", data)
    at = 12 + 4 * dim * k
    if dim < 0 or k < 0 or len(data) < at + 4:
        raise ValueError("the index file ends within its centroids")
    (n,) = struct.unpack_from("<i", data, at)
    if n < 0 or len(data) < at + 4 + 4 * n:
        raise ValueError("the index file ends within its assignments")
    centroids = np.frombuffer(data, "<f4", dim * k, 12).reshape(k, dim).tolist()
    assignments = np.frombuffer(data, "<i4", n, at + 4).tolist()
    lists: dict[int, list[int]] = {c: [] for c in range(k)}
    for i, c in enumerate(assignments):
        if 0 <= c < k:
            lists[c].append(i)
    return centroids, assignments, lists
