"""Problem 7: filling containers of fixed capacity with items that are not split unless they exceed it.

Bound-certified repacking. Items are spread over partitions by hash, and each partition packs its own by best-fit
decreasing. Dual-feasible functions give a lower bound on the bins a partition needs, so one that meets it is certified and
done. Of the partitions with a gap, the items of bins that aren't filled well go into the next round, in fewer partitions, so that they
exchange items; a bin filled to ``full`` of its capacity, and every bin of a certified partition but its emptiest, stays as it is.
The rounds end when one partition holds what is left, or after ``rounds`` of them; a partition has ``items`` items on the average.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import written


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by size, largest first, each in the fullest bin that still holds it. Equal sizes keep their order."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    frees: list[int] = []  # the free spaces that have bins, sorted
    out, bins = np.empty(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        at = bisect_left(frees, size)
        if at == len(frees):
            b, free = bins, capacity
            bins += 1
        else:
            free = frees[at]
            b = room[free].pop()
            if not room[free]:
                frees.pop(at)
        free -= size
        if not room[free]:
            frees.insert(bisect_left(frees, free), free)
        room[free].append(b)
        out[k] = b
    return out


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins: the best of the volume bound and of two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    value, count = np.unique(sizes, return_counts=True)
    best = -(-int((value * count).sum()) // capacity)
    # Thresholds: items over capacity - t count as a whole bin, items under t not at all, the others by size.
    for t in value[value <= capacity // 2]:
        whole = count[value > capacity - t].sum()
        between = (value >= t) & (value <= capacity - t)
        best = max(best, int(whole) - (-int((value[between] * count[between]).sum()) // capacity))
    # Rounding: a size x counts x where (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) / k.
    for k in range(1, 51):
        scaled = (k + 1) * value
        exact = scaled % capacity == 0
        total = int((count * np.where(exact, value * k, scaled // capacity * capacity)).sum())  # in units of 1 / (k * capacity)
        best = max(best, -(-total // (k * capacity)))
    return best


def _pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, n: the items; a text larger than the capacity gives whole pieces of it and a rest."""
    n = F.col("n_tokens")
    whole = F.floor(n / capacity).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1), lambda k: F.struct(k.alias("piece"), F.when(k < whole, F.lit(capacity)).otherwise(n % capacity).cast("int").alias("n")))
    return sized.where("n_tokens > 0").select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.piece", "x.n")


def _packer(capacity: int, full: float, final: bool, level: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = rows["n"].to_numpy(np.int64)
        own = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(own, weights=sizes)
        bound = least_bins(sizes, capacity)
        keep = np.ones(len(filled), bool)
        if not final and len(filled) == bound:
            keep[filled.argmin()] = False
        elif not final:
            keep = filled >= full * capacity
        number = (level << 52) + (int(rows["part"].iloc[0]) << 32) + own
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "n": sizes, "bin": np.where(keep[own], number, -1), "bin_tokens": filled[own].astype(np.int64), "bins": len(filled), "bound": bound})

    return pack


def packed(sized: DataFrame, capacity: int, items: int = 20_000, full: float = 0.995, rounds: int = 4) -> DataFrame:
    """doc_id, piece, n_tokens, bin, bin_tokens, unused: the container of every piece of ``sized`` (doc_id, n_tokens); a written table.

    A text without tokens needs no container and has no row. Texts of at most ``capacity`` tokens have one piece. A bin's number is
    unique, not dense. A doc_id is taken to be one row; repeated ones are packed as often.
    """
    if capacity < 1:
        raise ValueError("a container's capacity must be at least one token")
    left, done, level = written(_pieces(sized, capacity), "pieces"), [], 0
    while True:
        parts = max(1, math.ceil(left.count() / items))
        final = parts == 1 or level == rounds - 1

        pack = _packer(capacity, full, final, level)
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(parts)).cast("int")
        out = left.select("doc_id", "piece", "n", part.alias("part")).groupBy("part").applyInPandas(pack, SCHEMA)
        out = written(out, "packed")
        done.append(out.where("bin >= 0"))
        if final:
            break
        left = out.where("bin < 0").select("doc_id", "piece", "n")
        level += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("doc_id", "piece", F.col("n").alias("n_tokens"), "bin", "bin_tokens", (F.lit(capacity) - F.col("bin_tokens")).alias("unused"))


SCHEMA = "doc_id long, piece int, n long, bin long, bin_tokens long, bins int, bound int"


def packing_report(placed: DataFrame, capacity: int) -> DataFrame:
    """bins, tokens, capacity, unused, fill, least_bins: of one packing; least_bins is the volume bound over all items."""
    bins = placed.groupBy("bin").agg(F.first("bin_tokens").alias("t"))
    out = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    c = F.lit(capacity)
    return out.select("bins", "tokens", c.cast("long").alias("capacity"), (F.col("bins") * c - F.col("tokens")).alias("unused"), (F.col("tokens") / (F.col("bins") * c)).alias("fill"), F.ceil(F.col("tokens") / c).cast("long").alias("least_bins"))
