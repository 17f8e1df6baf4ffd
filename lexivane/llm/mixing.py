"""Problem 8: mixing sources to target weights, by Poisson replication.

Each record's number of uses is drawn from a Poisson distribution by inverting it at a uniform number hashed from the record's id and a seed, so that every
run, and every retry of a lost task, draws the same. Uses beyond the source's cap are cut.

Total: shares are of the sources that have records. A source whose target is beyond its cap uses every record as often as it may, and the others' shares rise by what it
lacks. Without a given total, the largest is taken at which they rise by no more than ``tolerance`` of themselves.

Mean: sizes are uneven, so the mean number of uses that the target asks for may miss it by far. The uniform numbers are fixed by the hash; so the tokens that any mean
brings are known from the sizes summed over steps of the uniform number, and of ``SEEDS`` hashes and all means those are taken that come nearest to the target.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_table(mean: float, cap: int) -> list[float]:
    """The chances of at most 0, 1, ... cap - 1 uses; whatever is beyond uses the record cap times."""
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (k + 1)
    return out


#: Steps of the uniform number over all listed sources together, and at most for each.
GRID, FINEST, SEEDS = 1 << 20, 1 << 14, 8


def drawn_tokens(mean: float, cap: int, tokens: np.ndarray) -> tuple[int, list[float]]:
    """The tokens that a mean brings, ``tokens`` being those of the records in each step of the uniform number; and the chances, raised to whole steps."""
    steps = [min(math.ceil(c * len(tokens)), len(tokens)) for c in poisson_table(mean, cap)]
    above = np.append(np.cumsum(tokens[::-1])[::-1], 0)
    return int(sum(above[k] for k in steps)), [k / len(tokens) for k in steps]


def chances_for(goal: float, cap: int, tokens: np.ndarray) -> tuple[int, list[float]]:
    """The tokens, and the chances of at most 0, 1, ... cap - 1 uses of the Poisson mean that brings the number of tokens nearest to ``goal``; of none at all if it brings the cap."""
    if goal >= cap * int(tokens.sum()):
        return cap * int(tokens.sum()), [0.0] * cap
    low, high = 0.0, 1.0
    while high < 1e6 and drawn_tokens(high, cap, tokens)[0] < goal:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn_tokens(mid, cap, tokens)[0] < goal else (low, mid)
    return min((drawn_tokens(m, cap, tokens) for m in (low, high)), key=lambda x: abs(x[0] - goal))


def largest_total(sources: list[tuple[float, int]], tolerance: float) -> float:
    """Of (share, most tokens), the shares adding up to 1: the largest total of which the sources together bring all but ``tolerance`` / (1 + ``tolerance``)."""
    low, high = 0.0, max((most / share for share, most in sources), default=0.0) * (1 + tolerance)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(share * mid, most) for share, most in sources) * (1 + tolerance) >= mid else (low, mid)
    return low


def plan(tokens: dict[str, np.ndarray], goals: list[tuple[str, float, int]], total: float | None = None, tolerance: float = 0.05) -> dict[str, tuple[int, list[float]]]:
    """source -> hash and chances, of (source, share, cap) and the tokens by hash and step of the uniform number of the sources that have any."""
    held = [(s, share, cap) for s, share, cap in goals if s in tokens and int(tokens[s][0].sum()) > 0]
    whole = sum(share for _, share, _ in held)
    if total is None:
        # What absent sources lack raises the others too; a fifth of the tolerance is left for the caps in any case.
        tolerance = max(tolerance / 5, (1 + tolerance) * whole / sum(share for _, share, _ in goals) - 1)
        total = largest_total([(share / whole, cap * int(tokens[s][0].sum())) for s, share, cap in held], tolerance)
    out = {}
    for s, share, cap in held:
        goal = share / whole * total
        drawn = [chances_for(goal, cap, t) for t in tokens[s]]
        best = min(range(len(drawn)), key=lambda k: (abs(drawn[k][0] - goal), k))
        out[s] = (best, drawn[best][1])
    return out


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) hashed from the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def record_uses(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None, tolerance: float = 0.05) -> DataFrame:
    """doc_id, source, n_tokens, uses: of every record of ``sized`` (doc_id, source, n_tokens) in a listed source.

    Sources that are not listed, or whose share or cap is null, zero or negative, take no part; nor do records without tokens. A null source is
    never listed. If a source is listed several times, its shares are added and its largest cap holds. The driver holds ``GRID`` sums at most, or one for each listed source if there are more.
    A source of a few records meets its target only as nearly as their sizes allow.
    """
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("s"), F.max("max_repeats").alias("c"))
    goals = sorted(tuple(r) for r in goals.collect())
    if not goals:
        return sized.where(F.lit(False)).select("doc_id", "source", "n_tokens", F.lit(0).alias("uses"))
    listed = sized.where(F.col("source").isin([g[0] for g in goals]) & (F.col("n_tokens") > 0))
    steps = max(1, min(FINEST, 1 << (GRID // SEEDS // len(goals)).bit_length() - 1)) if SEEDS * len(goals) <= GRID else 1
    us = [uniform(seed + k, "doc_id") for k in range(SEEDS)]
    each = listed.select("source", "n_tokens", F.posexplode(F.array(*us)).alias("hash", "u"))
    sums = each.groupBy("source", "hash", F.floor(F.col("u") * steps).cast("int").alias("k")).agg(F.sum("n_tokens").alias("n"))
    tokens: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        tokens.setdefault(r["source"], np.zeros((SEEDS, steps), np.int64))[r["hash"], r["k"]] = r["n"]
    chances = plan(tokens, goals, total, tolerance)
    uses = F.lit(0)
    for source, (k, limits) in sorted(chances.items()):
        drawn = sum(((us[k] >= F.lit(c)).cast("int") for c in limits), F.lit(0))
        uses = F.when(F.col("source") == source, drawn).otherwise(uses)
    return listed.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses"))


def mixture(uses: DataFrame, seed: int = 17, shards: int | None = None, shard_rows: int = 100_000) -> DataFrame:
    """doc_id, copy, source, n_tokens, shard, position: each use of each record, in a global shuffle.

    position is a hash of the use: records in the order of position are in random order, and those of one shard are a random share of all.
    The rows are spread over the shards by hash, so none waits for another; there is one for each ``shard_rows`` uses.
    """
    if shards is None:
        shards = max(1, math.ceil((uses.agg(F.sum("uses")).first()[0] or 0) / shard_rows))
    each = uses.where("uses > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "uses")).alias("copy"), "source", "n_tokens")
    position = F.xxhash64(F.lit(seed + 1), "doc_id", "copy")
    shuffled = each.withColumn("position", position).withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
    return shuffled.repartition(shards, "shard").sortWithinPartitions("shard", "position").select("doc_id", "copy", "source", "n_tokens", "shard", "position")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, records, used_records, tokens, actual_share, most_uses: one row for each row of ``targets``."""
    targets = targets.select("source", "target_share", "max_repeats")
    done = uses.groupBy("source").agg(F.count("*").alias("records"), F.sum((F.col("uses") > 0).cast("long")).alias("used_records"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    total = done.agg(F.sum("tokens").alias("total"))
    out = targets.join(done, "source", "left").join(F.broadcast(total))  # one row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "used_records", "tokens")]
    return out.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
