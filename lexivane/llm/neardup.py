"""Problem 1: near-duplicate records with small edits, by covering locality-sensitive hashing.

Two texts are alike if the adjacent word pairs they share (counted as often as they occur, the lesser
count of the two) are at least ``similarity`` of those of the longer one.

Steps, each over all rows; the texts are read once, but for those of the last step:

1. Texts with the same words in the same order form one class; its smallest id stands for it.
2. The word pairs, those of one kind numbered, are sketched by min-hashes, seen as words over a large alphabet. No pair is left out, however many
   texts it occurs in: a story stored in a third of the rows is alike by such pairs alone. Texts that agree in one of ``LEADS`` first symbols form a group.
3. Covering: within a group of up to ``hot`` texts each meets each. In a larger one the other symbols are seen in blocks of six, put together anew for each first symbol; a block has the masks of the
   Hadamard code that keep three positions. Six positions of which at most three differ agree under one of them, so two texts of the group meet if they agree in
   at least 2 * ``blocks`` + 1 of the 6 * ``blocks`` symbols, and mostly with fewer. Unlike the number of texts in a group, that of those that agree in three more symbols by chance stays small.
   A group too large for one task is split into parts, and each two parts meet in a task of their own.
4. Texts in common prose share symbols without being alike. Of those that meet, only pairs whose sizes allow it, and whose bits of majority
   (``NEAR`` longs within the group, ``SIGNS`` in all) differ in no more places than ``deviations`` above what is expected at the least similarity, go on.
5. What is left is compared word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.components import components
from lexivane.llm.words import WordHash, minhashes, numbered, shingles, sign_bits, words
from lexivane.session import written

#: The masks of one block of six positions.
MASKS = tuple(combinations(range(6), 3))
#: Min-hashes by which groups are made.
LEADS = 16
#: Longs of bits of majority that stand beside each row of a group, and in all.
NEAR, SIGNS = 8, 16
#: Rows of groups that are searched together.
CHUNK = 50_000


def pair_counts(title: str | None, content: str | None) -> Counter:
    found = words(f"{title or ''}\n{content or ''}")
    return Counter(zip(found, found[1:], strict=False))


def overlap(a: Counter, b: Counter) -> float:
    longer = max(a.total(), b.total())
    if longer == 0:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(min(n, b[k]) for k, n in a.items() if k in b) / longer


def _sketches(docs: DataFrame, least_words: int, size: int) -> DataFrame:
    """id, sig, n (word pairs), lead (``LEADS`` 32-bit min-hashes), body, signs (``SIGNS`` longs): of the rows that are long enough.

    body has the bytes of ``NEAR`` of the signs, and of the low 16 bits of ``size`` more min-hashes.
    Rows of the same words in the same order have the same 128-bit sig.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for batch in batches:
            for start in range(0, len(batch), 250):
                part = batch.iloc[start : start + 250]
                ids, rows = [], []
                for id_, title, content in zip(part["id"], part["title"], part["content"], strict=True):
                    body = words(content)
                    if len(body) >= least_words:
                        ids.append(id_)
                        rows.append(hashes.of(words(title) + body))
                if not rows:
                    continue
                features = [numbered(shingles(r, 2)) if len(r) > 1 else r[:1] for r in rows]
                starts = np.cumsum([0] + [len(f) for f in features[:-1]])
                flat = np.concatenate(features)
                sigs = [xxhash.xxh3_128_digest(r.tobytes()) for r in rows]
                sketch, signs = minhashes(flat, starts, LEADS + size), sign_bits(flat, starts, SIGNS)
                body = np.hstack([np.ascontiguousarray(signs[:, :NEAR]).view(np.uint8), sketch[:, LEADS:].astype(np.uint16).view(np.uint8)])
                yield pd.DataFrame({"id": np.array(ids, np.int64), "sig": sigs, "n": [max(len(r) - 1, 0) for r in rows], "lead": list(sketch[:, :LEADS].view(np.int32)), "body": [b.tobytes() for b in body], "signs": list(signs)})

    return docs.select("id", "title", "content").where(F.col("id").isNotNull()).mapInPandas(run, "id long, sig binary, n int, lead array<int>, body binary, signs array<long>")


def _grouped(sketches: DataFrame, part: int) -> DataFrame:
    """id, n, body, lead, side, unit: each row once for each of its first symbols; rows of one unit meet.

    A group of about ``part`` rows or more is split; a row is then once in each unit of its part with another or itself. side is 2 where all rows of the unit meet,
    else 0 for those of one part and 1 for those of the other. Sizes are estimated from a sample of the ids; they decide how a group is split, not what meets.
    """
    rows = sketches.select("id", "n", "body", F.posexplode("lead").alias("lead", "symbol")).withColumn("key", F.xxhash64("lead", "symbol")).drop("symbol")
    seen = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(8)) == 0).groupBy("key").agg((F.count("*") * 8).alias("size"))
    parts = written(seen.where(F.col("size") > part).select("key", F.ceil(F.col("size") / part).alias("parts")), "hot")
    every = rows.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = every.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    unit = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return every.select("id", "n", "body", F.col("lead").cast("byte").alias("lead"), side.cast("byte").alias("side"), unit.alias("unit"))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows whose key others have too, those of one key side by side and the largest runs first; the size of each one's run, and its place there."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    several = sizes > 1
    first, sizes = first[several], sizes[several]
    large = np.argsort(-sizes, kind="stable")
    first, sizes = first[large], sizes[large]
    size = np.repeat(sizes, sizes)
    at = np.arange(len(size)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[np.repeat(first, sizes) + at], size, at


def _near_pairs(keys: np.ndarray, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of one key whose ``bits`` (longs, rows) differ in at most ``most`` places."""
    rows, size, at = _runs(keys)
    bits, down = bits[:, rows], -size
    for d in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(down, -d))  # rows of runs that are longer than d
        differ = np.zeros(live - d, np.uint16)
        for b in bits:
            differ += np.bitwise_count(b[: live - d] ^ b[d:live])
        near = np.flatnonzero((differ <= most) & (at[: live - d] + d < size[: live - d]))
        if len(near):
            yield rows[near], rows[near + d]


def _meeting(unit: np.ndarray, lead: np.ndarray, sketch: np.ndarray, bits: np.ndarray, most: int, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs within whole units: of each two rows, or in units of more than ``hot`` rows of those that agree under a mask. There pairs are repeated.

    Where most rows are so alike that the masks would bring together half of all pairs or more, each two rows of a large unit meet too.
    """
    number, counts = np.unique(unit, return_inverse=True, return_counts=True)[1:]
    few = np.flatnonzero(counts[number] <= hot)
    for a, b in _near_pairs(number[few], bits[:, few], most):
        yield few[a], few[b]
    for u in np.flatnonzero(counts > hot):
        rows = np.flatnonzero(number == u)
        own = bits[:, rows]
        # Blocks of its own for each first symbol.
        places = np.random.default_rng(int(lead[rows[0]])).permutation(sketch.shape[1])
        blocks = [sketch[rows][:, places[k : k + 6]].astype(np.uint64) for k in range(0, len(places), 6)]
        keys = lambda block, mask: block[:, mask[0]] << np.uint64(32) | block[:, mask[1]] << np.uint64(16) | block[:, mask[2]]
        met = sum(int((n * (n - 1) // 2).sum()) for n in (np.unique(keys(b, MASKS[0]), return_counts=True)[1] for b in blocks))
        every = len(MASKS) * met >= len(rows) * (len(rows) - 1) // 4
        for key in [np.zeros(len(rows), np.uint64)] if every else (keys(b, m) for b in blocks for m in MASKS):
            for a, b in _near_pairs(key, own, most):
                yield rows[a], rows[b]


def _candidates(groups: DataFrame, similarity: float, size: int, hot: int, most: int) -> DataFrame:
    """id_a, id_b (id_a < id_b): the rows that meet in a group, whose sizes allow that they are alike and whose bits of majority are near; pairs may be repeated."""
    wide = 8 * NEAR + 2 * size

    def distinct(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found).view("i8,i8").ravel()).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["id_a", "id_b"])

    def pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, n, lead, side, unit, body = (np.concatenate(x) for x in zip(*held, strict=True))
        bits = np.ascontiguousarray(np.ascontiguousarray(body[:, : 8 * NEAR]).view(np.uint64).T)
        sketch = np.ascontiguousarray(body[:, 8 * NEAR :]).view(np.uint16)
        found, rows = [], 0
        for a, b in _meeting(unit, lead, sketch, bits, most, hot):
            # No more word pairs than the shorter text has can be shared.
            good = (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])) & ((side[a] == 2) | (side[a] != side[b]))
            a, b = ids[a[good]], ids[b[good]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            rows += len(a)
            if rows > 1_000_000:
                yield distinct(found)
                found, rows = [], 0
        if rows:
            yield distinct(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            body = batch.column("body")
            start = np.frombuffer(body.buffers()[1], np.int32)[body.offset]
            body = np.frombuffer(body.buffers()[2], np.uint8)[start : start + wide * len(body)].reshape(-1, wide)
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "lead", "side", "unit")] + [body]
            # The last unit may go on in the next batch.
            cut = int(np.flatnonzero(now[4] != now[4][-1])[-1]) + 1 if now[4][0] != now[4][-1] else 0
            if cut or held and held[-1][4][-1] != now[4][0]:
                if cut:
                    held.append(tuple(x[:cut] for x in now))
                if rows + cut >= CHUNK:
                    yield from pairs(held)
                    held, rows = [], -cut
            held.append(tuple(x[cut:] for x in now))
            rows += len(body)
        if held:
            yield from pairs(held)

    return groups.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "id_a long, id_b long")


def _most(similarity: float, longs: int, deviations: float) -> int:
    """In how many of the bits of majority a pair of the least similarity differs, ``deviations`` above the average."""
    n, p = 64 * longs, math.acos(similarity) / math.pi
    return int(n * p + deviations * math.sqrt(n * p * (1 - p)))


def _near_signs(candidates: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """The candidates whose bits of majority differ in at most ``most`` places."""
    left = sketches.select(F.col("id").alias("id_a"), F.col("signs").alias("signs_a"))
    right = sketches.select(F.col("id").alias("id_b"), F.col("signs").alias("signs_b"))
    both = candidates.join(left, "id_a").join(right, "id_b")
    differ = sum((F.bit_count(F.col("signs_a")[k].bitwiseXOR(F.col("signs_b")[k])) for k in range(SIGNS)), F.lit(0))
    return both.where(differ <= most).select("id_a", "id_b")


def holding(docs: DataFrame, ids: DataFrame, least_bits: int = 16, most_bits: int = 28) -> DataFrame:
    """The rows of ``docs`` whose id may be in ``ids``: those it certainly isn't are dropped before any shuffle, by a bitmap.

    It has eight bits for each of ``ids`` and 2 ** ``most_bits`` (32 MB) at most; with more than a few times 10 ** 8 ids it drops fewer rows, and more is shuffled.
    """
    bits = min(most_bits, max(least_bits, int(8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))  # the bitmap functions count places from 1
    marks = ids.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bitmap = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in marks.toLocalIterator():
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return docs.where(maybe(place))


def _verified(candidates: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """id_a, id_b, similarity: the candidates that hold against the words themselves."""

    @F.pandas_udf("double")
    def exact(title_a: pd.Series, content_a: pd.Series, title_b: pd.Series, content_b: pd.Series) -> pd.Series:
        last, counts, out = None, None, []
        for ta, ca, tb, cb in zip(title_a, content_a, title_b, content_b, strict=True):
            if (ta, ca) != last:
                last, counts = (ta, ca), pair_counts(ta, ca)
            out.append(overlap(counts, pair_counts(tb, cb)))
        return pd.Series(out, dtype="float64")

    def side(x: str) -> DataFrame:
        return docs.select(F.col("id").alias(f"id_{x}"), F.col("title").alias(f"title_{x}"), F.col("content").alias(f"content_{x}"))

    both = candidates.join(side("b"), "id_b").join(side("a"), "id_a")
    both = both.select("id_a", "id_b", exact("title_a", "content_a", "title_b", "content_b").alias("similarity"))
    return both.where(F.col("similarity") >= similarity)


def near_duplicates(docs: DataFrame, similarity: float = 0.55, least_words: int = 20, blocks: int = 8, hot: int = 2000, deviations: float = 3.0, part: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among the rows of ``docs`` (id, title, content; other columns are ignored).

    Returns ``(members, links)``: members (id, rep_id) has one row for each row of ``docs`` with at least ``least_words``
    words in its content, rep_id being the smallest id with the same words; links (id_a, id_b, similarity), id_a < id_b,
    has the pairs of different representatives that are alike. Both are written tables.

    Null titles and contents count as empty; rows that are too short, or whose id is null, are in neither table.
    An id is taken to be one row.
    """
    docs = docs.select(F.col("id").cast("long").alias("id"), "title", "content")
    every = written(_sketches(docs, least_words, 6 * blocks), "sketches")
    sigs = every.select("id", "sig")
    # Only classes with several rows are joined; a class of its own needs none.
    several = written(sigs.groupBy("sig").agg(F.min("id").alias("rep_id"), F.count("*").alias("n")).where("n > 1"), "classes").select("sig", "rep_id")
    members = written(sigs.join(several, "sig", "left").select("id", F.coalesce("rep_id", "id").alias("rep_id")).distinct(), "members")
    copies = members.where("id != rep_id").select("id")
    sketches = written(every.join(copies, "id", "left_anti").select("id", "n", "lead", "body", "signs"), "representatives")
    candidates = _candidates(_grouped(sketches, part), similarity, 6 * blocks, hot, _most(similarity, NEAR, deviations)).distinct()
    candidates = written(_near_signs(candidates, sketches, _most(similarity, SIGNS, deviations)), "candidates")
    ids = candidates.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    links = written(_verified(candidates, holding(docs, ids), similarity), "links")
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b of all alike rows, exact copies written out."""
    copies = members.where("id != rep_id")
    groups = copies.select("rep_id", "id").unionByName(copies.select("rep_id", F.col("rep_id").alias("id")).distinct())
    one, two = groups.withColumnRenamed("id", "x"), groups.withColumnRenamed("id", "y")
    within = one.join(two, "rep_id").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    left = links.join(one.withColumnRenamed("rep_id", "id_a"), "id_a", "left").select(F.coalesce("x", "id_a").alias("x"), "id_b")
    both = left.join(two.withColumnRenamed("rep_id", "id_b"), "id_b", "left").select("x", F.coalesce("y", "id_b").alias("y"))
    across = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionByName(across)


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id, links: for each row the smallest id of its class (connected alike texts) and the number of alike texts."""
    roots = components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    degree = links.select(F.explode(F.array("id_a", "id_b")).alias("rep_id")).groupBy("rep_id").agg(F.count("*").alias("links"))
    of = degree.join(roots.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    out = members.join(of, "rep_id", "left")
    return out.select("id", F.coalesce("root", "rep_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
