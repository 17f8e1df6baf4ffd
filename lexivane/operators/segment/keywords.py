"""Segmentation of whole tables, and keywords by tf-idf and by text rank."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.operators.segment.cutting import Segmenter, tag, with_offsets


def segmented(texts: DataFrame, segmenter: Segmenter, kind: str = "mix", key: str = "id", text: str = "text") -> DataFrame:
    """key, words: each text's words as an array, null for a null text."""
    shared = texts.sparkSession.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else shared.value.cut(t, kind))

    return texts.select(key, cut(text).alias("words"))


def located(texts: DataFrame, segmenter: Segmenter, key: str = "id", text: str = "text") -> DataFrame:
    """key, word, offset (bytes), unicode_offset, unicode_length, tag: one row for each word of the mixed cut."""
    shared = texts.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            rows = [(k, *w, tag(s.lexicon, w[0])) for k, t in zip(batch["key"], batch["text"], strict=True) for w in with_offsets(s.cut(t))]
            yield pd.DataFrame(rows, columns=["key", "word", "offset", "unicode_offset", "unicode_length", "tag"])

    out = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, word string, offset int, unicode_offset int, unicode_length int, tag string")
    return out.withColumnRenamed("key", key)


def tf_idf(words: DataFrame, idf: DataFrame, average: float, stop_words: DataFrame | None = None, top: int = 10, key: str = "id") -> DataFrame:
    """key, word, weight, offsets: the ``top`` words of each text of ``words`` (key, word, offset) by frequency times idf, ties to the smaller word.

    Words of one character and stop words are left out; a word without an idf (word, idf) has the average.
    """
    kept = words.where(F.char_length("word") > 1)
    if stop_words is not None:
        kept = kept.join(stop_words.select("word").distinct(), "word", "left_anti")
    counts = kept.groupBy(key, "word").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("offset")).alias("offsets"))
    scored = counts.join(idf.dropDuplicates(["word"]), "word", "left").withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(average)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "word", "weight", "offsets")


def rank_words(words: list[str], stop_words: frozenset[str] = frozenset(), top: int = 10, span: int = 5, rounds: int = 10, damping: float = 0.85) -> list[tuple[str, float, list[int]]]:
    """word, weight, byte offsets by text rank: words within a span of kept ones are linked, and weights renewed in place in byte order.

    A text with one kept word has no links: one entry, without a word, of weight 0.
    """
    kept, at = [], 0
    for w in words:
        if len(w) > 1 and w not in stop_words:
            kept.append((w, at))
        at += len(w.encode())
    places: dict[str, list[int]] = {}
    links: dict[str, dict[str, float]] = {}
    for i, (a, offset) in enumerate(kept):
        places.setdefault(a, []).append(offset)
        for b, _ in kept[i + 1 : i + span]:
            for x, y in ((a, b), (b, a)):
                links.setdefault(x, {})[y] = links.setdefault(x, {}).get(y, 0.0) + 1.0
    if not kept:
        return []
    if not links:
        return [("", 0.0, next(iter(places.values())))]
    order = sorted(links, key=str.encode)
    weight = dict.fromkeys(order, 1.0 / len(order))
    out = {w: sum(e.values()) for w, e in links.items()}
    sorted_links = {w: sorted(links[w].items(), key=lambda e: e[0].encode()) for w in order}
    for _ in range(rounds):
        for w in order:
            weight[w] = (1 - damping) + damping * sum(n / out[x] * weight[x] for x, n in sorted_links[w])
    low, high = min(weight.values()), max(weight.values())
    scale = high - low / 10
    ranked = sorted(((w, (v - low / 10) / scale, places[w]) for w, v in weight.items()), key=lambda e: (-round(e[1], 12), e[0].encode()))
    return ranked[:top]


def text_rank(words: DataFrame, stop_words: frozenset[str] = frozenset(), top: int = 10, key: str = "id") -> DataFrame:
    """key, word, weight, offsets of ``words`` (key, words: the whole cut of each text). Each row is ranked by itself, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *e) for k, w in zip(batch["key"], batch["words"], strict=True) if w is not None for e in rank_words(list(w), stop_words, top)]
            yield pd.DataFrame(rows, columns=["key", "word", "weight", "offsets"])

    out = words.select(F.col(key).cast("long").alias("key"), "words").mapInPandas(run, "key long, word string, weight double, offsets array<int>")
    return out.withColumnRenamed("key", key)
