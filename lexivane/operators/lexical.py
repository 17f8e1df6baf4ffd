"""Fuzzy look-up of dictionary words by byte edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivane.functions.text import byte_distance, byte_similarity, same_first_byte

#: A word must be more alike than this, in single precision.
THRESHOLD = 0.3


def dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """word: of each line what stands before the first space, kept if of 1 to 30 bytes; repeated words stay."""
    word = F.substring_index(F.col(column), " ", 1)
    return lines.select(word.alias("word")).where(F.octet_length("word").between(1, 30))


def _alike(word: Column, query: Column) -> tuple[Column, Column]:
    """The cheap conditions and the similarity."""
    near = F.abs(F.octet_length(word) - F.octet_length(query)) <= F.floor(F.octet_length(query) / 2) + 1
    return same_first_byte(word, query) & near, byte_similarity(byte_distance(word, query), word, query)


def find(words: DataFrame, query: str, k: int = 5) -> DataFrame:
    """word, score of the k most similar words, ties to the smaller word; none for an empty query."""
    if not query:
        return words.select("word", F.lit(0.0).cast("float").alias("score")).where(F.lit(False))
    cheap, similarity = _alike(F.col("word"), F.lit(query))
    scored = words.where(cheap).select("word", similarity.alias("score"))
    out = scored.where(F.col("score") > F.lit(THRESHOLD).cast("float")).orderBy(F.desc("score"), "word")
    return out if k < 0 else out.limit(k)


def find_many(words: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, word, score, rank for a table of queries: a join on the first byte, the length bound in it, then the distance."""
    w = words.where(F.col("word") != "").withColumn("b", F.substring(F.encode("word", "UTF-8"), 1, 1))
    q = queries.where(F.col("query") != "").select("query").distinct().withColumn("b", F.substring(F.encode("query", "UTF-8"), 1, 1))
    cheap, similarity = _alike(F.col("word"), F.col("query"))
    scored = w.join(q, "b").where(cheap).select("query", "word", similarity.alias("score")).where(F.col("score") > F.lit(THRESHOLD).cast("float"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
