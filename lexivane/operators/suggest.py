"""Terms related to a query: half edit distance to dictionary words, half words in the titles of the nearest documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.functions.text import title_words
from lexivane.operators.lexical import find
from lexivane.operators.search import probed, scored, top


def word_scores(titles: DataFrame) -> DataFrame:
    """word, total, count, score of ``titles`` (title, similarity): the similarities of a word's titles, each occurrence counted, times ln(1 + count)."""
    words = titles.where(F.col("title") != "").select("similarity", F.explode(title_words(F.col("title"))).alias("word"))
    sums = words.groupBy("word").agg(F.sum("similarity").alias("total"), F.count("*").alias("count"))
    return sums.withColumn("score", F.col("total") * F.log1p("count"))


def fused(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """word, score: half of each side, a word missing on one side has 0 there; semantic scores by their largest, if that is positive."""
    most = semantic.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("most"))
    sem = semantic.select("word", F.col("score").alias("s")).join(F.broadcast(most))  # one row
    sem = sem.select("word", F.when(F.col("most") > 0, F.col("s") / F.col("most")).otherwise(0.0).alias("s"))
    lex = lexical.groupBy("word").agg(F.max(F.col("score").cast("double")).alias("l"))
    both = lex.join(sem, "word", "full_outer")
    return both.select("word", F.round(0.5 * F.coalesce("l", F.lit(0.0)) + 0.5 * F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def suggest(docs: DataFrame, words: DataFrame, query: str, vector: Sequence[float], k: int = 10, centroids: DataFrame | None = None, probes: int = 10, titles: int = 50) -> DataFrame:
    """word, score of the k best terms, ties to the smaller word.

    With centroids, documents are those of the ``probes`` clusters whose (content) centroids are nearest; if there is none, nothing is suggested.
    Documents without a title vector take no part. An empty query has no terms.
    """
    none = words.select("word", F.lit(0.0).alias("score")).where(F.lit(False))
    if not query:
        return none
    if centroids is not None:
        near = probed(vector, centroids, probes)
        if not near:
            return none
        docs = docs.where(F.col("cluster_id").isin(near))
    best = top(scored(docs, vector, "title_embedding", missing=None), titles)
    # The fifty ids first, then their titles.
    semantic = word_scores(best.join(docs.select("id", "title"), "id"))
    out = fused(find(words, query, 3 * k), semantic).orderBy(F.desc("score"), "word")
    return out if k < 0 else out.limit(k)
