"""What the physical plans of the main queries must and must not have."""

import re

import pytest
from pyspark.sql import functions as F

from lexivane.operators import lexical
from lexivane.operators import search as S
from lexivane.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = spark.range(200).select(F.col("id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"), F.array(F.rand(3).cast("float")).alias("title_embedding"), (F.col("id") % 10).cast("int").alias("cluster_id"))
    store.write_index(rows, path, small=1)
    return path


def test_search_reads_ids_and_vectors_only(spark, index):
    text = plan(S.search(spark.read.parquet(index), [1.0, 0.0], 5))
    schema = re.search(r"ReadSchema: struct<([^\n]*)", text)[1]
    assert "TakeOrderedAndProject" in text and "content" not in schema and "title" not in schema and "Exchange" not in text and "NestedLoop" not in text


def test_probed_search_prunes_folders(spark, index):
    centroids = spark.createDataFrame([(c, [float(c), 0.0]) for c in range(10)], "cluster_id int, centroid array<float>")
    text = plan(S.search(spark.read.parquet(index), [3.0, 0.0], 5, centroids, 2))
    assert re.search(r"PartitionFilters: \[[^\]]*cluster_id", text)


def test_title_filter_is_pushed_down(spark, index):
    text = plan(S.scored(spark.read.parquet(index), [1.0], "title_embedding", missing=None))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(title_embedding\)", text)


def test_look_up_of_many_words_is_an_equi_join(spark):
    words = spark.range(100000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    asked = words.limit(50).withColumnRenamed("word", "query")
    text = plan(lexical.find_many(words, asked))
    assert "Cartesian" not in text and "NestedLoop" not in text
