"""The stored documents: schema, ids, appends, cluster numbers, counts, migration, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("title_embedding", T.ArrayType(T.FloatType())),
        T.StructField("cluster_id", T.IntegerType()),
    ]
)


def numbered(docs: DataFrame, order: list[str], first: int = 1, key: str = "id") -> DataFrame:
    """With consecutive ids in the order of the columns. Rows are counted by range partition, so no task sees them all."""
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    from lexivane.session import written

    kept = written(ranged, "numbered")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()  # one row for each partition
    offsets, at = [], first
    for r in sizes:
        offsets.append((r["_part"], at - r["first"]))
        at += r["n"]
    if not offsets:
        return kept.drop("_part", "_row").withColumn(key, F.lit(None).cast("long"))
    table = docs.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return kept.join(F.broadcast(table), "_part").withColumn(key, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")


def migrated(docs: DataFrame) -> DataFrame:
    """With the columns of the present schema; those that are missing are null, a missing cluster is -1, missing texts are empty."""
    have = set(docs.columns)
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA]
    fixed = docs.select(*out)
    for c in ("title", "url", "content"):
        fixed = fixed.withColumn(c, F.coalesce(c, F.lit("")))
    return fixed.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def clustered(docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """With the clusters of ``assignment`` (id, cluster_id); documents it lacks keep theirs."""
    new = assignment.select("id", F.col("cluster_id").alias("_new"))
    return docs.join(new, "id", "left").withColumn("cluster_id", F.coalesce("_new", "cluster_id")).drop("_new")


def write_index(docs: DataFrame, path: str, mode: str = "overwrite", small: int = 4000) -> None:
    """One folder for each cluster, whose files a search for a few clusters alone reads; a small index is one file sorted by cluster."""
    docs = migrated(docs)
    if docs.limit(small + 1).count() <= small:
        docs.coalesce(1).sortWithinPartitions("cluster_id", "id").write.mode(mode).parquet(path)
    else:
        # A large cluster is written by several tasks: its rows are spread over up to 16 of them.
        docs.repartition("cluster_id", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode(mode).partitionBy("cluster_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return migrated(spark.read.option("mergeSchema", "true").parquet(path))


def counts(docs: DataFrame) -> DataFrame:
    """total, with_embedding, with_title_embedding, clustered; zeros for no documents."""
    has = lambda c: F.count(F.when(F.col(c).isNotNull(), 1))
    return docs.agg(F.count("*").alias("total"), has("embedding").alias("with_embedding"), has("title_embedding").alias("with_title_embedding"), F.count(F.when(F.col("cluster_id") >= 0, 1)).alias("clustered"))


def delete_all(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
