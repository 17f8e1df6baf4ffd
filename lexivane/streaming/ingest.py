"""New feed files as a stream: documents, vectors, and the nearest of fixed centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivane.operators.encoders import Encoder, encoded
from lexivane.operators.ivf import assigned
from lexivane.sources.feeds import ITEM, documents
from lexivane.sources.store import migrated


def feed_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the feed files that arrive in a folder."""
    rows = spark.readStream.format("xml").option("rowTag", "item").option("ignoreSurroundingSpaces", "false").option("mode", "DROPMALFORMED").schema(ITEM).load(path)
    return documents(rows.withColumn("file", F.col("_metadata.file_path")))


def ingest(docs: DataFrame, encoder: Encoder, centroids: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to the index under ids hashed from file and address; a batch that is run again overwrites its own folder, so nothing is stored twice."""

    def batch(part: DataFrame, number: int) -> None:
        keyed = part.withColumn("id", F.xxhash64("file", "url", "title"))
        full = migrated(encoded(encoded(keyed, encoder, "content", "embedding"), encoder, "title", "title_embedding"))
        near = assigned(full, centroids)
        placed = full.drop("cluster_id").join(near.select("id", "cluster_id"), "id", "left")
        migrated(placed).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
