"""The facade: build an index from feeds, then answer searches and suggestions, with cached results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.operators import ivf
from lexivane.operators.cache import Cache
from lexivane.operators.encoders import Encoder, encoded
from lexivane.operators.search import fetched, search
from lexivane.operators.suggest import suggest
from lexivane.session import shipped
from lexivane.sources import feeds, store


class Engine:
    """Not ready until an index is built or opened; then ``search`` and ``suggest`` return lists, also as JSON by ``answer``.

    ``parity`` leaves the number of results out of the cache's key, so that a repeated query has as many results as the first time.
    """

    def __init__(self, spark: SparkSession, encoder: Encoder, words: DataFrame | None = None, cache: int = 1000, parity: bool = False):
        self.spark, self.encoder, self.parity = shipped(spark), encoder, parity
        self.words = words if words is not None else spark.createDataFrame([], "word string")
        self.docs: DataFrame | None = None
        self.centroids: DataFrame | None = None
        self._found, self._suggested = Cache(cache), Cache(cache)

    @property
    def ready(self) -> bool:
        return self.docs is not None

    def build(self, feeds_path: str, index_path: str) -> Engine:
        """Feeds to documents, vectors, clusters, and an index of one folder for each cluster."""
        docs = feeds.documents(feeds.read_items(self.spark, feeds_path))
        numbered = store.numbered(docs, ["file", "url", "title"])
        full = encoded(encoded(numbered, self.encoder, "content", "embedding"), self.encoder, "title", "title_embedding")
        return self.index(full, index_path)

    def index(self, docs: DataFrame, index_path: str) -> Engine:
        docs = store.migrated(docs)
        centroids, assignment = ivf.trained(docs)
        store.write_index(store.clustered(docs.withColumn("cluster_id", F.lit(-1)), assignment), f"{index_path}/docs")
        centroids.write.mode("overwrite").parquet(f"{index_path}/centroids")
        return self.open(index_path)

    def open(self, index_path: str) -> Engine:
        self.docs = store.read_index(self.spark, f"{index_path}/docs")
        self.centroids = self.spark.read.parquet(f"{index_path}/centroids")
        self._found.clear()
        self._suggested.clear()
        return self

    def _vector(self, query: str) -> list[float]:
        return [float(x) for x in self.encoder.encode([query])[0]]

    def _trained(self) -> DataFrame | None:
        return self.centroids if self.centroids is not None and not self.centroids.isEmpty() else None

    def search(self, query: str, k: int = -1, probes: int = 5) -> list[dict]:
        """content, docId, similarity, title, url of the nearest documents; an empty result is not cached."""
        if not query or not self.ready:
            return []
        key = query if self.parity else (query, k)
        hit = self._found.get(key)
        if hit is None:
            best = search(self.docs, self._vector(query), k, self._trained(), probes)
            rows = fetched(best, self.docs).select("content", F.col("id").alias("docId"), "similarity", "title", "url").collect()
            hit = [r.asDict() for r in rows]
            if hit:
                self._found.put(key, hit)
        return hit

    def suggest(self, query: str, k: int = 10) -> list[str]:
        if not query or not self.ready:
            return []
        key = query if self.parity else (query, k)
        hit = self._suggested.get(key)
        if hit is None:
            hit = [r["word"] for r in suggest(self.docs, self.words, query, self._vector(query), k, self._trained()).collect()]
            self._suggested.put(key, hit)
        return hit

    def answer(self, target: str) -> tuple[int, str]:
        """Status and JSON for a request target: /search or /semantic, /suggest, else a list of these; 503 until an index is there."""
        from urllib.parse import parse_qsl, urlsplit

        parts = urlsplit(target)
        query = next((v for n, v in parse_qsl(parts.query, keep_blank_values=True) if n in ("q", "query", "keywords")), "")
        if not self.ready:
            return 503, json.dumps({"error": "the index is being built"})
        dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        if query and parts.path in ("/search", "/semantic"):
            return 200, dump(self.search(query))
        if query and parts.path == "/suggest":
            return 200, dump(self.suggest(query))
        return 200, dump({"routes": ["/search?q=", "/semantic?q=", "/suggest?q="]})

    def size(self) -> int:
        return self.docs.count() if self.ready else 0

    def delete_all(self, index_path: str) -> None:
        """Leaves an empty index, which answers with empty results."""
        store.delete_all(self.spark, f"{index_path}/docs")
        self.open(index_path)

    def clear(self) -> None:
        self._found.clear()
        self._suggested.clear()
