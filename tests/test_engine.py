import json

from pyspark.sql import functions as F

from lexivane.operators.encoders import HashingEncoder, encoded, mean_of, pooled, unit
from lexivane.operators.latency import latency_stats
from lexivane.plans.engine import Engine
from lexivane.streaming.ingest import feed_stream, ingest

ITEMS = "".join(f"<item><title>{t}</title><link>http://x/{k}</link><description>{d}</description></item>" for k, (t, d) in enumerate([("solar energy", "solar panels make energy"), ("river boats", "boats on the river"), ("solar storms", "storms of the sun"), ("bread", "how to bake bread")]))


def test_encoders(spark):
    e = HashingEncoder(16)
    x = e.encode(["solar energy", "", "solar energy"])
    assert (x[0] == x[2]).all() and abs((x[0] ** 2).sum() - 1) < 1e-9 and not x[1].any()
    rows = encoded(spark.createDataFrame([("a",), ("",), (None,)], "t string"), e, "t", "v").collect()
    assert [r["v"] is None for r in rows] == [False, True, True]
    assert pooled(x[:1], 0).tolist() == [0.0] * 16 and unit(x[1]).tolist() == [0.0] * 16
    m = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 2.0])], "k long, v array<double>")
    assert [round(v, 6) for v in mean_of(m, "k", "v").first()["v"]] == [0.707107, 0.707107]


def test_engine(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "a.xml").write_text(f"<rss><channel>{ITEMS}</channel></rss>")
    words = spark.createDataFrame([("solar",), ("sonar",)], "word string")
    engine = Engine(spark, HashingEncoder(), words)
    assert engine.answer("/search?q=x")[0] == 503 and engine.search("x") == [] and engine.suggest("x") == []
    engine.build(f"{tmp_path}/feeds", f"{tmp_path}/index")
    found = engine.search("solar panels make energy", 2)
    assert found[0]["title"] == "solar energy" and set(found[0]) == {"content", "docId", "similarity", "title", "url"}
    assert engine.search("solar panels make energy", 2) is found and len(engine.search("solar panels make energy", 1)) == 1
    assert "solar" in engine.suggest("solar") and engine.search("") == []
    status, body = engine.answer("/suggest?keywords=solar&q=other")
    assert status == 200 and "solar" in json.loads(body)
    assert "routes" in json.loads(engine.answer("/search")[1])
    again = Engine(spark, HashingEncoder(), words).open(f"{tmp_path}/index")
    assert [r["docId"] for r in again.search("solar panels make energy", 2)] == [r["docId"] for r in found]
    assert again.size() == 4
    again.delete_all(f"{tmp_path}/index")
    assert again.size() == 0 and again.search("solar panels make energy", 2) == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(f"<rss><channel>{ITEMS}</channel></rss>")
    centroids = spark.createDataFrame([(k, [float(x) for x in HashingEncoder().encode([t])[0]]) for k, t in enumerate(["solar energy", "river boats"])], "cluster_id int, centroid array<float>")
    for _ in range(2):
        q = ingest(feed_stream(spark, f"{tmp_path}/in"), HashingEncoder(), centroids, f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 4 and got.where("cluster_id in (0, 1)").count() == 4 and got.select("id").distinct().count() == 4


def test_latency(spark):
    times = spark.createDataFrame([("a", float(k)) for k in range(1, 101)] + [("b", 5.0), ("b", None), ("b", float("nan"))], "g string, v double")
    got = {r["g"]: r for r in latency_stats(times, "v", 10.0, "g").collect()}
    assert [got["a"][c] for c in ("n", "mean", "p50", "p90", "p99", "max", "per_second")] == [100, 50.5, 51.0, 91.0, 100.0, 100.0, 10.0]
    assert got["b"]["p99"] == 5.0 and latency_stats(times.where(F.lit(False)), "v", 1.0).count() in (0, 1)
