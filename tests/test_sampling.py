from pyspark.sql import functions as F

from lexivane.sampling import least_hashed


def test_least_hashed(spark):
    rows = spark.range(5000).withColumn("x", F.lit("a"))
    wanted = {r["id"] for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(40).collect()}
    got = least_hashed(rows.repartition(5), "id", 40, 3)
    assert {r["id"] for r in got.collect()} == wanted and got.columns == ["id", "x"]
    assert least_hashed(rows, "id", 9000).count() == 5000 and least_hashed(rows.where("id < 0"), "id", 5).count() == 0
    # Many rows with one key: the threshold may leave out all of them, and then all are ordered.
    assert least_hashed(spark.range(1000).select(F.lit(7).alias("id")), "id", 5).count() == 5
