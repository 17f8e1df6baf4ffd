from pyspark.sql import functions as F

from lexivane.functions import strings as T


def test_helpers(spark):
    row = spark.createDataFrame([(" a,b;c ", ["x", None, "y"], "p/", "/q", "中文 é")], "t string, a array<string>, l string, r string, z string")
    got = row.select(
        T.joined(F.col("a"), "-").alias("joined"), T.trimmed(F.col("t")).alias("trimmed"), T.trimmed(F.lit("xxaxx"), "x").alias("signs"), T.split_at(F.col("t"), ",;").alias("split"), T.split_at(F.col("t"), ",;", 2).alias("two"),
        T.starts(F.col("t"), " a").alias("starts"), T.ends(F.col("t"), "c").alias("ends"), T.path_joined(F.col("l"), F.col("r")).alias("path"), T.path_joined(F.lit(""), F.col("r")).alias("bare"),
        T.decoded(T.encoded(F.col("z"), "gb18030"), "gb18030").alias("gbk"), T.decoded(T.encoded(F.col("z"), "UTF-16BE"), "utf-16-be").alias("utf16"), T.encoded(F.lit("中é"), "gbk").alias("bytes"),
        T.formatted(F.to_timestamp(F.lit("2026-01-02 03:04:05"))).alias("time"),
    ).first()
    assert (got["joined"], got["trimmed"], got["signs"], got["path"], got["bare"], got["time"]) == ("x-y", "a,b;c", "a", "p/q", "/q", "2026-01-02 03:04:05")
    assert got["split"] == [" a", "b", "c "] and got["two"] == [" a", "b;c "] and got["starts"] and not got["ends"]
    assert got["gbk"] == got["utf16"] == "中文 é" and bytes(got["bytes"]) == "中é".encode("gbk", "replace")
