"""Feeds: RSS, Atom, RSS with Dublin Core and news pages in JSON, read from landed files; and RSS files written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.text import epoch_time, feed_time, strip_html


def _fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ITEM = _fields("title", "link", "pubDate", "author", "description", "content", "news_id", "guid")
ENTRY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
        T.StructField("published", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("author", _fields("name")),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
PAGE = T.StructType([T.StructField("result", T.StructType([T.StructField("total", T.LongType()), T.StructField("data", T.ArrayType(_fields("title", "url", "wapurl", "intime", "ctime", "author", "media_name", "summary", "intro")))]))])


def _filled(*columns: Column) -> Column:
    """The first that isn't null or blank, trimmed; else an empty string."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns], F.lit(""))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files in a folder, as they stand: surrounding white space is kept, and the file's path. Broken items are skipped."""
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreSurroundingSpaces", "false").option("mode", "DROPMALFORMED").schema(ITEM).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def documents(items: DataFrame) -> DataFrame:
    """title, url, content of items that have a description or, failing that, a content; markup is stripped after that, so a content may become empty."""
    body = F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, F.col("description")).otherwise(F.col("content"))
    kept = items.withColumn("body", body).where(F.length("body") > 0)
    return kept.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("url"), strip_html(F.col("body")).alias("content"), *[c for c in ("pubDate", "author", "file") if c in items.columns])


def _paragraph(text: Column) -> Column:
    """The text as an HTML paragraph, its signs escaped."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def _crawled(rows: DataFrame, now: str | None, link: Column, date: Column, author: Column, *bodies: Column) -> DataFrame:
    """title, link, pubDate, author, description as a crawler keeps them: dates as yyyy-MM-dd HH:mm:ss, ``now`` (else the time of the run) where there is none that can be
    read; a missing description is the title as a paragraph. Items with neither title nor link are left out."""
    title = _filled(F.col("title"))
    fallback = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    kept = rows.select(title.alias("title"), link.alias("link"), F.date_format(feed_time(date, fallback), "yyyy-MM-dd HH:mm:ss").alias("pubDate"), author.alias("author"), _filled(*bodies, _paragraph(title)).alias("description"))
    return kept.where("title != '' or link != ''")


def read_rss(spark: SparkSession, path: str, source: str, now: str | None = None) -> DataFrame:
    """Items of RSS files as ``_crawled`` has them; a missing author is the source."""
    return _crawled(read_items(spark, path), now, _filled(F.col("link")), F.col("pubDate"), _filled(F.col("author"), F.lit(source)), F.col("description"))


def read_atom(spark: SparkSession, path: str, source: str, now: str | None = None) -> DataFrame:
    """The same of Atom entries: the first link's address, published else updated, content else summary."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    return _crawled(rows, now, _filled(F.get("link", F.lit(0))["_href"]), _filled(F.col("published"), F.col("updated")), _filled(F.col("author.name"), F.lit(source)), F.col("content"), F.col("summary"))


def read_dublin_core(spark: SparkSession, path: str, source: str, now: str | None = None) -> DataFrame:
    """The same of RSS items whose date may be in dc:date and whose author may be in dc:creator."""
    schema = _fields("title", "link", "pubDate", "author", "description", "dc:date", "dc:creator")
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return _crawled(rows, now, _filled(F.col("link")), _filled(F.col("pubDate"), F.col("`dc:date`")), _filled(F.col("author"), F.col("`dc:creator`"), F.lit(source)), F.col("description"))


def read_pages(spark: SparkSession, path: str, source: str = "", now: str | None = None) -> DataFrame:
    """The same of landed pages of a news interface: ``url`` else ``wapurl``; ``intime`` else ``ctime``, in epoch seconds, at +08:00, neither if zero; the description is
    the summary, the introduction or the title as a paragraph; the author is the author, the medium or the source."""
    rows = spark.read.schema(PAGE).option("multiLine", "true").json(path).select(F.explode("result.data").alias("d")).select("d.*")
    seconds = F.coalesce(*[F.nullif(F.expr(f"try_cast({c} as bigint)"), F.lit(0)) for c in ("intime", "ctime")])
    text = _paragraph(_filled(F.col("summary"), F.col("intro"), F.col("title")))
    return _crawled(rows, now, _filled(F.col("url"), F.col("wapurl")), epoch_time(seconds), _filled(F.col("author"), F.col("media_name"), F.lit(source)), text)


def dated(items: DataFrame, now: str, column: str = "pubDate") -> DataFrame:
    """With ``published``: the date as a timestamp, ``now`` where it can't be read."""
    return items.withColumn("published", feed_time(F.col(column), F.to_timestamp(F.lit(now))))


def write_rss(items: DataFrame, path: str, per_file: int = 500, head: dict[str, str] | None = None) -> None:
    """RSS files, each ``rss`` with a ``channel`` of at most ``per_file`` items behind its ``head`` (title, link, description, ...); texts are escaped."""
    columns = [c for c in ("title", "link", "pubDate", "author", "description", "content", "guid") if c in items.columns]
    # Rows are numbered within their partition, so that a file has items of one partition and nothing waits for all.
    row = F.monotonically_increasing_id()
    part, number = F.shiftright(row, 33), F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / per_file)
    each = items.select(part.alias("part"), number.alias("number"), F.struct(*columns).alias("item"))
    files = each.groupBy("part", "number").agg(F.collect_list("item").alias("item"))  # per_file items at most
    channel = files.select(*[F.lit(v).alias(k) for k, v in (head or {}).items()], "item")
    channel.write.format("xml").option("rootTag", "rss").option("rowTag", "channel").option("maxRecordsPerFile", 1).mode("overwrite").save(path)
