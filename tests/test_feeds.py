import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexivane.sources import feeds, files, store

RSS = """<?xml version="1.0" encoding="utf-8"?>
<rss><channel><title>T</title>
<item><title> First </title><link>http://a/1</link><description>&lt;p&gt;one &amp;amp; two&lt;/p&gt;</description><pubDate>2026-01-02 03:04:05</pubDate></item>
<item><title>Second</title><link>http://a/2</link><content>body</content></item>
<item><title>Third</title><link>http://a/3</link></item>
<item><title>Fourth</title><link>http://a/4</link><description>&lt;br&gt;</description></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E1</title><link href="http://b/1"/><updated>2026-02-03T04:05:06Z</updated><author><name>N</name></author><summary>s</summary></entry>
<entry><title>E2</title><link href="http://b/2"/><link href="http://b/other"/><published>2026-02-04T04:05:06Z</published><updated>x</updated><content>c</content><summary>s</summary></entry></feed>"""
DC = """<rdf><item><title>D</title><link>http://c/1</link><dc:date xmlns:dc="d">2026-03-04T05:06:07+08:00</dc:date><dc:creator xmlns:dc="d">W</dc:creator></item></rdf>"""


NOW = "2026-05-06 07:08:09"


@pytest.fixture
def folder(tmp_path):
    for name, text in (("rss", RSS), ("atom", ATOM), ("dc", DC)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.xml").write_text(text)
    (tmp_path / "json").mkdir()
    page = {"result": {"total": 4, "data": [{"title": "J", "wapurl": "http://d/1", "ctime": "0", "media_name": "M"}, {"title": "", "url": ""}, {"title": "K & L", "url": "http://d/2", "intime": "1767225600", "ctime": "9", "summary": "a <b> c"}, {"title": "M <x>", "url": "http://d/3", "intime": "0", "ctime": "86400"}]}}
    (tmp_path / "json" / "1.json").write_text(json.dumps(page))
    return tmp_path


def test_items_and_documents(spark, folder):
    (folder / "rss" / "broken.xml").write_text("<rss><channel><item><title>x</titel></item>")
    docs = {r["url"]: r for r in feeds.documents(feeds.read_items(spark, f"{folder}/rss")).collect()}
    assert set(docs) == {"http://a/1", "http://a/2", "http://a/4"}
    assert docs["http://a/1"]["content"] == "one & two " and docs["http://a/1"]["title"] == " First " and docs["http://a/4"]["content"] == ""


def test_crawled_feeds(spark, folder):
    rss = feeds.read_rss(spark, f"{folder}/rss", "src", NOW).orderBy("link").collect()
    assert [tuple(r) for r in rss][2] == ("Third", "http://a/3", NOW, "src", "<p>Third</p>") and rss[0]["title"] == "First"
    atom = feeds.read_atom(spark, f"{folder}/atom", "src", NOW).orderBy("link").collect()
    assert [tuple(r) for r in atom] == [("E1", "http://b/1", "2026-02-03 04:05:06", "N", "s"), ("E2", "http://b/2", "2026-02-04 04:05:06", "src", "c")]
    assert tuple(feeds.read_dublin_core(spark, f"{folder}/dc", "src", NOW).first()) == ("D", "http://c/1", "2026-03-04 05:06:07", "W", "<p>D</p>")
    pages = feeds.read_pages(spark, f"{folder}/json", "src", NOW).orderBy("link").collect()
    assert [tuple(r) for r in pages] == [("J", "http://d/1", NOW, "M", "<p>J</p>"), ("K & L", "http://d/2", "2026-01-01 08:00:00", "src", "<p>a &lt;b&gt; c</p>"), ("M <x>", "http://d/3", "1970-01-02 08:00:00", "src", "<p>M &lt;x&gt;</p>")]


def test_written_feeds_are_read_again(spark, folder):
    items = spark.createDataFrame([(f"t & <{k}>", f"http://e/{k}", "d") for k in range(7)], "title string, link string, description string").coalesce(1)
    feeds.write_rss(items, f"{folder}/out", per_file=3, head={"title": "News", "link": "http://e/"})
    back = feeds.read_items(spark, f"{folder}/out")
    assert sorted(r["title"] for r in back.collect()) == sorted(f"t & <{k}>" for k in range(7)) and back.select("file").distinct().count() == 3
    for f in (folder / "out").glob("part-*"):
        root = ElementTree.parse(f).getroot()
        assert root.tag == "rss" and root.find("channel/title").text == "News" and len(root.findall("channel/item/link")) in (1, 3)


def test_config_and_vocabulary():
    assert files.read_config("k: a:b # c\n# x: y\nk2:1\nk2: 2\nnone\n") == {"k": "a:b", "k2": "2"}
    v, settings = files.read_vocabulary(json.dumps({"model": {"vocab": {"a": 0}, "unk_token": "[UNK]", "max_input_chars_per_word": 9}, "added_tokens": [{"content": "[CLS]", "special": True}, {"content": "z", "special": False}]}))
    assert v == {"a": 0} and settings == {"unknown": "[UNK]", "longest": 9, "special": ["[CLS]"]}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, None, [1.0])], "id long, title string, embedding array<float>")
    docs = store.migrated(old)
    assert [f.name for f in docs.schema] == [f.name for f in store.SCHEMA]
    assert docs.where("id = 2").select("title", "cluster_id").first() == ("", -1)
    again = store.clustered(docs, spark.createDataFrame([(2, 4)], "id long, cluster_id int"))
    assert {r["id"]: r["cluster_id"] for r in again.collect()} == {1: -1, 2: 4}
    store.write_index(again, f"{tmp_path}/small")
    assert tuple(store.counts(store.read_index(spark, f"{tmp_path}/small")).first()) == (2, 1, 0, 1)
    store.write_index(again, f"{tmp_path}/large", small=1)
    pruned = store.read_index(spark, f"{tmp_path}/large").where("cluster_id = 4")
    assert [r["id"] for r in pruned.collect()] == [2]
    store.delete_all(spark, f"{tmp_path}/small")
    assert tuple(store.counts(store.read_index(spark, f"{tmp_path}/small")).first()) == (0, 0, 0, 0)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = store.numbered(rows, ["k"]).collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(k + 1, k) for k in range(1000)]
    assert store.numbered(rows.where("k < 0"), ["k"]).count() == 0
