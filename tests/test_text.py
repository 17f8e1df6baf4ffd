import random
import re

import pytest
from pyspark.sql import functions as F

from lexivane.functions import text as X


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return row.select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


def decoded(s):
    """Character by character."""
    names = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}
    out, i = "", 0
    while i < len(s):
        if s[i] == "&":
            end = s.find(";", i)
            if 0 < end - i <= 10:
                name = s[i + 1 : end]
                if name in names:
                    out += names[name]
                    i = end + 1
                    continue
                if name.startswith("#") and len(name) > 1:
                    i = end + 1
                    continue
        out += s[i]
        i += 1
    return out


def stripped(s):
    out, inside = "", False
    for c in s:
        if c == ">":
            inside = False
            if out and out[-1] != " ":
                out += " "
        elif c == "<":
            inside = True
        elif not inside:
            out += c
    return decoded(out)


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("<p>hi &amp; bye</p>", "hi & bye "), ("a<b", "a"), ("a > b", "a  b"), (">x", "x"), ("x<br><br>y", "x y"), ("a<b>c</b> d", "a c  d"), ("<p></p>", ""), ("&amp;lt;", "&lt;"), ("&#39;s", "s"), ("&copy;", "&copy;"), ("&lt;p&gt;", "<p>"), ("", ""), (None, None)],
)
def test_strip_html_cases(spark, given, wanted):
    assert one(spark, X.strip_html, given) == wanted


def test_strip_html_like_the_character_model(spark):
    rng = random.Random(3)
    parts = ["<", ">", "&", ";", "lt", "amp", "#39", " ", "a", "中", "<b>", "&lt;", "&amp;", "&#8217;", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip_html(F.col("t")).alias("x")).collect()
    wrong = [(r["t"], r["x"], stripped(r["t"])) for r in rows if r["x"] != stripped(r["t"])]
    assert not wrong, wrong[:3]


def test_title_words(spark):
    assert one(spark, X.title_words, "搜索-A_1，é x中") == ["搜索-A_1", "x中"]
    assert one(spark, X.title_words, "") == []


@pytest.mark.parametrize(("a", "b", "distance", "similarity"), [("搜索引", "搜索引擎", 3, 0.75), ("癌症", "癌变", 3, 0.5), ("kitten", "sitting", 3, 1 - 3 / 7), ("", "", 0, 1.0)])
def test_byte_distance(spark, a, b, distance, similarity):
    assert one(spark, X.byte_distance, a, b) == distance
    assert one(spark, lambda x, y: X.byte_similarity(X.byte_distance(x, y), x, y), a, b) == pytest.approx(similarity, abs=1e-6)


def test_addresses(spark):
    assert one(spark, X.url_decode, "a%20b+c%zz%") == "a b c%zz%"
    assert one(spark, X.url_encode, "a b*~-_.é") == "a+b%2A~-_.%C3%A9"
    assert one(spark, X.query_text, "/search?x=1&keywords=a%20b&q=z") == "a b"
    assert one(spark, X.query_text, "/search?x=1") is None
    assert one(spark, X.query_text, "/search") is None


def test_splits(spark):
    assert one(spark, X.split_ascii_space, " a\t b\n") == ["a", "b"]
    assert one(spark, X.split_ascii_space, " ") == []
    assert one(spark, X.split_single_space, " a  b ") == ["a", "b"]
    assert one(spark, lambda t: X.split_ascii_space(X.pad_cjk(t)), "ab中文c") == ["ab", "中", "文", "c"]


def test_repaired(spark):
    good = "崖岳岭"
    assert one(spark, X.repaired, good.encode().decode("latin-1")) == good
    assert one(spark, X.repaired, good) == good
    assert one(spark, X.repaired, "café") == "café"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Tue, 05 Apr 2016 08:54:33 +0800", "2016-04-05 08:54:33"), ("2016-04-05T08:54:33Z", "2016-04-05 08:54:33"), ("2016-04-05T08:54:33+08:00", "2016-04-05 08:54:33"), ("2016-04-05 08:54", "2016-04-05 08:54:00"), ("2016-04-05", "2016-04-05 00:00:00"), ("soon", "2020-01-01 00:00:00"), (None, "2020-01-01 00:00:00")],
)
def test_feed_time(spark, given, wanted):
    got = one(spark, lambda t: F.date_format(X.feed_time(t, F.to_timestamp(F.lit("2020-01-01 00:00:00"))), "yyyy-MM-dd HH:mm:ss"), given)
    assert got == wanted


def test_epoch_time(spark):
    assert spark.range(1).select(X.epoch_time(F.lit(0)).alias("x")).first()["x"] == "1970-01-01 08:00:00"


def test_patterns_are_ascii_safe():
    assert re.fullmatch(r"[\x20-\x7e]+", X.TITLE_WORD)
