import math

import pytest

from lexivane.operators import lexical, suggest
from lexivane.operators.cache import Cache


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_dictionary(spark):
    lines = spark.createDataFrame([("word 3 n",), ("word 3 n",), ("",), ("x" * 31,), ("中" * 10 + " 1 n",), ("中" * 11,)], "value string")
    assert sorted(r["word"] for r in lexical.dictionary(lines).collect()) == sorted(["word", "word", "中" * 10])


def test_find(spark):
    w = words(spark, "search", "seerch", "sea", "march", "searching", "")
    got = [(r["word"], round(r["score"], 3)) for r in lexical.find(w, "search", 10).collect()]
    assert got == [("search", 1.0), ("seerch", 0.833), ("searching", 0.667), ("sea", 0.5)]
    assert lexical.find(w, "", 5).count() == 0


def test_threshold_is_in_single_precision(spark):
    # Distance 7 of 10: 1 - 0.7 is just 0.3 in single precision, and not more.
    assert lexical.find(words(spark, "abcdefghij"), "abcxxxxxxx", 5).count() == 0


def test_find_many_like_find(spark):
    w = words(spark, "apple", "apply", "ample", "maple", "banana")
    asked = spark.createDataFrame([("apple",), ("banan",), ("",), (None,)], "query string")
    got = {}
    for r in lexical.find_many(w, asked, 3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["word"])
    assert got == {q: [r["word"] for r in lexical.find(w, q, 3).collect()] for q in ("apple", "banan")}


def test_word_scores(spark):
    titles = spark.createDataFrame([("alpha alpha", 0.5), ("", 1.0)], "title string, similarity double")
    row = suggest.word_scores(titles).first()
    assert (row["word"], row["total"], row["count"]) == ("alpha", 1.0, 2) and row["score"] == pytest.approx(math.log(3))


@pytest.mark.parametrize(("sem", "wanted"), [([("b", 2.0), ("c", 4.0)], {"a": 0.5, "b": 0.5, "c": 0.5}), ([("b", -1.0)], {"a": 0.5, "b": 0.25}), ([], {"a": 0.5, "b": 0.25})])
def test_fused(spark, sem, wanted):
    lex = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "word string, score float")
    got = suggest.fused(lex, spark.createDataFrame(sem, "word string, score double"))
    assert {r["word"]: r["score"] for r in got.collect()} == wanted


def test_suggest_without_clusters_is_empty(spark):
    docs = spark.createDataFrame([(1, "alpha", [1.0], 0)], "id long, title string, title_embedding array<float>, cluster_id int")
    none = spark.createDataFrame([], "cluster_id int, centroid array<float>")
    assert suggest.suggest(docs, words(spark, "alpha"), "alpha", [1.0], centroids=none).count() == 0
    assert [r["word"] for r in suggest.suggest(docs, words(spark, "alps"), "alps", [1.0]).collect()] == ["alpha", "alps"]
    assert suggest.suggest(docs, words(spark, "alps"), "", [1.0]).count() == 0


def test_cache_evicts_least_used_then_oldest():
    c = Cache(2)
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert "b" not in c and c.get("a") == 1
    d = Cache(2)
    for k in "abc":
        d.put(k, k)
    assert "a" not in d and "b" in d
    d.put("b", "B")
    d.put("e", 1)
    assert d.get("b") == "B" and "c" not in d


def test_cache_like_a_model():
    import random

    rng, c, model, turn = random.Random(1), Cache(3), {}, 0
    for _ in range(2000):
        k = rng.randrange(6)
        if rng.random() < 0.5:
            assert c.get(k) == (model[k][0] if k in model else None)
            if k in model:
                model[k][1] += 1
        elif k in model:
            model[k][0] = turn
            model[k][1] += 1
            c.put(k, turn)
        else:
            if len(model) == 3:
                del model[min(model, key=lambda x: model[x][1:])]
            turn += 1
            model[k] = [turn, 1, turn]
            c.put(k, turn)
    empty = Cache(0)
    empty.put(1, 1)
    assert len(empty) == 0
