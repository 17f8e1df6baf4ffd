import math

import pytest

from lexivane.operators.segment import cutting as C
from lexivane.operators.segment import keywords as K
from lexivane.operators.segment import lexicon as L
from lexivane.operators.wordpiece import WordPiece, padded

LINES = ["南京 50 ns", "南京市 40 ns", "市长 30 n", "长江 40 ns", "大桥 40 n", "长江大桥 20 ns", "江 5 n", "大 9 a"]
CHAIN = ["#start", "-0.26 -3.14e+100 -3.14e+100 -1.46", "-3.14e+100 -0.51 -0.91 -3.14e+100", "-0.58 -3.14e+100 -3.14e+100 -0.80", "-3.14e+100 -0.33 -1.26 -3.14e+100", "-0.72 -3.14e+100 -3.14e+100 -0.66", "甲:-1.0", "乙:-1.0", "", "丙:-1.0"]


def chain():
    lines = CHAIN[:-2] + ["丁:-1.0", "丙:-1.0"]
    return L.load_chain(lines)


def test_lexicon():
    x = L.load_lexicon(LINES, ["云计算", "李小福 nr", "杰 40 nr"])
    assert x.words["南京"][0] == pytest.approx(math.log(50 / 234)) and x.words["云计算"][0] == x.middle
    assert x.words["李小福"][1] == "nr" and x.user_singles == {"杰"}
    assert x.remove("云计算") and not x.remove("云计算") and "李小福" in x.words
    with pytest.raises(ValueError):
        L.load_lexicon(["word 1"])


def test_other_files():
    assert L.load_idf(["a 1.0", "broken", "b 2.0"]) == ({"a": 1.0, "b": 2.0}, 1.0)
    assert L.load_stop_words(["的\n", "", "了"]) == {"的", "了"}
    with pytest.raises(ValueError):
        L.load_chain(["0 0 0 0"])


def test_ranges():
    assert C.ranges("a，b。 c") == ["a", "，", "b", "。", " ", "c"] and C.ranges("") == []


def test_cut_by_lexicon():
    x = L.load_lexicon(LINES)
    assert C.cut_by_lexicon(x, "南京市长江大桥") == ["南京市", "长江大桥"]
    assert C.cut_by_lexicon(x, "南京市长江大桥", 2) == ["南京", "市", "长江", "大桥"]
    assert C.cut_by_lexicon(x, "甲乙") == ["甲", "乙"] and C.cut_by_lexicon(x, "") == []


def test_cut_by_chain():
    assert C.cut_by_chain(chain(), "甲乙abc1 3.14丙") == ["甲乙", "abc1", " ", "3.14", "丙"]


def test_cut_mixed_full_and_for_queries():
    x = L.load_lexicon(LINES, ["乙"])
    assert C.cut_mixed(x, chain(), "南京甲丁") == ["南京", *C.cut_by_chain(chain(), "甲丁")]
    assert C.cut_mixed(x, None, "南京甲") == ["南京", "甲"]
    assert C.cut_full(x, "南京市长江大桥甲") == ["南京", "南京市", "市长", "长江", "长江大桥", "大桥", "甲"]
    assert C.cut_for_queries(x, None, "长江大桥") == ["长江", "大桥", "长江大桥"]


def test_tags():
    x = L.load_lexicon(LINES)
    assert [C.tag(x, w) for w in ("南京", "甲", "a", "abc", "123", "1a2b")] == ["ns", "x", "x", "eng", "m", "eng"]


def test_offsets():
    assert C.with_offsets(["南京", "a", "市"]) == [("南京", 0, 0, 2), ("a", 6, 2, 1), ("市", 7, 3, 1)]


def test_text_rank():
    assert K.rank_words(["单", "字"]) == [] and K.rank_words(["only"]) == [("", 0.0, [0])]
    ranked = K.rank_words(["aa", "bb", "cc", "aa", "dd"], top=2)
    assert ranked[0][0] == "aa" and ranked[0][1] == pytest.approx(1.0) and ranked[0][2] == [0, 6]


def test_tables(spark):
    s = C.Segmenter(L.load_lexicon(LINES))
    texts = spark.createDataFrame([(1, "南京市长江大桥，南京"), (2, None), (3, "")], "id long, text string")
    assert {r["id"]: r["words"] for r in K.segmented(texts, s).collect()} == {1: ["南京市", "长江大桥", "，", "南京"], 2: None, 3: []}
    words = K.located(texts, s)
    assert [(r["word"], r["offset"], r["tag"]) for r in words.orderBy("offset").collect()] == [("南京市", 0, "ns"), ("长江大桥", 9, "ns"), ("，", 21, "x"), ("南京", 24, "ns")]
    idf = spark.createDataFrame([("南京", 5.0)], "word string, idf double")
    stop = spark.createDataFrame([("南京市",)], "word string")
    got = [(r["word"], r["weight"], r["offsets"]) for r in K.tf_idf(words, idf, 2.0, stop, 5).orderBy("weight").collect()]
    assert got == [("长江大桥", 2.0, [9]), ("南京", 5.0, [24])]
    assert K.text_rank(K.segmented(texts, s)).where("id = 1").count() == 3


def test_wordpiece():
    v = {t: k for k, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "中", "文", "!", "a", "##b"])}
    t = WordPiece(v)
    assert t.tokens("unaffable 中文!ab") == ["un", "##aff", "##able", "中", "文", "!", "a", "##b"]
    assert t.tokens("[SEP]a [x") == ["[SEP]", "a", "[UNK]", "[UNK]"] and t.tokens(None) == []
    assert t.ids("中") == [2, 7, 3] and t.ids("中 文 a a", 4) == [2, 7, 8, 102]
    assert WordPiece(v, longest=5).tokens("中中") == ["中", "中"] and WordPiece(v, longest=3).tokens("unaff") == ["[UNK]"]
    assert padded([2, 7, 3], 5) == ([2, 7, 3, 0, 0], [1, 1, 1, 0, 0], [0] * 5)
