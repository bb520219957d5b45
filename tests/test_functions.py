"""Known values of the column functions."""

import pytest
from pyspark.sql import functions as F

from clipmine.functions import spans as sp
from clipmine.functions import text as tx
from clipmine.functions import timecode as tc


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


def test_keyword_hits_and_dictionary(one):
    assert one(tx.keyword_hits(F.lit("笑死草草"), ["草", "笑死"])) == 3
    assert one(tx.keyword_hits(F.lit("aaaaa"), ["AA"])) == 2
    assert one(tx.replace_words(F.lit("安安草"), {"草": "www", "安安": "你好"})) == "你好www"


def test_times(one):
    assert one(tc.srt_timestamp(F.lit(1.5))) == "00:00:01,500"
    assert one(tc.centisecond_timestamp(F.lit(3661.507))) == "1:01:01.51"
    assert one(tc.parse_timestamp(F.lit("01:02:03.5"))) == 3723.5
    assert one(tc.parse_timestamp(F.lit("x"))) is None
    assert one(tc.stream_date(F.lit("20260102"))) == "2026/1/2"
    assert one(tc.stream_date(F.lit(None), F.lit("2026-08-12T00:00:00"))) == "2026/8/12"
    assert one(tc.stream_date(F.lit("x"))) == "--/-/--"


@pytest.mark.parametrize("t,n", [(0.0, 0), (1.0, 1), (3600.0, 1), (3600.1, 2), (9000.0, 3)])
def test_hour_count(one, t, n):
    assert one(sp.hour_count(F.lit(t))) == n


def test_title_types_and_errors(one):
    assert one(tx.stream_type(F.lit("深夜雜談來聊天"))) == "talk"
    assert one(tx.stream_type(F.lit("Minecraft 生存"))) == "game"
    assert one(tx.stream_type(F.lit("hello"))) == "unknown"
    assert one(tx.chat_error_kind(F.lit("timed out"))) == "timeout"
    assert one(tx.chat_error_kind(F.lit("chat not found"))) == "no_chat"
    assert one(tx.video_id(F.lit("https://x.y/watch?v=abc&t=1"))) == "abc"
    assert one(tx.title(F.lit("  \n"))) == "精華片段"
    assert one(tx.slug(F.lit(" Ab c!"))) == "ab_c"


def test_markup_round_trip(one):
    words = one(tx.parse_markup(F.lit("a**bc**d\\ne")))
    assert [(w.text, w.is_kw) for w in words] == [("a", False), ("b", True), ("c", True), ("d", False), ("\n", False), ("e", False)]
    assert one(tx.to_markup(tx.parse_markup(F.lit("a**bc**d\\ne")))) == "a**bc**d\\ne"
    marked = one(tx.mark_keywords(tx.parse_markup(F.lit("ab草草c")), ["草草", "b"]))
    assert [w.is_kw for w in marked] == [False, True, True, True, False]


def test_keywords_of_a_long_line(one):
    line = F.repeat(F.lit("abcde草草x "), 6000)
    marked = one(F.transform(tx.mark_keywords(tx.parse_markup(line), ["草草", "cd"]), lambda w: w["is_kw"]))
    assert marked == [False, False, True, True, False, True, True, False, False] * 6000


def test_spans_in_text(one):
    k = one(tx.key_span(F.lit("這個笑死"), ["笑死"]))
    assert (k.offset, k.frag, k.kind) == (2, "笑死", "tail")
    assert one(tx.key_span(F.lit("的了嗎"), ["的"], F.array(F.lit("的")))) is None
    assert one(tx.key_span(F.lit("ab cde"), [], F.split(F.lit("ab cde"), " "))).frag == "cde"
    assert one(tx.wrap_span(F.lit("ab\\Ncd"), F.lit(1), F.lit("bc"), "<", ">")) == "a<b\\Nc>d"
    assert one(tx.is_noise(F.lit("。。 !"))) and not one(tx.is_noise(F.lit("a")))


def test_bigrams(one):
    assert sorted(one(tx.bigrams(F.lit("abab")))) == ["ab", "ba"]
    assert one(tx.bigrams(F.lit("a"))) == [] and one(tx.bigrams(F.lit("a"), keep_single=True)) == ["a"]
    assert one(tx.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5


def test_profiles():
    from clipmine.lexicon import GAME, TALK

    assert TALK.emphasis_keywords() == ["笑死", "太扯", "完蛋", "哭啊", "幹嘛", "爆笑"]
    assert "爆笑" in GAME.emphasis_keywords() and GAME.w_emotion == 1.5
