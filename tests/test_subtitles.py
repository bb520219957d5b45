"""Line breaks, word groups and event timing."""

import random

import pytest
from pyspark.sql import functions as F

from clipmine.functions.tokens import dictionary_tokenizer
from clipmine.operators import cues as cu
from clipmine.operators import subtitles as st

KEYS = ["vod_id", "clip_id"]
WORD = "vod_id string, clip_id long, seg_id long, pos int, start double, end double, text string"
PIECE = "vod_id string, clip_id long, place long, start double, end double, text string"


@pytest.fixture(scope="module")
def lines(spark):
    def split(texts, **kw):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        tokens = kw.pop("tokenize", None)
        return [r.x for r in df.select("i", st.split_lines("text", tokens=tokens and tokens(F.col("text")), **kw).alias("x")).orderBy("i").collect()]

    return split


def test_lines_break_after_punctuation_and_keep_particles(lines):
    got = lines(["一二三四五六七八九十", "一二三，四五六七八", "一二三四五六七", " ", None, "一二三四，啊五六七八", "一二\\N三\n四", "一，二三四五六七八", "一二三四五六，七八九"])
    assert got[:5] == [["一二三四五六七", "八九十"], ["一二三，", "四五六七八"], ["一二三四五六七"], [], []]
    assert got[5:] == [["一二三四，啊", "五六七八"], ["一二三四"], ["一，二三四五六", "七八"], ["一二三四五六，", "七八九"]]


def test_no_text_is_lost(lines):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc ，。啊的", k=rng.randint(0, 60))) for _ in range(300)] + ["abc" * 20_000]
    for text, got in zip(texts, lines(texts), strict=True):
        assert "".join(got).replace(" ", "") == text.replace(" ", "") and all(0 < len(x) <= st.MAX_LINE + 1 for x in got)


def test_lines_do_not_cut_tokens(lines):
    tokenize = dictionary_tokenizer(["今天天氣", "真的很好", "出去玩"])
    assert lines(["我們今天天氣真的很好出去玩"], tokenize=tokenize) == [["我們今天天氣", "真的很好出去玩"]]
    assert lines(["我們今天天氣啊真的很好出去玩"], tokenize=tokenize) == [["我們今天天氣啊", "真的很好出去玩"]]
    # a word longer than a line is cut all the same
    assert lines(["x" * 10], tokenize=dictionary_tokenizer(["x" * 10])) == [["xxxxxxx", "xxx"]]


def test_longest_token_wins(spark):
    df = spark.createDataFrame([("abcd",), ("",), (None,), ("ab",)], "t string")
    got = [r.x for r in df.select(dictionary_tokenizer(["ab", "abc", "cd", ""])("t").alias("x")).collect()]
    assert got == [["abc", "d"], [], [], ["ab"]]


def pieces_of(spark, clips):
    rows = [("v", c, 0, i, a, b, t) for c, words in clips.items() for i, (a, b, t) in enumerate(words)]
    out = st.word_pieces(spark.createDataFrame(rows, WORD), KEYS).orderBy("clip_id", "place").collect()
    return {c: [(r.start, r.end, r.text) for r in out if r.clip_id == c] for c in clips}


def test_words_are_grouped(spark):
    tenth = lambda text: [(i * 0.1, i * 0.1 + 0.1, c) for i, c in enumerate(text)]
    clips = {
        1: tenth("一二三四五六七八九十甲乙丙丁戊己"),
        2: [(0.0, 0.2, "a"), (1.0, 1.2, "b")],
        3: tenth("一二，三四五六七八九十甲乙丙"),
        4: [(0.0, 2.0, "abcdefghijklmnopqrstuvw")],
        5: [(0.0, 1.0, "a"), (1.0, 2.0, "b"), (2.0, 3.0, "c")],
        6: tenth("完。再"),
        7: tenth("一二三四五六，七八"),
    }
    got = pieces_of(spark, clips)
    for c, words in clips.items():
        assert "".join(t.replace(st.BREAK, "") for *_, t in got[c]) == "".join(t for *_, t in words)
        assert all(len(t.split(st.BREAK)) <= st.MAX_LINES for *_, t in got[c])
        assert all(a[1] <= b[0] + st.ONSET_LEAD for a, b in zip(got[c], got[c][1:])) and got[c][-1][1] == words[-1][1]
    assert [len(got[c]) for c in (2, 5, 6, 7)] == [2, 2, 2, 2] and len(got[1]) == 2 and len(got[4]) > 1


def test_timing_invariants(spark):
    rng = random.Random(2)
    pieces, speech = [], []
    for c in range(100):
        t = 0.0
        for i in range(12):
            t += rng.uniform(0.05, 2.0)
            pieces.append(("v", c, i, t, t + rng.uniform(0.05, 4.0), f"字{i}"))
        speech += [("v", c, k * 3.0, k * 3.0 + rng.uniform(0.2, 2.5)) for k in range(10 if c % 5 else 0)]
    out = st.timed(spark.createDataFrame(pieces, PIECE), spark.createDataFrame(speech, "vod_id string, clip_id long, start double, end double"), KEYS)
    rows = out.orderBy("clip_id", "ord").collect()
    assert len(rows) == len(pieces)  # nothing is dropped for lack of voice
    for a, b in zip(rows, rows[1:]):
        assert a.clip_id != b.clip_id or (b.start >= a.end + st.GAP_PAD - 1e-9 and b.ord == a.ord + 1)
    assert all(st.FLASH_SEC - 1e-9 <= r.end - r.start <= st.MAX_SEC + 1e-9 for r in rows)


def test_short_pieces_join_a_close_neighbour(spark):
    rows = [("v", 1, 0, 0.0, 0.5, "一二"), ("v", 1, 1, 0.6, 1.0, "三四"), ("v", 1, 2, 1.4, 1.8, "五"), ("v", 1, 3, 1.9, 4.0, "一二三四五六七\\N八九十一二三四"), ("v", 1, 4, 4.1, 4.2, "x")]
    out = st.merged_short(spark.createDataFrame(rows, PIECE), KEYS).orderBy("place").collect()
    assert [(r.start, r.end, r.text) for r in out] == [(0.0, 1.0, "一二三四"), (1.4, 1.8, "五"), (1.9, 4.0, "一二三四五六七\\N八九十一二三四"), (4.1, 4.2, "x")]


def test_events_need_no_python(spark):
    seg = spark.createDataFrame([], "vod_id string, clip_id long, seg_id long, start double, end double, text string, words array<struct<start: double, end: double, text: string>>")
    out = cu.subtitle_events(seg, spark.createDataFrame([], "vod_id string, clip_id long, start double, end double"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and out.count() == 0
