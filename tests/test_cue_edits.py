"""Edits of old cues on fresh ones."""

import random

import pytest
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.operators import cue_edits as ce

KEYS = ["vod_id", "clip_id"]
CUE = "clip_id long, cue_id string, start double, end double, vod_start double, vod_end double, text string"


@pytest.fixture(scope="module")
def cues(spark):
    def make(rows, **styles):
        df = spark.createDataFrame(rows, CUE).withColumn("vod_id", F.lit("v")).withColumn("words", tx.parse_markup("text"))
        return df.withColumns({k: F.lit(v) for k, v in styles.items()})

    return make


def carried(spark, base, old, color=None):
    paint = F.transform("o", lambda w: F.struct(w["text"], w["is_kw"], F.when(w["is_kw"], F.lit(color)).alias("color")))
    df = spark.createDataFrame([(base, old)], "b string, o string").select(tx.parse_markup("b").alias("b"), tx.parse_markup("o").alias("o")).withColumn("o", paint)
    return df.select(ce.carried_marks("b", "o").alias("x")).select(tx.to_markup("x").alias("t"), "x.color").first()


def test_marks_follow_characters(spark):
    assert carried(spark, "abcd", "a**bc**d").t == "a**bc**d"
    assert carried(spark, "**a**bcd", "a**bc**d").t == "**abc**d"
    # another text: the first place of each flagged run
    assert carried(spark, "xbcybc", "a**bc**d").t == "x**bc**ybc"
    assert carried(spark, "xyz", "a**bc**d").t == "xyz" and carried(spark, "", "**a**").t == ""
    assert carried(spark, "zz草草b", "x**草草**y**b**").t == "zz**草草b**"
    assert carried(spark, "abcd", "a**bc**d", "#f00").color == [None, "#f00", "#f00", None]


def plain_matches(old, fresh):
    """Each fresh cue in order takes the free old one it shares the most time with."""
    order = lambda c: (c[2], c[1])
    used, out = set(), {}
    for f in sorted(fresh, key=order):
        best = None
        for o in sorted(old, key=order):
            n = min(f[5], o[5]) - max(f[4], o[4])
            if o[1] not in used and n >= 0.15 and (best is None or n > best[0]):
                best = (n, o[1])
        if best:
            used.add(best[1])
            out[f[1]] = best[1]
    return out


def test_an_old_cue_serves_once(spark, cues):
    rng = random.Random(3)
    old, fresh, want = [], [], {}
    for clip in range(30):
        def some(n, kind):
            at = [round(rng.uniform(0, 20), 2) for _ in range(n)]
            return [(clip, f"{kind}{i}", a, a + 1, a, a + round(rng.uniform(0.1, 4), 2), "t") for i, a in enumerate(at)]

        a, b = some(rng.randint(0, 12), "o"), some(rng.randint(0, 12), "f")
        old, fresh, want = old + a, fresh + b, want | {(clip, f): o for f, o in plain_matches(a, b).items()}
    got = {(r.clip_id, r.cue_id): r.old_id for r in ce.matches(cues(old), cues(fresh), KEYS).collect()}
    assert got == want and len(set((c, o) for (c, _), o in got.items())) == len(got)


def test_cues_without_times_match_by_text(cues):
    old = [(1, "a", 0.0, 1.0, None, None, "x"), (1, "b", 1.0, 2.0, None, None, "x"), (1, "c", 2.0, 3.0, 5.0, 5.0, "y"), (1, "d", 0.0, 1.0, None, None, "")]
    fresh = [(1, "p", 0.0, 1.0, None, None, "x"), (1, "q", 1.0, 2.0, None, None, "x"), (1, "r", 2.0, 3.0, None, None, "x"), (1, "s", 3.0, 4.0, None, float("nan"), "y"), (1, "t", 3.0, 4.0, None, None, "")]
    got = {r.cue_id: r.old_id for r in ce.matches(cues(old), cues(fresh), KEYS).collect()}
    assert got == {"p": "a", "q": "b", "s": "c"}


def test_edits_are_kept(cues):
    old = [(1, "a", 0.0, 1.0, 100.0, 101.0, "a**bc**d"), (1, "b", 2.0, 3.0, 102.0, 103.0, "hello you"), (2, "z", 0.0, 1.0, 0.0, 1.0, "only old")]
    fresh = [(1, "p", 0.0, 1.0, 100.1, 101.0, "abcd"), (1, "q", 2.0, 3.0, 102.0, 103.0, "hello yu"), (1, "r", 4.0, 5.0, 104.0, 105.0, "n**e**w"), (3, "s", 0.0, 1.0, 0.0, 1.0, "left as it is")]
    out = {r.cue_id: r for r in ce.merge_cue_edits(cues(old, size=7), cues(fresh), KEYS).collect()}
    assert {k: r.text for k, r in out.items()} == {"p": "a**bc**d", "q": "hello you", "r": "n**e**w", "s": "left as it is", "z": "only old"}
    assert [out[k]["size"] for k in "pqrsz"] == [7, 7, None, None, 7]
    assert "".join(w.text for w in out["q"].words) == "hello you"


def test_no_python(cues):
    out = ce.merge_cue_edits(cues([]), cues([]), KEYS)
    assert "Python" not in out._jdf.queryExecution().toString() and out.count() == 0
