"""Steps whose work grows with their input: nothing grows by copies, no pair is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.operators import chapters as ch
from clipmine.operators import intervals as iv
from clipmine.operators import mining as mi
from clipmine.operators import reports as rp
from clipmine.sources import config


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mid_word_cuts_copies_no_array(spark):
    """ends of lines and tokens are running sums, not arrays that grow by one copy an element."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(40):
        parts = ["x" * rng.randint(0, 9) for _ in range(rng.randint(1, 7))]
        tokens = ["t" * rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        rows.append(("v", i, r"\N".join(parts), tokens))
        ends = lambda xs: [sum(map(len, xs[:k])) for k in range(len(xs) + 1)]
        p, t = ends([x for x in parts if x]), ends([x for x in tokens if x])
        cut = sum(any(t[k] < b < t[k + 1] for b in p[1:-1]) for k in range(len(t) - 1))
        want[i] = cut if len(parts) > 1 and len(p) >= 3 and len(t) >= 2 else 0
    got = rp.mid_word_cuts(spark.createDataFrame(rows, "vod_id string, clip_id long, text string, tok array<string>"), "tok")
    assert {r.clip_id: r.mid_word_cuts for r in got.collect()} == want and sum(want.values()) > 20
    assert "aggregate(" not in plan(got)


def test_an_alias_meets_a_url_once(spark):
    """an id that is listed many times keeps its first alias before the join."""
    urls = spark.createDataFrame([("x/abcdef?y",), ("x/ghijkl/abcdef",), ("none",)], "url string")
    known = spark.createDataFrame([(i, "abcdef", f"a{i}") for i in range(5, 100)] + [(7, "ghijkl", "g")], "ord long, video_id string, alias string")
    got = config.alias_of(urls, known)
    assert {r.url: r.alias for r in got.collect()} == {"x/abcdef?y": "a5", "x/ghijkl/abcdef": "a5", "none": None}
    assert "Aggregate [video_id" in plan(got)


def test_references_meet_windows_in_a_row(spark):
    """pairs of characters are never exploded."""
    seg = spark.createDataFrame([("v", i, i * 3.0, i * 3.0 + 3, t) for i, t in enumerate(["hello", "there", "who", "are", "you"])], "vod_id string, seg_id long, start double, end double, text string")
    ref = spark.createDataFrame([("v", 1, "there", 3.0), ("v", 2, "zzz", 3.0)], "vod_id string, ref_id long, ref_text string, ref_dur double")
    got = mi.align_reference(seg, ref, step=3.0)
    assert {(r.ref_id, r.start, r.score) for r in got.collect()} == {(1, 3.0, 1.0), (2, 0.0, 0.0)}
    assert "gram" not in plan(got)


def test_windows_are_cut_in_their_rows(spark):
    """the cuts of a window are merged as an array; there is no window function over pairs."""
    rng, cuts, want = random.Random(8), [], []
    for w in range(20):
        c = [(a := rng.uniform(-5, 55), a + rng.uniform(0, 9)) for _ in range(rng.randint(0, 6))]
        cuts += [("v", w, a, b) for a, b in c]
        kept = sorted((round(max(0, a), 3), round(min(50, b), 3)) for a, b in c if min(50, b) - min(50, max(0, a)) >= 0.05)
        at = 0.0
        for a, b in [*kept, (50.0, 50.0)]:
            if a - at >= 0.05:
                want.append((w, at, a))
            at = max(at, b)
    keys = ["vod_id", "clip_id"]
    windows = spark.createDataFrame([("v", w, 50.0) for w in range(20)], "vod_id string, clip_id long, dur double")
    got = iv.complement(windows, iv.clamp_cuts(spark.createDataFrame(cuts, "vod_id string, clip_id long, start double, end double"), windows, keys), keys)
    assert sorted((r.clip_id, r.start, r.end) for r in got.collect()) == sorted(want)
    assert "Window [" not in plan(got)


def test_places_of_pairs_are_numbers(spark):
    """the first place of a pair is counted by hash; blocks take their pairs from arrays."""
    seg = spark.createDataFrame([("v", i, i * 60.0, i * 60.0 + 50, "abab cd"[: 2 + i]) for i in range(5)], "vod_id string, seg_id long, start double, end double, text string")
    vods = spark.createDataFrame([("v", 300.0)], "vod_id string, duration_sec double")
    chapters = ch.topic_chapters(seg, vods)
    got = ch.chapter_titles(seg, chapters, char_class="a-z")
    assert [r.title for r in got.collect()][0].startswith("ab") and "collect_set" not in plan(chapters)
    assert "min(struct" not in plan(got) and "first" in plan(got)


@pytest.mark.parametrize("words", [["a", "b", "c", "a", "b"], ["ab", "", "c", "ab"], ["\n", "a", "b"], ["x"], []])
def test_marks_stand_at_their_places(spark, words):
    """words of one character are marked and written without slots; others as before."""
    made = spark.createDataFrame([([(w, i == 0, None) for i, w in enumerate(words)],)], "w array<struct<text:string,is_kw:boolean,color:string>>")
    plain, hit = "".join(words), set()
    for k in ("ab", "bc"):
        at = plain.find(k)
        while at >= 0:
            hit |= set(range(at, at + len(k)))
            at = plain.find(k, at + len(k))
    starts = [sum(map(len, words[:i])) for i in range(len(words))]
    want = [i == 0 or any(p in hit for p in range(s, s + len(w))) for i, (s, w) in enumerate(zip(starts, words))]
    marked = made.select(tx.mark_keywords("w", ["ab", "bc"]).alias("m"))
    assert [w.is_kw for w in marked.first().m] == want and "zip_with" in plan(marked)
    text, flag = "", [k and w != "\n" for k, w in zip(want, words)]
    for i, w in enumerate(words):
        if w:
            text += "\\n" if w == "\n" else ("**" if flag[i] and not (i and flag[i - 1]) else "") + w + ("**" if flag[i] and not (i + 1 < len(words) and flag[i + 1]) else "")
    if "" not in words:
        assert marked.select(tx.to_markup("m").alias("t")).first().t == text
        assert [w.text for w in made.select(tx.parse_markup(F.lit("a**b\r**\\n"))).first()[0]] == ["a", "b", "\n"]


def test_cuts_shuffle_a_clip_once(spark):
    """a clip meets its voice in one cell; it is not repeated for bins and not grouped again."""
    import re

    from clipmine.operators import edit as ed
    from clipmine.operators import joins as jn

    rng = random.Random(3)
    at = lambda n: (a := rng.uniform(0, 900), a + rng.uniform(0, n))
    clips = spark.createDataFrame([("v", i, *at(300)) for i in range(60)], "vod_id string, clip_id long, start double, end double")
    voice = spark.createDataFrame([("v", *at(40)) for _ in range(50)] + [("v", 0.0, 5000.0)], "vod_id string, start double, end double")
    near = jn.near_spans(clips, voice, order=["start", "end"], out="v").collect()
    want = jn.gather_spans(clips, voice, ids=["clip_id"], out="v").collect()
    assert {r.clip_id: r.v for r in near} == {r.clip_id: r.v for r in want} and sum(len(r.v) for r in near) > 100
    cuts = ed.plan_cuts(clips, voice)
    assert cuts.count() and not re.search(r"Aggregate \[vod_id#\d+, clip_id#", plan(cuts))
