"""Interval operators against literal folds on random data."""

import random

import pytest
from pyspark.sql import functions as F

from clipmine.operators import edit as ed
from clipmine.operators import intervals as iv
from clipmine.operators import joins as jn
from clipmine.operators import signals as sg

SPAN = "vod_id string, clip_id int, start double, end double"


def random_spans(rng, n, horizon, longest):
    out = []
    for _ in range(n):
        s = round(rng.uniform(0, horizon), 2)
        out.append((s, round(s + rng.uniform(0.01, longest), 2)))
    return out


def merged(spans, gap):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0.35, 0.2, 0.0])
def test_merge(spark, gap):
    rng = random.Random(7)
    data = {f"v{k}": random_spans(rng, 60, 60 + 40 * k, 1.5) for k in range(6)}
    df = spark.createDataFrame([(v, s, e) for v, xs in data.items() for s, e in xs], "vod_id string, start double, end double")
    got = {}
    for r in iv.merge_intervals(df, gap).collect():
        got.setdefault(r.vod_id, []).append((r.start, r.end))
    assert {k: sorted(x) for k, x in got.items()} == {k: merged(x, gap) for k, x in data.items()}


def literal_cuts(start, end, voice, silence, pad):
    """Walk the voice in order, opening a piece after each long silence."""
    inside = [(max(start, s), min(end, e)) for s, e in voice if e > start and s < end]
    inside = [x for x in inside if x[1] - x[0] > 0.05]
    if not inside:
        return [(start, end)]
    pieces = []
    for s, e in inside:
        if not pieces:
            pieces.append([max(start, s - pad) if s - start >= silence else start, min(end, e + pad)])
        elif s - pad <= pieces[-1][1] + 0.05:
            pieces[-1][1] = max(pieces[-1][1], min(end, e + pad))
        else:
            pieces.append([s - pad, min(end, e + pad)])
    return [tuple(p) for p in pieces]


def test_jump_cuts(spark):
    rng = random.Random(3)
    voice = merged(random_spans(rng, 120, 300, 2.0), 0.35)
    clips = [(i, s, e) for i, (s, e) in enumerate(random_spans(rng, 40, 300, 40.0))]
    v = spark.createDataFrame([("v", s, e) for s, e in voice], "vod_id string, start double, end double")
    c = spark.createDataFrame([("v", i, s, e) for i, s, e in clips], SPAN)
    got = {}
    for r in ed.jump_cuts(c, v).orderBy("clip_id", "ord").collect():
        got.setdefault(r.clip_id, []).append((r.start, r.end))
    for i, s, e in clips:
        want = literal_cuts(s, e, voice, 0.45, 0.12)
        assert len(got[i]) == len(want)
        assert [x for p in got[i] for x in p] == pytest.approx([x for p in want for x in p])


def test_cut_goldens(spark):
    v = spark.createDataFrame([("v", 10.0, 12.0), ("v", 14.0, 16.0), ("v", 18.5, 20.0)], "vod_id string, start double, end double")
    c = spark.createDataFrame([("v", 1, 10.0, 20.0)], SPAN)
    assert ed.plan_cuts(c, v).count() == 3
    late = spark.createDataFrame([("v", 10.3, 15.0)], "vod_id string, start double, end double")
    c = spark.createDataFrame([("v", 1, 10.0, 15.0)], SPAN).withColumn("ord", F.lit(1))
    first = ed.plan_cuts(c, late).first()
    assert first.start >= 10.2


@pytest.mark.parametrize("split", [False, True])
def test_points_and_spans_in_windows(spark, split):
    rng = random.Random(5)
    pts = [(i, 42.0 if i % 3 == 0 else round(rng.uniform(0, 400), 3)) for i in range(300)]  # a third in one instant
    win = [(i, s, e) for i, (s, e) in enumerate(random_spans(rng, 40, 400, 150.0))]
    p = spark.createDataFrame([("v", i, t) for i, t in pts], "vod_id string, seq int, t double")
    w = spark.createDataFrame([("v", i, s, e) for i, s, e in win], SPAN)
    kw = {"spread": ("seq",), "min_rows": 5, "share": 0.01} if split else {}
    got = {(r.seq, r.w_clip_id) for r in jn.points_in_windows(p, w, **kw).collect()}
    assert got == {(i, k) for i, t in pts for k, s, e in win if s <= t < e}
    spans = [(i, s, e) for i, (s, e) in enumerate(random_spans(rng, 80, 400, 200.0))]
    sdf = spark.createDataFrame([("v", i, s, e) for i, s, e in spans], "vod_id string, seq int, start double, end double")
    rows = [(r.seq, r.w_clip_id) for r in jn.overlapping_spans(sdf, w, **kw).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(i, k) for i, a, b in spans for k, s, e in win if b > s and a < e}


def test_hot_keys_are_few(spark):
    from clipmine.operators.skew import hot_keys

    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(df, ["k"], share=0.01, min_rows=10).collect()
    assert [(r.k, r._splits) for r in hot] == [(0, 34)]


def test_range_joins_plan_no_nested_loop(spark):
    p = spark.range(100).selectExpr("'v' AS vod_id", "id AS seq", "CAST(id AS DOUBLE) AS t")
    w = spark.range(10).selectExpr("'v' AS vod_id", "id AS clip_id", "CAST(id AS DOUBLE) AS start", "CAST(id + 5 AS DOUBLE) AS end")
    plan = jn.points_in_windows(p, w, spread=("seq",))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_thinning(spark):
    rng = random.Random(11)
    ts = sorted({round(rng.uniform(0, 500), 1) for _ in range(200)})
    kept = []
    for t in ts:
        if not kept or t - kept[-1] >= 8.0:
            kept.append(t)
    got = sg.thin_by_gap(spark.createDataFrame([("v", t) for t in ts], "vod_id string, t double"), 8.0)
    assert sorted(r.t for r in got.collect()) == kept


def test_axis_goldens(spark):
    cuts = spark.createDataFrame([("v", 1, 0, 10.0, 20.0), ("v", 1, 1, 25.0, 30.0)], "vod_id string, clip_id int, ord int, start double, end double")
    axis = iv.keep_axis(cuts)
    pts = spark.createDataFrame([("v", 1, 12.0), ("v", 1, 26.0), ("v", 1, 22.0)], "vod_id string, clip_id int, t double")
    assert {r.t: r.short_t for r in iv.to_short(pts, axis).collect()} == {12.0: 2.0, 26.0: 11.0, 22.0: None}
    assert iv.to_vod(pts.limit(1).withColumn("t", F.lit(10.0)), axis).first().vod_t == 25.0
    w = spark.createDataFrame([("v", 1, 10.0)], "vod_id string, clip_id int, dur double")
    c = spark.createDataFrame([("v", 1, 4.0, 5.0)], SPAN)
    left = iv.complement(w, c, ["vod_id", "clip_id"])
    order = spark.createDataFrame([("v", 1, [1, 0])], "vod_id string, clip_id int, play_order array<int>")
    got = [(r.start, r.end) for r in iv.play_order(left, order).orderBy("ord").collect()]
    assert got == [(5.0, 10.0), (0.0, 4.0)]


def test_voice_modes(spark):
    from clipmine.plans.voice import voice_intervals

    seg = spark.createDataFrame([("v", 1, 0.0, 2.0, "a"), ("v", 2, 5.0, 7.0, "b")], "vod_id string, seg_id int, start double, end double, text string")
    en = spark.createDataFrame([("v", 0.0, 2.2), ("v", 2.5, 4.8), ("v", 5.0, 10.0)], "vod_id string, start double, end double")
    got = sorted((r.start, r.end) for r in voice_intervals(seg, en).collect())
    assert got == [(0.0, 2.2), (5.0, 10.0)]


def test_roi_smoothing(spark):
    rows = [("v", 0.0, 0.5, 0.4, True), ("v", 1.0, 0.52, 0.4, True), ("v", 2.0, 0.8, 0.4, True), ("v", 3.0, 0.1, 0.1, False)]
    s = sg.smooth_roi(spark.createDataFrame(rows, "vod_id string, t double, cx double, cy double, hit boolean"), ["vod_id"], smooth=1.0)
    assert [round(r.cx, 3) for r in s.orderBy("t").collect()] == [0.5, 0.5, 0.8, 0.8]
