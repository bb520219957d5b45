"""Peaks picked per clip against a plain loop; plans that broadcast no exploded rows; numbers as text; ties."""

import random

from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.operators import events as ev
from clipmine.operators import mining as mi
from clipmine.operators import reports as rp
from clipmine.operators.joins import points_in_windows

EMOTION = "vod_id string, peak_id long, t double, score double, kind string"
CUTS = "vod_id string, clip_id long, ord int, start double, end double"


def tables(spark):
    rng = random.Random(5)
    peaks = [("v", i, round(rng.uniform(0, 200), 1), rng.choice([2.6, 3.1, 3.5, 4.2, 5.0]), rng.choice(["laugh", "scream", "burst"])) for i in range(300)]
    cuts = []
    for c in range(12):
        a = rng.uniform(0, 150)
        b = a + rng.uniform(0.1, 40)
        cuts += [("v", c, 1, a, b), ("v", c, 2, b, b + rng.uniform(0.1, 10))]
    cuts.append(("w", 99, 1, 3.0, 9.0))
    return peaks, cuts, spark.createDataFrame(peaks, EMOTION), spark.createDataFrame(cuts, CUTS)


def held(peaks, cuts, clip):
    """Each peak of a clip with the first cut that holds it, strongest first."""
    out = []
    for _, pid, t, score, kind in peaks:
        for v, c, o, a, b in cuts:
            if v == "v" and c == clip and a <= t <= b:
                out.append((-score, t, pid, a, b, kind, sum(e - s for v2, c2, o2, s, e in cuts if c2 == c and o2 < o)))
                break
    return sorted(out)


def around(t, a, b, span):
    hi = min(b, max(a, t - span / 2) + span)
    return max(a, hi - span), hi


def test_punch_windows_as_a_loop(spark):
    peaks, cuts, e, c = tables(spark)
    want = []
    for clip in {x[1] for x in cuts}:
        taken = []
        for _, t, _, a, b, _, _ in held(peaks, cuts, clip):
            lo, hi = around(t, a, b, 0.8)
            if hi - lo >= 0.25 and len(taken) < 3 and all(hi < x - 0.35 or lo > y + 0.35 for x, y in taken):
                taken.append((lo, hi))
        if not taken:
            (a, b), found = next((x[3:] for x in cuts if x[1] == clip and x[2] == 1)), held(peaks, cuts, clip)
            taken = [around(found[0][1], found[0][3], found[0][4], 0.8) if found else (max(a, b - 0.8), b)]
        want += [(clip, round(lo, 6), round(hi, 6)) for lo, hi in taken]
    for bin_sec in (5.0, 60.0):
        got = [(r.clip_id, round(r.start, 6), round(r.end, 6)) for r in ev.punch_windows(e, c, bin_sec=bin_sec).collect()]
        assert sorted(got) == sorted(want)


def test_shakes_as_a_loop(spark):
    peaks, cuts, e, c = tables(spark)
    want = []
    for clip in {x[1] for x in cuts}:
        taken = []
        for less, t, _, a, _, kind, off in held(peaks, cuts, clip):
            at, gap = off + (t - a), max(1.0, max(0.55, min(1.4, 0.5 - 0.15 * less)) * 0.9)
            if kind != "burst" and len(taken) < 3 and all(abs(at - x) >= gap for x in taken):
                taken.append(at)
        want += [(clip, round(x, 2)) for x in taken]
    got = [(r.clip_id, round(r.t, 2)) for r in ev.plan_shakes(e, c).collect()]
    assert len(got) == len(want) and all(abs(g[1] - w[1]) < 0.011 for g, w in zip(sorted(got), sorted(want)))


def test_exploded_rows_are_not_broadcast(spark):
    _, _, e, c = tables(spark)
    for df in (points_in_windows(e, c), ev.punch_window(e, c), ev.punch_windows(e, c), ev.plan_shakes(e, c)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_fixed_as_printf(spark):
    rng = random.Random(3)
    xs = [0.0, 0.005, 0.015, 0.025, 0.125, 0.375, 2.675, 0.995, 0.9999, 1.005, 9.5, 1e-9, 123456.785, 2.0**53] + [rng.random() * 10 ** rng.randint(-3, 5) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[tx.fixed("x", d).alias(f"d{d}") for d in (1, 2, 3)])
    for r in df.collect():
        assert [r.d1, r.d2, r.d3] == [f"{r.x:.{d}f}" for d in (1, 2, 3)]


def test_equal_distances_take_the_smaller_id(spark):
    aligned = spark.createDataFrame([("v", 1, 0.0, 0.3, 1.0)], "vod_id string, ref_id long, start double, end double, score double")
    # 0.1 + 0.2 from both, one of them a last digit above.
    h = spark.createDataFrame([("v", 2, 0.3, 0.3), ("v", 0, 0.1, 0.5)], "vod_id string, id long, start double, end double")
    assert abs(0.1 + abs(0.5 - 0.3)) != 0.3
    assert mi.nearest_highlight(aligned, h, tolerance=1.0).select(F.col("highlight_id")).first()[0] == 0


def test_halves_of_seconds_left_are_exact(spark):
    jobs = spark.createDataFrame([("a", "running", 10.0, False, 0.0)], "job_id string, status string, duration_sec double, allow_cpu boolean, last_activity double")
    done = spark.createDataFrame([("a", s, "done", None) for s in rp.STEPS[:3]], "job_id string, step string, status string, error string")
    # 350 s in all, times 2.15: 752.5; the sum in doubles lies above it in every order of the steps.
    lengths = [152.83, 133.88, 63.29]
    clips = spark.createDataFrame([("a", i, 0.0, x) for i, x in enumerate(lengths)], "job_id string, id long, start double, end double").coalesce(1)
    none = spark.createDataFrame([], "job_id string, step string")
    assert rp.job_progress(jobs, done, clips, none, now=0.0).first().eta_sec == 752.0
