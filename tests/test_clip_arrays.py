"""Cues of a clip come together once, as arrays: no cue is joined with another one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clipmine.operators import cues as cu
from clipmine.operators import intervals as iv
from clipmine.plans.clips import rebuild_cues, reproject_cues

CUE = "vod_id string, clip_id long, cue_id string, start double, end double, vod_start double, vod_end double, text string"


def cues(spark, seed, n, clips=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.uniform(0, 90)
        b = a + rng.uniform(1, 20)
        at = (a, b) if i % 4 else (None, None)
        rows.append(("v", i % clips, f"c{seed}-{i}", a, b, *at, rng.choice("abcdefgh")))
    return spark.createDataFrame(rows, CUE), rows


def joins(df):
    return re.findall(r"(?:SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[([^\]]*)\]", df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())


def test_missing_cues_pairs_nothing(spark):
    fresh, f = cues(spark, 1, 60)
    old, o = cues(spark, 2, 40, clips=3)

    def missing(c):
        if c[5] is None:
            return c[7] not in {x[7] for x in o if x[1] == c[1]}
        shared = sum(max(0.0, min(c[6], x[6]) - max(c[5], x[5])) for x in o if x[1] == c[1] and x[5] is not None)
        return shared / (c[6] - c[5]) < 0.35

    got = cu.missing_cues(fresh, old)
    assert {r.cue_id for r in got.collect()} == {c[2] for c in f if missing(c)}
    assert not any("_bin" in j for j in joins(got)) and got.columns == fresh.columns


@pytest.mark.parametrize("kind", ["rebuild", "reproject"])
def test_whole_clips_meet(spark, kind):
    old, _ = cues(spark, 2, 40)
    seg = spark.createDataFrame([("v", i, i * 3.0, i * 3.0 + 5, "hello **you**") for i in range(30)], "vod_id string, ord long, start double, end double, text string")
    clips = spark.createDataFrame([("v", i, 1, 10.0 * i, 10.0 * i + 40) for i in range(5)], "vod_id string, clip_id long, ord int, start double, end double")
    axis = iv.keep_axis(clips)
    out = rebuild_cues(old, axis, seg, ["ell"]) if kind == "rebuild" else reproject_cues(old, axis, axis, seg, ["ell"])
    assert not any("cue_id" in j or "clip_id" in j and "_bin" in j for j in joins(out))
    assert out.where(F.col("text").contains("h**ell**o **you**")).count() > 20 and out.columns
