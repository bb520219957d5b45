"""Pairs of windows and spans against a plain loop; nothing that follows the range join is shuffled."""

import random

from pyspark.sql import functions as F

from clipmine.operators import cues as cu
from clipmine.operators import intervals as iv
from clipmine.operators import joins as jn

SEGMENTS = "vod_id string, seg_id long, start double, end double, text string"
CLIPS = "vod_id string, clip_id long, start double, end double"


def tables(spark):
    rng = random.Random(7)
    segs = []
    for i in range(400):
        a = round(rng.uniform(0, 900), 1)
        segs.append((rng.choice("ab"), i, a, round(a + rng.choice([0.0, 0.5, 7.0, 60.0, 130.0]), 1), rng.choice([f" {i},", f"{i};", " "])))
    clips = []
    for c in range(80):
        a = rng.choice([round(rng.uniform(0, 900), 1), 60.0 * rng.randint(0, 14)])
        clips.append((rng.choice("abc"), c, a, a + rng.choice([0.0, 0.1, 59.9, 60.0, 120.0, 120.1, 240.0, 700.0])))
    return segs, clips, spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(clips, CLIPS)


def above_join(df):
    """The plan's lines above its topmost join."""
    return df._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_window_text_as_a_loop(spark):
    segs, clips, s, c = tables(spark)
    want = {}
    for v, cid, a, b in clips:
        text = "".join(t.strip() for w, _, x, y, t in segs if w == v and y > a and x < b)
        if text:
            want[cid] = text
    got = jn.window_text(s, c, ids=["clip_id"])
    assert {r.clip_id: r.text for r in got.collect()} == want and len(want) > 40
    assert jn.window_text(s, c.limit(0), ids=["clip_id"]).count() == 0


def test_window_text_shuffles_no_pairs(spark):
    _, _, s, c = tables(spark)
    assert "Exchange" not in above_join(jn.window_text(s, c, ids=["clip_id"]))


def test_axes_come_with_the_clips(spark):
    """Cues of a range join keep the axis of their clip: same rows as with a join per cue, and no shuffle after the join."""
    _, _, s, c = tables(spark)
    pieces = c.select("vod_id", "clip_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), "start", (F.col("start") + 20.0).alias("end")), F.struct(F.lit(2).alias("ord"), (F.col("start") + 25.0).alias("start"), "end"))).alias("p"))
    axis = iv.keep_axis(pieces.select("vod_id", "clip_id", "p.*"))

    def cues(clips):
        p = jn.overlapping_spans(s, clips)
        shown = [(F.greatest("start", "w_start") - F.col("w_start")).alias("start"), (F.least("end", "w_end") - F.col("w_start")).alias("end")]
        return p.select("vod_id", F.col("w_clip_id").alias("clip_id"), F.col("seg_id").cast("string").alias("cue_id"), *shown, F.col("start").alias("vod_start"), F.col("end").alias("vod_end"), *[F.col(x).alias(x[2:]) for x in p.columns if x in ("w__axis", "w__old")])

    carried = cues(iv.with_axis(iv.with_axis(c, axis), axis, out="_old"))
    for joined, kept in ((cu.project_cues(cues(c), axis), cu.project_cues(carried)), (cu.ingest_cues(cues(c), axis, axis), cu.ingest_cues(carried))):
        assert joined.columns == kept.columns and sorted(joined.collect()) == sorted(kept.collect()) and kept.count() > 40
        assert "Exchange" not in above_join(kept)


def test_transcript_cues_shuffle_no_pairs(spark):
    _, _, s, c = tables(spark)
    axis = iv.keep_axis(c.withColumn("ord", F.lit(1)))
    plan = cu.cues_from_transcript(s.withColumn("ord", F.col("seg_id")), axis, ["1"])._jdf.queryExecution().executedPlan().toString()
    mapped = plan.split("Union")[1]
    assert "Exchange" not in mapped.split("Join")[0]
    assert "_axis" in mapped.split("Join")[0]
    assert mapped.split("SortMergeJoin")[1].strip().startswith("[vod_id") and "_bin" in mapped.split("SortMergeJoin")[1][:200]
