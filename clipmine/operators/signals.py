"""Signals of a recording: loudness, emotion, voice activity, chat histograms, burst seeds."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions.spans import hour_count, py_round
from clipmine.functions.text import strip
from clipmine.lexicon import Profile
from clipmine.operators.intervals import islands, merge_intervals

KEYS = ("vod_id",)


def frame_rms(pcm: DataFrame, frame: int, *, sample_rate: int) -> DataFrame:
    """RMS per frame of `frame` samples (frames centred on multiples of `frame`, zero padded)."""
    f = F.floor((F.col("i") + frame // 2) / frame)
    return (
        pcm.groupBy("vod_id", f.alias("frame"))
        .agg(F.sqrt(F.sum(F.col("y") * F.col("y")) / frame).alias("rms"))
        .select("vod_id", (F.col("frame") * F.lit(frame) / sample_rate).alias("t"), "rms")
    )


def zscores(frames: DataFrame, *, value: str = "rms", keys: Sequence[str] = KEYS) -> DataFrame:
    """Population z-score per recording; all zero when the deviation vanishes.

    Statistics are one row per recording, joined back: the frames of a hot recording are split by
    adaptive skew handling instead of meeting in one window partition.
    """
    stats = frames.groupBy(*keys).agg(F.avg(value).alias("_avg"), F.stddev_pop(value).alias("_std"))
    z = F.when(F.col("_std") < 1e-12, 0.0).otherwise((F.col(value) - F.col("_avg")) / F.col("_std"))
    return frames.join(stats, list(keys)).withColumn("zscore", z).drop("_avg", "_std")


def emotion_kind(score) -> Column:
    return F.when(score >= 4.0, "scream").when(score >= 3.0, "laugh").otherwise("burst")


def emotion_peaks(frames: DataFrame, *, threshold: float = 2.5, value: str = "rms") -> DataFrame:
    z = zscores(frames, value=value).where(F.col("zscore") >= threshold)
    return z.select("vod_id", "t", F.col("zscore").alias("score"), emotion_kind(F.col("zscore")).alias("kind"))


def voice_activity(
    frames: DataFrame, *, frame_sec: float = 0.05, merge_gap: float = 0.35, min_len: float = 0.25, percentile: float = 0.35
) -> DataFrame:
    """Voice intervals from frame RMS: runs of frames above the threshold, then merged.

    A run ends at the first quiet frame; the last run ends one frame after the final frame. Each loud
    frame becomes the span up to the next frame, so runs are touching spans and the interval merge
    finds them without an ordered pass over all frames. Needs the frame's index column `i`.
    """
    stats = frames.groupBy("vod_id").agg(
        F.greatest(F.percentile("rms", F.lit(percentile)), F.avg("rms") * 0.35).alias("_thr"),
        F.max("i").alias("_last"),
        F.max("t").alias("_last_t"),
    )
    following = frames.select("vod_id", (F.col("i") - 1).alias("i"), F.col("t").alias("_next"))
    loud = (
        frames.join(stats, "vod_id")
        .where(F.col("rms") >= F.col("_thr"))
        .join(following, ["vod_id", "i"], "left")
        .select("vod_id", F.col("t").alias("start"), F.coalesce("_next", F.col("_last_t") + frame_sec).alias("end"))
    )
    runs = merge_intervals(loud, frame_sec / 1000, KEYS).where(F.col("end") - F.col("start") >= min_len)
    return merge_intervals(runs, merge_gap, KEYS)


def speech_from_segments(segments: DataFrame, *, merge_gap: float = 0.35) -> DataFrame:
    s = segments.where((F.col("end") > F.col("start")) & (strip("text") != ""))
    return merge_intervals(s.select("vod_id", "start", "end"), merge_gap)


def interval_totals(iv: DataFrame, prefix: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return iv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(prefix + "_count"),
        py_round(F.sum(F.col("end") - F.col("start")), 3).alias(prefix + "_total_sec"),
    )


# --- chat ----------------------------------------------------------------------------------------


def mark_reactions(chat: DataFrame, profile: Profile) -> DataFrame:
    """Evaluate the reaction patterns and keyword counts once per message, before any join."""
    from clipmine.functions.text import keyword_hits

    msg = strip("message")
    hit = lambda pattern: (msg != "") & msg.rlike(pattern)
    return chat.select(
        "vod_id", "seq", "t",
        msg.alias("message"),
        hit(profile.laugh).alias("laugh"),
        hit(profile.confused).alias("confused"),
        hit(profile.clip_cue).alias("cue"),
        keyword_hits(msg, profile.chat_keywords).alias("kw"),
    )


def in_recording(rows: DataFrame, vods: DataFrame) -> DataFrame:
    """Rows with `0 <= t < duration_sec`."""
    d = vods.select("vod_id", F.col("duration_sec").alias("_d"))
    return rows.join(d, "vod_id").where((F.col("t") >= 0) & (F.col("t") < F.col("_d"))).drop("_d")


def chat_histogram(marked: DataFrame, *, bin_sec: float = 5.0) -> DataFrame:
    """Messages and reaction strength per bin, one pass with partial aggregation."""
    strength = (
        F.when(F.col("laugh"), 1.0).otherwise(0.0)
        + F.when(F.col("confused"), 0.8).otherwise(0.0)
        + F.when(F.col("cue"), 2.5).otherwise(0.0)
    )
    return marked.groupBy("vod_id", F.floor(F.col("t") / bin_sec).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(strength).alias("react")
    )


def upper_median(df: DataFrame, value: str, *, keys: Sequence[str] = KEYS, out: str = "median") -> DataFrame:
    """`sorted(values)[n // 2]` per key, from a count per distinct value (never the raw values)."""
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_c").over(Window.partitionBy(*keys))
    return (
        freq.withColumn("_upto", upto)
        .withColumn("_half", F.floor(total / 2))
        .where(F.col("_upto") > F.col("_half"))
        .groupBy(*keys)
        .agg(F.min(value).alias(out))
    )


def burst_bins(hist: DataFrame, *, mult: float) -> DataFrame:
    """Bins whose message count or reaction strength stands out; `by_count` / `by_react` flags."""
    med = upper_median(hist, "n", out="_mn")
    rmed = upper_median(hist.where(F.col("react") > 0), "react", out="_mr")
    thr = F.greatest(F.lit(2), F.floor(F.col("_mn") * max(1.0, mult)))
    rthr = F.greatest(F.lit(1.5), F.col("_mr") * 1.2)
    flagged = (
        hist.join(med, "vod_id")
        .join(rmed, "vod_id", "left")
        .withColumn("by_count", F.col("n") >= thr)
        .withColumn("by_react", F.coalesce((F.col("react") > 0) & (F.col("react") >= rthr), F.lit(False)))
    )
    return flagged.where(F.col("by_count") | F.col("by_react")).drop("_mn", "_mr")


def raw_seeds(
    loudness: DataFrame, emotion: DataFrame, marked: DataFrame, vods: DataFrame, *, mult: float = 1.2, lag: float = 8.0
) -> DataFrame:
    """Distinct seed times, 0.1 s grid: loud frames, emotion peaks and chat bursts moved back by the lag."""
    loud = loudness.where(F.col("zscore") >= 1.5).select("vod_id", "t")
    emo = emotion.where(F.col("score") >= 2.5).select("vod_id", "t")
    hist = chat_histogram(in_recording(marked, vods))
    burst = burst_bins(hist, mult=mult).select(
        "vod_id", F.greatest(F.lit(0.0), F.col("bin") * 5.0 + 2.5 - lag).alias("t")
    )
    seeds = in_recording(loud.unionByName(emo), vods).unionByName(in_recording(burst, vods))
    return seeds.select("vod_id", py_round("t", 1).alias("t")).distinct()


def thin_by_gap(seeds: DataFrame, gap: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Greedy thinning: keep the first time, then the next one at least `gap` after the last kept.

    A time that far from its predecessor is always kept, so the greedy pass restarts there: each chain
    of closer times is thinned on its own.
    """
    g = max(1.0, float(gap))
    spans = seeds.select(*keys, F.col("t").alias("start"), F.col("t").alias("end"))
    chained = islands(spans, keys, start="start", end="end", gap=g, touching=False)
    chains = chained.groupBy(*keys, "island").agg(F.sort_array(F.collect_set("start")).alias("ts"))
    return _thin(chains, keys, g)


def _thin(chains: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    @F.pandas_udf("array<double>")
    def greedy(col: pd.Series) -> pd.Series:
        def one(ts):
            out, i, n = [], 0, len(ts)
            while i < n:
                out.append(float(ts[i]))
                i = max(i + 1, int(np.searchsorted(ts, ts[i] + gap - 1e-6)))
                while i < n and ts[i] - out[-1] < gap:
                    i += 1
            return out

        return col.map(one)

    return chains.select(*keys, F.explode(greedy("ts")).alias("t"))


def fill_empty_hours(seeds: DataFrame, vods: DataFrame) -> DataFrame:
    """Give every hour without a seed its midpoint."""
    hours = vods.select(
        "vod_id",
        "duration_sec",
        F.explode(F.sequence(F.lit(0), F.greatest(hour_count("duration_sec"), F.lit(1)) - 1)).alias("h"),
    ).where(F.col("duration_sec") > 0)
    seen = seeds.select("vod_id", F.floor(F.col("t") / 3600.0).cast("int").alias("h")).distinct()
    middle = (F.col("h") * 3600.0 + F.least((F.col("h") + 1) * 3600.0, F.col("duration_sec"))) / 2.0
    missing = hours.join(seen, ["vod_id", "h"], "left_anti").select("vod_id", middle.alias("t"))
    return seeds.select("vod_id", "t").unionByName(missing)


# --- regions of interest -------------------------------------------------------------------------


def robust_roi(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upper median of the hit centres, clipped; the default centre when nothing was hit."""
    hits = samples.where("hit")
    cx = upper_median(hits, "cx", keys=keys, out="mx")
    cy = upper_median(hits, "cy", keys=keys, out="my")
    counts = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("hit")).alias("hits")
    )
    clip = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    return (
        counts.join(cx, list(keys), "left")
        .join(cy, list(keys), "left")
        .select(
            *keys, "samples", "hits",
            F.coalesce(clip(F.col("mx"), 0.15, 0.85), F.lit(0.5)).alias("cx"),
            F.coalesce(clip(F.col("my") * 0.92, 0.12, 0.65), F.lit(0.38)).alias("cy"),
            (F.col("hits") > 0).alias("detected"),
        )
    )


def smooth_roi(
    samples: DataFrame, keys: Sequence[str], *, deadzone: float = 0.12, smooth: float = 0.35, cx: float = 0.5, cy: float = 0.38
) -> DataFrame:
    """Hold the last hit, ignore moves inside the dead zone, then follow exponentially.

    The samples of one clip (a handful) are folded by a higher-order function with a struct state.
    """
    alpha, dz = min(1.0, max(0.05, smooth)), max(0.0, deadzone)
    item = F.struct("t", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "hit")
    folded = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("s"))

    def state(hx, hy, tx, ty, x, y, path):
        return F.struct(
            hx.alias("hx"), hy.alias("hy"), tx.alias("tx"), ty.alias("ty"),
            x.alias("x"), y.alias("y"), path.alias("path"),
        )

    zero = state(
        F.lit(cx), F.lit(cy), F.lit(cx), F.lit(cy), F.lit(cx), F.lit(cy),
        F.array().cast("array<struct<t:double,cx:double,cy:double>>"),
    )

    def step(a, s):
        hx = F.when(s["hit"], s["cx"]).otherwise(a["hx"])
        hy = F.when(s["hit"], s["cy"]).otherwise(a["hy"])
        moved = (F.abs(hx - a["tx"]) > dz) | (F.abs(hy - a["ty"]) > dz)
        tx = F.when(moved, hx).otherwise(a["tx"])
        ty = F.when(moved, hy).otherwise(a["ty"])
        x = a["x"] + alpha * (tx - a["x"])
        y = a["y"] + alpha * (ty - a["y"])
        point = F.struct(s["t"].cast("double").alias("t"), x.alias("cx"), y.alias("cy"))
        return state(hx, hy, tx, ty, x, y, F.concat(a["path"], F.array(point)))

    path = F.aggregate("s", zero, step, lambda a: a["path"])
    return folded.select(*keys, F.inline(path))


def mean_roi(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return smoothed.groupBy(*keys).agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
