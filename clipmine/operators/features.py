"""Window features and the weighted window score."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import hour_of, py_round
from clipmine.lexicon import Profile
from clipmine.operators.joins import points_in_windows, speech_coverage, window_text
from clipmine.session import cut_lineage

IDS = ("vod_id", "win_id")


def hourly_windows(vods: DataFrame, profile: Profile, *, step: float | None = None) -> DataFrame:
    """Sliding windows over each hour, the first `bucket_slide_cap` if that is set; one whole-hour window if the hour is short."""
    step = max(5.0, profile.window_step_sec) if step is None else step
    h = F.col("h")
    b0, b1 = h * 3600.0, F.least((h + 1) * 3600.0, F.col("duration_sec"))
    span = b1 - b0
    length = F.least(F.lit(profile.clip_max_sec), span)
    length = F.when((length < profile.clip_min_sec) & (span >= profile.clip_min_sec), profile.clip_min_sec).otherwise(length)
    n = F.when(span <= length, 1).otherwise(F.floor((span - length + 1e-9) / step).cast("int") + 1)
    hours = vods.where(F.col("duration_sec") > 0).select(
        "vod_id", "duration_sec",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration_sec") / 3600.0).cast("int") - 1)).alias("h"),
    )
    i = F.col("i")
    return (
        hours.where(span > 0)
        .withColumn("_len", F.when(span <= length, span).otherwise(length))
        .withColumn("i", F.explode(F.sequence(F.lit(0), (n if profile.bucket_slide_cap is None else F.least(n, F.lit(profile.bucket_slide_cap))) - 1)))
        .select(
            "vod_id", "h", "i",
            (b0 + i * step).alias("start"),
            F.least(b0 + i * step + F.col("_len"), F.col("duration_sec")).alias("end"),
        )
    )


def window_around(seeds: DataFrame, length: float, duration: str = "duration_sec") -> DataFrame:
    """Window of `length` centred on `t`, pushed inside `[0, duration]`; adds `start`, `end`."""
    start = F.greatest(F.lit(0.0), F.col("t") - length / 2.0)
    end = F.least(F.col(duration), start + length)
    return seeds.withColumn("start", F.greatest(F.lit(0.0), end - length)).withColumn("end", end)


def chat_features(marked: DataFrame, windows: DataFrame, *, ids: Sequence[str] = IDS, **kw) -> DataFrame:
    """Density, reactions, cue, keyword hits, last reaction time and three samples per window.

    One join and one aggregate. Counts combine before the shuffle; the three sample messages come
    from a bounded top-3 per window, not from a list of all its messages.
    """
    w = windows.select(*ids, "start", "end")
    pairs = points_in_windows(marked, w, spread=("seq",), **kw).withColumn("react", F.expr("laugh or confused or cue"))
    keep = [F.col("vod_id")] + [F.col("w_" + c).alias(c) for c in ids if c != "vod_id"]
    counts = pairs.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("msgs"),
        F.count_if("laugh").alias("laughs"),
        F.count_if("confused").alias("confuseds"),
        F.count_if("cue").alias("cues"),
        F.sum("kw").alias("chat_kw_hits"),
        F.max(F.when(F.col("react"), F.col("t"))).alias("reaction_peak_t"),
    )
    order = Window.partitionBy(*ids).orderBy("seq")
    first3 = (
        pairs.where("react")
        .select(*keep, "seq", py_round("t", 1).alias("t"), F.left("message", F.lit(80)).alias("message"))
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= 3)
    )
    samples = first3.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("seq", "t", "message"))).alias("_s"))
    length = F.greatest(F.lit(1e-6), F.col("end") - F.col("start"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        w.join(counts, list(ids), "left")
        .join(samples, list(ids), "left")
        .select(
            *ids,
            F.when(F.col("end") <= F.col("start"), 0.0).otherwise(n("msgs") / length).alias("chat_density"),
            F.least(F.lit(2.0), n("laughs") / length).alias("laugh"),
            F.least(F.lit(2.0), n("confuseds") / length).alias("confused"),
            F.least(F.lit(3.0), n("cues") * 1.5).alias("chat_cue"),
            n("chat_kw_hits").alias("chat_kw_hits"),
            "reaction_peak_t",
            F.coalesce(
                F.transform("_s", lambda s: F.struct(s["t"].alias("t"), s["message"].alias("message"))),
                F.array().cast("array<struct<t:double,message:string>>"),
            ).alias("chat_samples"),
        )
    )


def signal_features(loudness: DataFrame, emotion: DataFrame, windows: DataFrame, *, ids: Sequence[str] = IDS, **kw) -> DataFrame:
    """Mean loudness z and strongest emotion per window; 0 where nothing falls in."""
    w = windows.select(*ids, "start", "end")
    keep = [F.col("vod_id")] + [F.col("w_" + c).alias(c) for c in ids if c != "vod_id"]
    z = points_in_windows(loudness.select("vod_id", "t", "zscore"), w, spread=("t", "zscore"), **kw).groupBy(*keep).agg(F.avg("zscore").alias("_z"))
    e = points_in_windows(emotion.select("vod_id", "t", "score"), w, **kw).groupBy(*keep).agg(F.max("score").alias("_e"))
    return (
        w.join(z, list(ids), "left")
        .join(e, list(ids), "left")
        .select(*ids, F.coalesce("_z", F.lit(0.0)).alias("mean_zscore"), F.coalesce("_e", F.lit(0.0)).alias("emotion_score"))
    )


def score_windows(
    windows: DataFrame, *, marked: DataFrame, loudness: DataFrame, emotion: DataFrame, segments: DataFrame,
    speech: DataFrame, profile: Profile, weak: DataFrame | None = None, **kw,
) -> DataFrame:
    """All features of each window and its weighted score.

    `weak` holds `vod_id, chat_weak`; recordings with little chat lean on the other signals.
    """
    p = profile
    w = windows.select(*IDS, "start", "end")
    text = window_text(segments, w, ids=["win_id"])
    # A row for each window, written once: the driver never holds all range joins in one plan.
    out = (
        speech_coverage(speech, windows, ids=["win_id"])
        .join(cut_lineage(chat_features(marked, w, **kw)), list(IDS), "left")
        .join(cut_lineage(signal_features(loudness, emotion, w, **kw)), list(IDS), "left")
        .join(text, list(IDS), "left")
    )
    if weak is None:
        out = out.withColumn("chat_weak", F.lit(False))
    else:
        out = out.join(weak.select("vod_id", "chat_weak"), "vod_id", "left").withColumn(
            "chat_weak", F.coalesce("chat_weak", F.lit(True))
        )
    scaled = lambda weight, factor: F.when(F.col("chat_weak"), weight * factor).otherwise(weight)
    return (
        out.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("keyword_hits", tx.keyword_hits("text", p.keywords))
        .withColumn("chat_react", F.col("laugh") + 0.7 * F.col("confused"))
        .withColumn(
            "score",
            p.w_chat * F.col("chat_density")
            + scaled(p.w_vol, p.chat_weak_vol_scale) * F.greatest(F.lit(0.0), F.col("mean_zscore"))
            + scaled(p.w_kw, p.chat_weak_kw_scale) * F.col("keyword_hits")
            + scaled(p.w_chat_kw, 0.4) * F.col("chat_kw_hits")
            + scaled(p.w_chat_react, 0.4) * F.col("chat_react")
            + scaled(p.w_clip_cue, 0.5) * F.col("chat_cue")
            + scaled(p.w_emotion, p.chat_weak_emotion_scale) * F.col("emotion_score")
            + F.col("speech_ratio") * 0.5,
        )
        .withColumn("hour_bucket", hour_of("start"))
        .withColumn("title", tx.title("text"))
        .withColumn("suggested_hook", tx.hook("title"))
        .withColumn(
            "reason",
            tx.reason(**{
                c: c for c in (
                    "chat_density", "chat_react", "chat_cue", "mean_zscore",
                    "keyword_hits", "chat_kw_hits", "emotion_score", "speech_ratio",
                )
            }),
        )
        .drop("laugh", "confused")
    )


def rank_in_hour(candidates: DataFrame, keys: Sequence[str] = ("vod_id", "hour_bucket")) -> DataFrame:
    """`rank_score` = score + its population z within the hour."""
    hour = Window.partitionBy(*keys)
    avg, std = F.avg("score").over(hour), F.stddev_pop("score").over(hour)
    std = F.when(std * std > 1e-12, std).otherwise(1.0)
    return candidates.withColumn("rank_score", F.col("score") + (F.col("score") - avg) / std)


def chat_weakness(vods: DataFrame, chat: DataFrame, *, min_messages: int = 20) -> DataFrame:
    n = chat.groupBy("vod_id").agg(F.count(F.lit(1)).alias("_n"))
    available = F.coalesce(F.col("available"), F.lit(True)) if "available" in vods.columns else F.lit(True)
    return vods.join(n, "vod_id", "left").select(
        "vod_id", (~available | (F.coalesce("_n", F.lit(0)) < min_messages)).alias("chat_weak")
    )
