"""Scored and enriched candidates of every recording, in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import hour_of, py_round
from clipmine.lexicon import INTRO, OUTRO, Profile
from clipmine.operators import features as ft
from clipmine.operators import signals as sg
from clipmine.operators.edit import suggested_bounds
from clipmine.operators.joins import nearest_onset
from clipmine.operators.select import best_per_seed
from clipmine.session import cut_lineage


@dataclass(frozen=True)
class Recordings:
    """The input tables of a set of recordings."""

    vods: DataFrame
    chat: DataFrame
    segments: DataFrame
    loudness: DataFrame
    emotion: DataFrame
    speech: DataFrame

    def of_type(self, content_type: str) -> "Recordings":
        """Only the recordings of one content type (`vods.content_type`)."""
        ids = self.vods.where(F.col("content_type") == content_type).select("vod_id")
        only = lambda df: df.join(ids, "vod_id", "left_semi")
        return Recordings(*[only(df) for df in (self.vods, self.chat, self.segments, self.loudness, self.emotion, self.speech)])


def seed_times(rec: Recordings, marked: DataFrame, profile: Profile) -> DataFrame:
    seeds = sg.raw_seeds(rec.loudness, rec.emotion, marked, rec.vods, mult=1.2, lag=profile.chat_lag_sec)
    return sg.fill_empty_hours(sg.thin_by_gap(seeds, profile.seed_dedupe_sec), rec.vods)


def seed_windows(seeds: DataFrame, rec: Recordings, profile: Profile, *, length: float) -> DataFrame:
    """A window around each seed, snapped to a voice onset; snapped once more when that left it short."""
    around = ft.window_around(seeds.join(rec.vods.select("vod_id", "duration_sec"), "vod_id"), length)
    around = around.withColumnRenamed("t", "seed")
    fit = F.least("duration_sec", F.col("start") + length)
    first = nearest_onset(rec.speech, around, ids=["seed"], lookback=8.0).withColumn("end", fit)
    short = (F.col("end") - F.col("start") < length) & (F.col("start") > 0)
    again = first.where(short).withColumn("start", F.greatest(F.lit(0.0), F.col("end") - length))
    again = nearest_onset(rec.speech, again, ids=["seed"], lookback=4.0)
    w = first.where(~short).unionByName(again)
    tiny = (F.col("end") - F.col("start") < min(profile.clip_min_sec, 20.0)) & (F.col("duration_sec") >= profile.clip_min_sec)
    return w.withColumn("end", F.when(tiny, fit).otherwise(F.col("end"))).select(
        "vod_id", "seed", F.lit(float(length)).alias("wlen"), "start", "end"
    )


def score_candidates(rec: Recordings, profile: Profile) -> DataFrame:
    """Seed windows (the better of long and short) and hourly slides, with features and score.

    All windows meet each signal table once. `gen_order` numbers candidates as generated.
    """
    marked = sg.mark_reactions(rec.chat, profile)
    seeds = cut_lineage(seed_times(rec, marked, profile))
    lengths = sorted({profile.clip_max_sec, min(profile.short_window_sec, profile.clip_max_sec)}, reverse=True)
    around = seed_windows(seeds, rec, profile, length=lengths[0])
    for length in lengths[1:]:
        around = around.unionByName(seed_windows(seeds, rec, profile, length=length))
    slides = ft.hourly_windows(rec.vods, profile).withColumn("win_id", F.col("h") * 1000 + F.col("i"))
    slides = nearest_onset(rec.speech, slides, ids=["win_id"]).select(
        "vod_id", F.col("win_id").cast("string").alias("slide"), "start", "end"
    )
    windows = around.select(
        "vod_id",
        F.concat(F.lit("s"), F.col("seed").cast("string"), F.lit("/"), F.col("wlen").cast("string")).alias("win_id"),
        F.lit(0).alias("source"), F.col("seed").alias("place"), "wlen", "start", "end",
    ).unionByName(
        slides.select(
            "vod_id", F.concat(F.lit("w"), "slide").alias("win_id"), F.lit(1).alias("source"),
            F.col("slide").cast("double").alias("place"), F.lit(0.0).alias("wlen"), "start", "end",
        )
    )
    # A few windows per hour of recording: written once, then met by every signal table.
    windows = cut_lineage(windows.withColumn("end", F.greatest("start", "end")))
    scored = ft.score_windows(
        windows, marked=marked, loudness=rec.loudness, emotion=rec.emotion, segments=rec.segments,
        speech=rec.speech, profile=profile, weak=ft.chat_weakness(rec.vods, rec.chat),
    )
    best = cut_lineage(best_per_seed(scored, keys=("vod_id", "source", "place")))
    return best.withColumn("chat_lag_sec", F.lit(profile.chat_lag_sec)).withColumn("gen_order", F.struct("source", "place"))


def softban(candidates: DataFrame, profile: Profile, *, text: str = "_hay") -> DataFrame:
    """Add `is_intro`, `is_outro`, `multiplier` (needs `duration_sec`, `content_type`)."""
    outro = tx.contains_any(text, profile.outro_keywords, OUTRO)
    intro = tx.contains_any(text, profile.intro_keywords, INTRO)
    talk = F.col("content_type") == "talk"
    known = F.col("duration_sec") > 0
    tail = known & (F.col("start") >= F.col("duration_sec") * 0.92)
    head = known & (F.col("start") < F.col("duration_sec") * 0.08)
    o, i = profile.outro_penalty, profile.intro_penalty
    o_mult = (
        F.when(talk & outro, max(0.05, o)).when(outro, max(0.1, o * 1.5)).when(talk & tail, 0.55).otherwise(1.0)
    )
    i_mult = (
        F.when(intro & head, max(0.05, i)).when(intro, max(0.12, i * 1.2)).when(talk & head, 0.65).otherwise(1.0)
    )
    return (
        candidates.withColumn("is_intro", intro).withColumn("is_outro", outro).withColumn("multiplier", F.least(o_mult, i_mult))
    )


def enrich_candidates(scored: DataFrame, rec: Recordings, profile: Profile) -> DataFrame:
    """Excerpt, bigrams of the whole text, suggested bounds, intro / outro penalty, the damped score and what it is made of (`breakdown`)."""
    v = rec.vods.select(
        "vod_id", "duration_sec",
        *(["content_type"] if "content_type" in rec.vods.columns else [F.lit(profile.content_type).alias("content_type")]),
    )
    c = scored.join(v, "vod_id").withColumns({"transcript_excerpt": tx.excerpt("text"), "transcript_bigrams": tx.bigrams("text")})
    c = softban(c.withColumn("_hay", F.concat(F.coalesce("text", F.lit("")), "title")), profile)
    loud_only = F.col("chat_weak") & (F.col("chat_react") <= 0) & (F.col("chat_cue") <= 0)
    c = (
        c.withColumn("raw_score", F.col("score"))
        .withColumn("score", F.col("score") * F.col("multiplier") * F.when(loud_only, 0.85).otherwise(1.0))
        .withColumn("strategy", F.when(F.col("chat_weak"), "chat_weak").otherwise("normal"))
        .drop("_hay", "duration_sec", "content_type", "text")
    )
    parts = ("chat_density", "mean_zscore", "keyword_hits", "chat_kw_hits", "chat_react", "chat_cue", "chat_lag_sec", "emotion_score", "speech_ratio", "strategy")
    c = c.withColumn("breakdown", F.struct(*parts))
    bounded = suggested_bounds(
        c.select("vod_id", "source", "place", "start", "end", "reaction_peak_t"), rec.speech, rec.segments,
        ids=["source", "place"], ends=profile.sentence_ends, lag=profile.chat_lag_sec,
    ).select(
        "vod_id", "source", "place",
        py_round("suggested_start", 3).alias("suggested_start"), py_round("suggested_end", 3).alias("suggested_end"),
    )
    return c.join(bounded, ["vod_id", "source", "place"]).withColumn("hour_bucket", hour_of("start"))
