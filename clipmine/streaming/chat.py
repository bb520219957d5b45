"""Chat operators on a stream. Input: `vod_id, seq, ts TIMESTAMP, author, message` (+ flags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmine.functions.spans import py_round
from clipmine.functions.text import keyword_hits, strip
from clipmine.lexicon import Profile

DELAY = "10 minutes"


def mark(chat: DataFrame, profile: Profile) -> DataFrame:
    msg = strip("message")
    hit = lambda p: (msg != "") & msg.rlike(p)
    return chat.withColumns(
        {
            "laugh": hit(profile.laugh), "confused": hit(profile.confused), "cue": hit(profile.clip_cue),
            "kw": keyword_hits(msg, profile.chat_keywords),
        }
    )


def _strength() -> Column:
    one = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    return one("laugh", 1.0) + one("confused", 0.8) + one("cue", 2.5)


def deduplicated(chat: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """Drop repeated (time to 0.01 s, author, message) that arrive within the watermark delay."""
    t2 = py_round(F.col("ts").cast("double"), 2)
    return (
        chat.withColumn("_t2", t2).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["vod_id", "_t2", "author", "message"]).drop("_t2")
    )


def bins(marked: DataFrame, *, width: str = "5 seconds", delay: str = DELAY) -> DataFrame:
    """Messages and reaction strength per tumbling bin."""
    return (
        marked.withWatermark("ts", delay)
        .groupBy("vod_id", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_strength()).alias("react"))
        .select("vod_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "react")
    )


def sliding_features(marked: DataFrame, *, width_sec: int = 60, step_sec: int = 15, delay: str = DELAY) -> DataFrame:
    """Chat features per sliding window."""
    rate = lambda c: F.least(F.lit(2.0), F.count_if(F.col(c)) / width_sec)
    return (
        marked.withWatermark("ts", delay)
        .groupBy("vod_id", F.window("ts", f"{width_sec} seconds", f"{step_sec} seconds").alias("w"))
        .agg(
            (F.count(F.lit(1)) / width_sec).alias("chat_density"),
            (rate("laugh") + 0.7 * rate("confused")).alias("chat_react"),
            F.least(F.lit(3.0), F.count_if(F.col("cue")) * 1.5).alias("chat_cue"),
            F.sum("kw").alias("chat_kw_hits"),
        )
        .select("vod_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chat_density", "chat_react", "chat_cue", "chat_kw_hits")
    )


def reaction_sessions(marked: DataFrame, *, gap: str = "5 seconds", delay: str = DELAY) -> DataFrame:
    """Bursts of reactions that pause for less than `gap`."""
    return (
        marked.where("laugh or confused or cue")
        .withWatermark("ts", delay)
        .groupBy("vod_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_strength()).alias("react"))
        .select("vod_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "react")
    )
