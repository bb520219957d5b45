"""Job progress, subtitle quality and batch reports."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clipmine.functions import text as tx
from clipmine.functions.spans import py_round
from clipmine.lexicon import STEP_WEIGHTS

STEPS = list(STEP_WEIGHTS)
# Fixed values, begin: estimate constants (GPU, CPU).
STALE_SEC = 180.0
DEFAULT_CLIP_SEC = 90.0
DEFAULT_DURATION = 3600.0
DOWNLOAD_SEC = 90.0
HIGHLIGHT_SEC = 45.0
ASR_FACTOR = (0.18, 0.85)
STAGE_FACTOR = {
    "04_edit": (0.5, 1.2), "05_subtitle": (0.45, 1.8), "06_effects": (0.45, 0.45),
    "07_flourish": (0.35, 0.35), "08_hook": (0.4, 0.4),
}
# Fixed values, end.


def subtitle_quality(events: DataFrame, keys: Sequence[str] = ("vod_id", "clip_id"), *, max_chars: int = 7) -> DataFrame:
    """Events, flashes, durations, largest gap, over-long lines and kept breaks per clip."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    dur = F.col("end") - F.col("start")
    plain = tx.strip_tags("text")
    longest = F.array_max(F.transform(F.split(plain, r"\\N|\n"), lambda ln: F.length(F.replace(tx.strip(ln), F.lit(" "), F.lit("")))))
    return (
        events.withColumn("_gap", F.lead("start").over(order) - F.col("end"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(dur < 0.5).alias("flashes"),
            py_round(F.avg(dur), 3).alias("dur_mean"),
            py_round(F.max(dur), 3).alias("dur_max"),
            py_round(F.greatest(F.lit(0.0), F.coalesce(F.max("_gap"), F.lit(0.0))), 3).alias("max_gap"),
            F.count_if(longest > max_chars).alias("over_long"),
            F.count_if(F.col("text").contains("\\N")).alias("keeps_break"),
            F.count_if(F.col("text").contains("\\clip")).alias("has_clip_tag"),
        )
    )


@F.pandas_udf(LongType())
def cut_tokens(lines: pd.Series, tokens: pd.Series) -> pd.Series:
    """How many tokens the end of a line, but the last one, falls into. Lines and tokens are given by their lengths."""

    def one(a, b):
        inner, ends = np.cumsum(a)[:-1], np.cumsum(b)
        at = np.searchsorted(ends, inner)
        at = at[at < len(ends)] if len(ends) == 0 else at[(at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] != inner)]
        return len(np.unique(at))

    return pd.Series([0 if a is None or b is None else one(a, b) for a, b in zip(lines, tokens)], dtype="int64")


def mid_word_cuts(events: DataFrame, tokens: str, keys: Sequence[str] = ("vod_id", "clip_id")) -> DataFrame:
    """Tokens (of the text without breaks) that a line break falls into, per clip; 0 for a clip without a break."""
    parts = F.filter(F.transform(F.split(tx.strip_tags("text"), r"\\N"), tx.strip), lambda p: p != "")
    words = F.filter(F.col(tokens), lambda t: tx.strip(t) != "")
    sizes = lambda arr: F.transform(arr, lambda x: F.length(x))
    return (
        events.select(*keys, F.col("text").contains("\\N").alias("_has"), cut_tokens(sizes(parts), sizes(words)).alias("_cut"))
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("_has"), F.col("_cut")).otherwise(0)).alias("mid_word_cuts"))
    )


def quality_rollup(per_clip: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    return per_clip.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clips"), F.sum("events").alias("events"), F.sum("flashes").alias("flashes"),
        F.max("max_gap").alias("max_gap"), F.sum("over_long").alias("over_long"),
    )


# --- progress ------------------------------------------------------------------------------------


def step_percent(steps: DataFrame, *, digits: int = 1) -> DataFrame:
    """Weighted share of done steps; a running one counts 35 %."""
    weight = F.create_map(*[x for k, v in STEP_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))])
    w = F.coalesce(F.try_element_at(weight, "step"), F.lit(0.0))
    share = F.when(F.col("status") == "done", w).when(F.col("status") == "running", w * 0.35).otherwise(0.0)
    return steps.groupBy("job_id").agg(py_round(100.0 * F.sum(share) / float(sum(STEP_WEIGHTS.values())), digits).alias("pct"))


def stage_backlog(jobs: DataFrame, highlights: DataFrame, outputs: DataFrame) -> DataFrame:
    """Clips done and missing per rendering stage (`outputs`: one row per finished file)."""
    span = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    hl = highlights.groupBy("job_id").agg(F.count(F.lit(1)).alias("clips"), F.avg(span).alias("mean_sec"))
    have = outputs.groupBy("job_id", "step").agg(F.count(F.lit(1)).alias("done"))
    edit = have.where(F.col("step") == "04_edit").select("job_id", F.col("done").alias("_edit"))
    stages = jobs.select("job_id", F.explode(F.array(*[F.lit(s) for s in STAGE_FACTOR])).alias("step"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n = F.coalesce(F.nullif(z("clips"), F.lit(0)), z("_edit"))
    return (
        stages.join(hl, "job_id", "left").join(edit, "job_id", "left").join(have, ["job_id", "step"], "left")
        .select(
            "job_id", "step", z("done").alias("done"), F.greatest(n, z("done")).alias("total"),
            F.coalesce("mean_sec", F.lit(DEFAULT_CLIP_SEC)).alias("mean_sec"),
        )
    )


def job_progress(jobs: DataFrame, steps: DataFrame, highlights: DataFrame, outputs: DataFrame, *, now, digits: int = 1) -> DataFrame:
    """Live status, percent done and remaining seconds per job.

    `jobs`: `job_id, status, duration_sec, allow_cpu, last_activity` (seconds); `now` is a parameter.
    The seconds are rounded at six decimals before they are made whole, so that a sum's order can't move a half.
    """
    idle = F.lit(float(now)) - F.col("last_activity")
    live = (
        F.when((F.col("status") == "running") & (F.coalesce(idle, F.lit(1e9)) > STALE_SEC), "stale")
        .when(F.col("status") == "completed", "done")
        .otherwise(F.col("status"))
    )
    by = lambda pair: F.when(F.col("allow_cpu"), pair[1]).otherwise(pair[0])
    wide = jobs.select("job_id").join(steps, "job_id", "left").groupBy("job_id").agg(
        *[F.bool_or((F.col("step") == s) & (F.col("status") == "done")).alias("d_" + s) for s in STEPS],
        F.min(F.when(F.col("status") == "running", F.col("step"))).alias("running_step"),
        F.min_by("error", F.when(F.col("status") == "failed", F.col("step"))).alias("error"),
        F.count_if(F.col("status") == "done").alias("steps_done"),
    )
    factor = F.create_map(*[x for k, p in STAGE_FACTOR.items() for x in (F.lit(k), F.array(F.lit(p[0]), F.lit(p[1])))])
    render = (
        stage_backlog(jobs, highlights, outputs)
        .join(jobs.select("job_id", "allow_cpu"), "job_id")
        .groupBy("job_id")
        .agg(F.sum((F.col("total") - F.col("done")) * F.col("mean_sec") * F.when(F.col("allow_cpu"), factor[F.col("step")][1]).otherwise(factor[F.col("step")][0])).alias("render_sec"))
    )
    done = lambda s: F.coalesce(F.col("d_" + s), F.lit(False))
    late = [~done(s) for s in STEPS[3:]]
    any_late = late[0] | late[1] | late[2] | late[3] | late[4]
    eta = (
        F.when(done("01_download"), 0.0).otherwise(DOWNLOAD_SEC)
        + F.when(done("02_asr"), 0.0).otherwise(F.coalesce(F.nullif("duration_sec", F.lit(0.0)), F.lit(DEFAULT_DURATION)) * by(ASR_FACTOR))
        + F.when(done("03_highlights"), 0.0).otherwise(HIGHLIGHT_SEC)
        + F.when(any_late, F.col("render_sec")).otherwise(0.0)
    )
    return (
        jobs.join(wide, "job_id", "left").join(step_percent(steps, digits=digits), "job_id", "left").join(render, "job_id", "left")
        .withColumn("live", live)
        .select(
            "job_id", F.col("live").alias("status"), F.coalesce("pct", F.lit(0.0)).alias("pct"),
            F.when(F.col("live") == "running", F.rint(F.round(eta, 6))).alias("eta_sec"),
            F.when(F.col("live") == "running", F.col("running_step"))
            .when(F.col("live") == "failed", F.left(F.coalesce("error", F.lit("failed")), F.lit(160)))
            .otherwise(F.concat(F.col("steps_done").cast("string"), F.lit("/8"))).alias("detail"),
        )
    )


def job_summary(jobs: DataFrame, steps: DataFrame, decisions: DataFrame, highlights: DataFrame) -> DataFrame:
    """Whether a job waits at the review gate, and its counts; newest serial first, unnumbered last."""
    s = steps.groupBy("job_id").agg(
        F.bool_or((F.col("step") == "03_highlights") & (F.col("status") == "done")).alias("_s3"),
        F.bool_or((F.col("step") == "04_edit") & F.col("status").isin("done", "running")).alias("_s4"),
    )
    d = decisions.groupBy("job_id").agg(F.count_if(F.col("action") == "keep").alias("keep"), F.count_if(F.col("action") == "reject").alias("reject"))
    h = highlights.groupBy("job_id").agg(F.count(F.lit(1)).alias("hl"))
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        jobs.join(s, "job_id", "left").join(d, "job_id", "left").join(h, "job_id", "left")
        .select(
            "job_id", "serial", (f("_s3") & F.col("keep").isNull() & ~f("_s4")).alias("awaiting_review"),
            z("keep").alias("keep_count"), z("reject").alias("reject_count"),
            F.when(z("hl") > 0, z("hl")).otherwise(z("keep")).alias("total_segments"),
        )
        .orderBy(F.desc_nulls_last("serial"), "job_id")
    )


def batch_progress(items: DataFrame, keys: Sequence[str] = ("batch",)) -> DataFrame:
    """`status, start, end` per item: done, total, failed and the mean clip length (90 s by default)."""
    span = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    return items.groupBy(*keys).agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.avg(span), F.lit(DEFAULT_CLIP_SEC)).alias("mean_clip_sec"),
    )


def marker_count(log_lines: DataFrame, marker: str, pattern: str = r"short_(\d+)", keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Distinct clip numbers on marker lines, else the number of markers."""
    hits = log_lines.where(F.col("value").contains(marker)).withColumn("_n", F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")))
    found = F.count_distinct("_n")
    markers = F.sum((F.length("value") - F.length(F.replace("value", F.lit(marker), F.lit("")))) / len(marker)).cast("long")
    return hits.groupBy(*keys).agg(F.when(found > 0, found).otherwise(markers).alias("marked"))


def latest_job(files: DataFrame, keys: Sequence[str] = ("alias",)) -> DataFrame:
    """The newest path per alias (`path, modified`)."""
    return files.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def review_view(queue: DataFrame) -> DataFrame:
    """What a reviewer sees of each candidate: flags, why it was selected, the sample messages."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    why = F.concat_ws(
        "；",
        F.when(F.col("chat_cue") > 0, F.lit("觀眾剪輯 cue")),
        F.when(F.col("chat_react") > 0.05, F.concat(F.lit("彈幕反應 "), tx.fixed("chat_react", 2))),
        F.when(F.col("reaction_peak_t").isNotNull(), F.format_string("反應峰 t=%.0f（內容約前推 %.0fs）", "reaction_peak_t", "chat_lag_sec")),
        F.when(F.col("keyword_hits") > 0, F.format_string("字幕關鍵字×%d", "keyword_hits")),
    )
    samples = F.array_join(
        F.transform(F.slice("chat_samples", 1, 3), lambda s: F.concat(F.lit("t="), s["t"].cast("string"), F.lit("「"), s["message"], F.lit("」"))), "; "
    )
    return queue.select(
        "vod_id", "candidate_id", "score", "rank_score", "start", "end", "suggested_start", "suggested_end", "title", "suggested_hook",
        F.concat_ws(
            ",", flag(F.col("is_outro"), "outro"), flag(F.col("is_intro"), "intro"), flag(F.col("chat_weak"), "chat_weak"), flag(F.col("chat_cue") > 0, "clip_cue")
        ).alias("flags"),
        why.alias("why"), samples.alias("samples"), F.left("transcript_excerpt", F.lit(700)).alias("transcript"),
    )
