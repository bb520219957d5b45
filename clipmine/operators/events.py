"""Event picks per clip: shakes, punch windows, emphasis."""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import col, let, py_round, shake_cycles, shake_duration
from clipmine.operators.intervals import cut_offsets
from clipmine.operators.joins import BIN_SEC, explode_bins

CLIP = ("vod_id", "clip_id")
KINDS = ("laugh", "scream", "burst")
RANK = ("less", "t", "peak_id", "ord")
#: The largest gap that a shake asks for: nine tenths of its longest duration.
LONGEST_SHAKE_GAP = 1.26
PEAKS = "array<struct<less: double, t: double, peak_id: bigint, score: double, kind: string>>"
KEPT = f"struct<kept: {PEAKS}, far: array<double>>"


def plan_shakes(
    emotion: DataFrame, cuts: DataFrame, *, max_events: int = 3, merge_gap: float | None = None, amp: int = 14, bin_sec: float = BIN_SEC
) -> DataFrame:
    """Up to `max_events` laugh / scream peaks per clip, strongest first, kept apart; in time order."""
    peaks = emotion.where(F.col("kind").isin("laugh", "scream"))
    pieces = cut_offsets(cuts, CLIP).where(F.col("end") > F.col("start"))
    reach = LONGEST_SHAKE_GAP if merge_gap is None else merge_gap
    near = _strongest_in_cuts(peaks, pieces, n=max_events, reach=reach, bin_sec=bin_sec)
    gap = lambda x: F.lit(merge_gap) if merge_gap is not None else F.greatest(F.lit(1.0), shake_duration(x["score"]) * 0.9)

    on_clip = F.transform("_near", lambda x: F.struct(*[x[c] for c in RANK], x["score"], x["kind"], (x["offset"] + (x["t"] - x["a"])).alias("at")))
    apart = lambda x, y: F.abs(x["at"] - y["at"]) >= gap(x)
    picked = near.groupBy(*CLIP).agg(F.flatten(F.collect_list("_near")).alias("_near")).withColumn("_near", _once(on_clip))
    out = picked.select(*CLIP, F.explode(_pick("_near", max_events, apart)).alias("x")).select(*CLIP, "x.at", "x.score", "x.kind")
    return out.select(
        *CLIP, (F.round(F.col("at") * 1000.0) / 1000.0).alias("t"), py_round(shake_duration("score"), 3).alias("dur"), shake_cycles("score").alias("cycles"),
        F.lit("shake").alias("type"), F.lit(amp).alias("amp_px"), "kind", py_round("score", 3).alias("score"),
    )


def _strongest_in_cuts(peaks: DataFrame, cuts: DataFrame, *, n: int, reach: float, bin_sec: float, fits=None) -> DataFrame:
    """A row for each cut and time bin it touches: its columns, `_best` (the strongest peak there, both ends included) and
    `_near`, the peaks that a choice of `n` may take.

    Peaks of a bin are one array, put in order of strength once; a cut meets a bin's array instead of every peak, so what
    is shuffled grows with the cuts. A choice takes at most `n` peaks, and one that it has taken keeps others out within
    `reach` only. Once `n` peaks that lie twice as far apart are stronger, `n` have been taken: the weaker ones are left out.
    `fits(x, start, end)` tells which peaks may be taken at all.
    """
    arrays = peaks.groupBy("vod_id", F.floor(F.col("t") / bin_sec).alias("_bin")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "t", "peak_id", "score", "kind"))).alias("_peaks")
    )
    # No broadcast: the planner takes the exploded rows for as few as the cuts.
    joined = explode_bins(cuts, F.col("start"), F.col("end"), bin_sec).join(arrays.hint("merge"), ["vod_id", "_bin"], "left")
    inside = F.filter(F.coalesce("_peaks", F.array().cast(PEAKS)), lambda x: (x["t"] >= F.col("start")) & (x["t"] <= F.col("end")))
    extra = [F.col("offset")] if "offset" in cuts.columns else []

    def add(state: Column, x: Column) -> Column:
        far = F.forall(state["far"], lambda t: F.abs(t - x["t"]) > 2 * reach)
        more = F.struct(F.concat(state["kept"], F.array(x)).alias("kept"), F.when(far, F.concat(state["far"], F.array(x["t"]))).otherwise(state["far"]).alias("far"))
        return F.when(F.size(state["far"]) >= n, state).otherwise(more.cast(KEPT))

    def kept(found: Column) -> Column:
        usable = found if fits is None else F.filter(found, lambda x: fits(x, F.col("start"), F.col("end")))
        chosen = F.aggregate(usable, F.struct(F.array().alias("kept"), F.array().alias("far")).cast(KEPT), add, lambda s: s["kept"])
        placed = lambda x: F.struct(x["less"], x["t"], x["peak_id"], F.col("ord"), x["score"], x["kind"], F.col("start").alias("a"), F.col("end").alias("b"), *extra)
        return F.struct(F.transform(chosen, placed).alias("near"), F.transform(F.slice(found, 1, 1), placed).alias("best"))

    return joined.withColumn("_k", let(inside, kept)).select(*cuts.columns, F.col("_k.near").alias("_near"), F.col("_k.best").alias("_best"))


def _once(peaks) -> Column:
    """Peaks in order of strength; one on the seam of two cuts belongs to the earlier."""
    return F.filter(let(F.array_sort(peaks), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("x"), ((i > 0) & (F.get(a, i - 1)["peak_id"] == x["peak_id"])).alias("again")))), lambda z: ~F.coalesce(z["again"], F.lit(False)))["x"]


def _pick(peaks, n: int, apart) -> Column:
    """At most `n` elements of an array in its order, each `apart` from those taken before."""

    def take(a: Column) -> Column:
        none = F.slice(a, 1, 0)
        return F.aggregate(a, none, lambda taken, x: F.when((F.size(taken) < n) & F.forall(taken, lambda y: apart(x, y)), F.concat(taken, F.array(x))).otherwise(taken))

    return let(col(peaks), take)


def _around(t, a, b, span: float) -> tuple:
    lo = F.greatest(a, t - span / 2.0)
    hi = F.least(b, lo + span)
    return F.greatest(a, hi - span), hi


def _strongest_window(span: float) -> Column:
    """The window around `_top`, the clip's strongest peak, else the end of its first cut `_first`."""
    lo, hi = _around(F.col("_top.t"), F.col("_top.a"), F.col("_top.b"), span)
    first = F.col("_first")
    found = F.coalesce(F.col("_top.score") > -1.0, F.lit(False))
    return F.struct(
        F.when(found, lo).otherwise(F.greatest(first["start"], first["end"] - span)).alias("start"), F.when(found, hi).otherwise(first["end"]).alias("end")
    )


def _per_clip(near: DataFrame) -> DataFrame:
    return near.groupBy(*CLIP).agg(
        F.array_sort(F.flatten(F.collect_list("_near"))).alias("_near"), F.min(F.get("_best", F.lit(0))).alias("_top"),
        F.min_by(F.struct("start", "end"), "ord").alias("_first"),
    )


def punch_window(emotion: DataFrame, cuts: DataFrame, *, span: float = 1.7, bin_sec: float = BIN_SEC) -> DataFrame:
    """The window around the clip's strongest peak, else the end of its first cut."""
    near = _strongest_in_cuts(emotion.where(F.col("kind").isin(*KINDS)), cuts, n=0, reach=span, bin_sec=bin_sec)
    return _per_clip(near).select(*CLIP, _strongest_window(span).alias("w")).select(*CLIP, "w.start", "w.end")


def punch_windows(
    emotion: DataFrame, cuts: DataFrame, *, n: int = 3, span: float = 0.8, min_gap: float = 0.35, bin_sec: float = BIN_SEC
) -> DataFrame:
    """Up to `n` windows around the strongest peaks, at least `min_gap` apart, in time order; else as `punch_window`."""

    def fits(x: Column, a: Column, b: Column) -> Column:
        lo, hi = _around(x["t"], a, b, span)
        return hi - lo >= 0.25

    # A window holds its peak, so windows of peaks further apart than this are apart.
    reach = 2 * span + min_gap
    near = _strongest_in_cuts(emotion.where(F.col("kind").isin(*KINDS)), cuts, n=n, reach=reach, bin_sec=bin_sec, fits=fits)

    def window(x: Column) -> Column:
        lo, hi = _around(x["t"], x["a"], x["b"], span)
        return F.struct(lo.alias("start"), hi.alias("end"))

    apart = lambda x, y: (x["end"] < y["start"] - min_gap) | (x["start"] > y["end"] + min_gap)
    clips = _per_clip(near).withColumn("_picked", _pick(F.transform(_once("_near"), window), n, apart))
    some = F.when(F.size("_picked") > 0, F.col("_picked")).otherwise(F.array(_strongest_window(span)))
    return clips.select(*CLIP, F.explode(some).alias("w")).select(*CLIP, "w.start", "w.end")


def _rate_limited(events: DataFrame, keys: Sequence[str], *, per_bucket: int, per_10s: int, min_gap: float | None) -> DataFrame:
    """Events in time order: at most `per_bucket` per 3 s bucket and `per_10s` in any trailing 10 s."""
    schema = events.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "ord"], kind="stable")
        times: list[float] = []
        taken: list[int] = []
        bucket, used = None, 0
        for i, t in enumerate(pdf["t"]):
            if t // 3.0 != bucket:
                bucket, used = t // 3.0, 0
            crowded = sum(t - x < 10.0 for x in times[-per_10s:]) >= per_10s
            close = min_gap is not None and bool(times) and abs(t - round(times[-1], 3)) < min_gap
            if used < per_bucket and not crowded and not close:
                taken.append(i)
                times.append(t)
                used += 1
        return pdf.iloc[taken]

    return events.groupBy(*keys).applyInPandas(choose, schema)


def emphasis_from_words(
    words: DataFrame, keywords: Sequence[str], *, keys: Sequence[str] = CLIP, per_bucket: int = 2, per_10s: int = 3
) -> DataFrame:
    """Keyword hits among timed words (`start, end, text, ord`), rate limited and 0.4 s apart."""
    text = tx.strip("text")
    span = tx.key_span(text, keywords)
    hits = words.withColumn("_k", span).where(F.col("_k").isNotNull()).select(
        *keys, "ord", F.col("start").alias("t"), F.greatest("end", F.col("start") + 0.25).alias("end"), F.col("_k.frag").alias("text")
    )
    kept = _rate_limited(hits, keys, per_bucket=per_bucket, per_10s=per_10s, min_gap=0.4)
    return kept.select(*keys, py_round("t", 3).alias("t"), py_round("end", 3).alias("end"), "text", F.lit("keyword").alias("reason"))


def emphasis_from_events(
    events: DataFrame, keywords: Sequence[str], *, tokens: str | None = None, keys: Sequence[str] = CLIP,
    per_bucket: int = 2, per_10s: int = 3,
) -> DataFrame:
    """One emphasised word per subtitle event: a listed keyword, else the longest content token.

    `tokens` names an array column with the segmenter's tokens of the plain text.
    """
    plain = tx.strip(F.replace(tx.strip_tags(tx.without_leading_tags("text")), F.lit("\\N"), F.lit("")))
    c = events.withColumn("_plain", plain)
    c = c.withColumn("_k", tx.key_span("_plain", keywords, tokens)).withColumn("reason", tx.emphasis_reason("_plain", keywords, tokens))
    c = c.where(F.col("_k").isNotNull() & F.col("reason").isNotNull()).select(
        *keys, "ord", F.col("start").alias("t"), "end", F.col("_k.frag").alias("frag"),
        F.col("_k.offset").alias("offset"), F.col("_k.kind").alias("span"), "reason", "text",
    )
    kept = _rate_limited(c, keys, per_bucket=per_bucket, per_10s=per_10s, min_gap=None)
    return kept.withColumn("t", py_round("t", 3)).withColumn("end", py_round("end", 3))


def emphasised_text(kept: DataFrame, *, open_tag: str, close_tag: str) -> DataFrame:
    """Text of each chosen event with its word wrapped in tags; leading tags and breaks stay."""
    body = tx.wrap_span(tx.without_leading_tags("text"), "offset", "frag", open_tag, close_tag)
    return kept.withColumn("styled", F.concat(tx.leading_tags("text"), body))
