"""Subtitle events and cues on clip time lines."""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from clipmine.functions import text as tx
from clipmine.functions.spans import let, py_round
from clipmine.operators import subtitles as st
from clipmine.operators.intervals import short_pieces, vod_time, with_axis
from clipmine.operators.joins import near_spans, overlapping_spans, points_in_windows
from clipmine.operators.laid import laid, places

CLIP = ("vod_id", "clip_id")
NO_WORDS = "array<struct<start:double,end:double,text:string>>"


# --- words ---------------------------------------------------------------------------------------


def words_in_windows(segments: DataFrame, windows: DataFrame, *, ids: Sequence[str]) -> DataFrame:
    """Words whose middle lies in a window; segments without words count as one word, clipped."""
    w = windows.select("vod_id", *ids, "start", "end")
    out_ids = [F.col("w_" + c).alias(c) for c in ids]
    words = segments.select("vod_id", "seg_id", F.explode("words").alias("x")).where(tx.strip("x.text") != "")
    timed = words.select(
        "vod_id", "seg_id", ((F.col("x.start") + F.col("x.end")) / 2.0).alias("t"),
        F.col("x.start").alias("x0"), F.col("x.end").alias("x1"), F.col("x.text").alias("text"),
    )
    by_word = points_in_windows(timed, w).select(
        "vod_id", *out_ids, "seg_id", F.col("x0").alias("start"), F.col("x1").alias("end"), "text"
    )
    bare = segments.where(F.coalesce(F.size("words"), F.lit(0)) <= 0).select(
        "vod_id", "seg_id", "start", "end", tx.strip("text").alias("text")
    )
    by_segment = overlapping_spans(bare.where(F.col("text") != ""), w).select(
        "vod_id", *out_ids, "seg_id",
        F.greatest("start", "w_start").alias("start"), F.least("end", "w_end").alias("end"), "text",
    )
    return by_word.unionByName(by_segment)


def flat_words(segments: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Ordered word times; a segment without words gives its characters equal shares of its span."""
    has = F.coalesce(F.size("words"), F.lit(0)) > 0
    given = (
        segments.where(has)
        .select(*keys, "seg_id", F.posexplode("words").alias("pos", "w"))
        .select(
            *keys, "seg_id", "pos", F.col("w.start").alias("start"),
            F.greatest("w.start", "w.end").alias("end"), tx.strip("w.text").alias("text"),
        )
        .where((F.col("text") != "") & ~tx.is_noise("text"))
    )
    chars = F.filter(
        F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""), ""), lambda c: c != ""
    )
    step = F.greatest(F.lit(0.05), F.col("end") - F.col("start")) / F.col("n")
    made = (
        segments.where(~has)
        .withColumn("chars", chars)
        .withColumn("n", F.size("chars"))
        .where(F.col("n") > 0)
        .select(*keys, "seg_id", "start", step.alias("step"), F.posexplode("chars").alias("pos", "text"))
        .select(
            *keys, "seg_id", "pos", (F.col("start") + F.col("pos") * F.col("step")).alias("start"),
            (F.col("start") + F.col("pos") * F.col("step") + F.col("step")).alias("end"), "text",
        )
    )
    return given.unionByName(made)


def repair_timing(
    segments: DataFrame, keys: Sequence[str] = CLIP, *, cps_max: float = st.CPS_MAX, target_cps: float = st.TARGET_CPS
) -> DataFrame:
    """Segments spoken impossibly fast, or with all words at the front, lose their word times and
    stretch toward the next segment; `repaired` tells which."""
    order = Window.partitionBy(*keys).orderBy("start", "seg_id")
    n = tx.plain_chars(tx.strip("text"))
    broken = (tx.strip("text") != "") & (
        (tx.chars_per_second("text", "start", "end") > cps_max) | tx.front_loaded("words", "start", "end")
    )
    start = F.greatest(F.lit(0.0), F.col("start"))
    end = F.greatest(start + 0.05, F.col("end"))
    ideal = F.least(start + n / max(1.0, target_cps), F.col("_next") - st.GAP_PAD)
    return (
        segments.withColumn("_next", F.lead("start").over(order))
        .withColumn("repaired", broken)
        .withColumn("_s", F.when(broken, start).otherwise(F.col("start")))
        .withColumn("_e", F.when(broken, F.when(n > 0, F.greatest(end, ideal)).otherwise(end)).otherwise(F.col("end")))
        .withColumn("words", F.when(broken, F.array().cast(NO_WORDS)).otherwise(F.col("words")))
        .drop("_next", "start", "end")
        .withColumnsRenamed({"_s": "start", "_e": "end"})
    )


def timing_quality(segments: DataFrame, clips: DataFrame, keys: Sequence[str] = CLIP, *, coverage_min: float = 0.55, min_chars: int = 14) -> DataFrame:
    """`needs_fallback` per clip (`dur`): no segments, little coverage, or a long segment far too fast."""
    crushed = (tx.plain_chars("text") >= min_chars) & (tx.chars_per_second("text", "start", "end") > st.CPS_MAX)
    agg = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("_total"),
        F.bool_or(crushed).alias("_crushed"),
    )
    coverage = F.when(F.col("dur") <= 0.05, 1.0).otherwise(F.try_divide(F.coalesce("_total", F.lit(0.0)), F.col("dur")))
    return clips.join(agg, list(keys), "left").select(
        *keys,
        coverage.alias("coverage"),
        (F.col("_n").isNull() | (coverage < coverage_min) | F.coalesce("_crushed", F.lit(False))).alias("needs_fallback"),
    )


def choose_transcript(clip_segments: DataFrame, edit_segments: DataFrame, clips: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Per clip the recogniser's segments, or the edit stage's where their timing is bad and it has some."""
    quality = timing_quality(clip_segments, clips, keys)
    has_edit = edit_segments.select(*keys).distinct()
    use_edit = quality.where("needs_fallback").join(has_edit, list(keys), "left_semi").select(*keys)
    return clip_segments.join(use_edit, list(keys), "left_anti").unionByName(
        edit_segments.join(use_edit, list(keys), "left_semi"), allowMissingColumns=True
    )


# --- events --------------------------------------------------------------------------------------


def subtitle_events(segments: DataFrame, speech: DataFrame, *, tokenize: st.Tokenizer | None = None) -> DataFrame:
    """`vod_id, clip_id, ord, start, end, text`: timed subtitle events of each clip.

    A clip with word times is grouped by words; another by its segments' text.
    """
    keys = list(CLIP)
    repaired = repair_timing(segments.select(*keys, "seg_id", "start", "end", "text", "words"))
    has = F.max(F.coalesce(F.size("words"), F.lit(0)) > 0).over(Window.partitionBy(*keys))
    marked = repaired.withColumn("_has", has)
    pieces = st.word_pieces(flat_words(marked.where("_has"), keys), keys, tokenize).unionByName(st.segment_pieces(marked.where("not _has"), keys, tokenize))
    return st.timed(st.merged_short(pieces, keys), speech, keys)


# --- cues ----------------------------------------------------------------------------------------


def clamp_cues(cues: DataFrame, clips: DataFrame | None = None, keys: Sequence[str] = CLIP) -> DataFrame:
    """Cue times into `[0, dur]` at two decimals; cues under 0.05 s vanish. No `clips`: cues carry `dur`."""
    limit = F.greatest(F.lit(0.0), F.col("dur"))
    fit = lambda c: F.least(F.greatest(F.lit(0.0), py_round(c, 2)), limit)
    rounded = [c for c in ("vod_start", "vod_end") if c in cues.columns]
    out = (
        (cues if clips is None else cues.join(clips.select(*keys, "dur"), list(keys)))
        .withColumn("_s", fit("start"))
        .withColumn("_e", fit("end"))
        .where(F.col("_e") - F.col("_s") >= 0.05)
        .drop("start", "end", "dur")
        .withColumnsRenamed({"_s": "start", "_e": "end"})
    )
    return out.withColumns({c: py_round(c, 3) for c in rounded})


def slice_cues(cues: DataFrame, *, t0: float, dur: float) -> DataFrame:
    """Cues overlapping `[t0, t0 + dur]` by 0.05 s, counted from `t0`."""
    a, b = F.greatest("start", F.lit(float(t0))), F.least("end", F.lit(float(t0) + float(dur)))
    return (
        cues.withColumn("_s", a)
        .withColumn("_e", b)
        .where(F.col("_e") - F.col("_s") >= 0.05)
        .withColumn("start", py_round(F.col("_s") - t0, 2))
        .withColumn("end", py_round(F.col("_e") - t0, 2))
        .drop("_s", "_e")
    )


def _public(cues: DataFrame) -> list[str]:
    return [c for c in cues.columns if c not in ("_axis", "_old")]


def project_cues(cues: DataFrame, axis: DataFrame | None = None, keys: Sequence[str] = CLIP) -> DataFrame:
    """Clip times from recording times; cues inside a cut vanish, cues across a cut split (`_1`, …). No `axis`: cues carry it as `_axis`."""
    return _projected(with_axis(cues, axis, keys), _public(cues))


def _projected(c: DataFrame, columns: Sequence[str], *, pinned_only: bool = False) -> DataFrame:
    """Explode each cue into its pieces; unpinned cues stay as they are, or drop out if `pinned_only`."""
    pinned = F.col("vod_start").isNotNull() & F.col("vod_end").isNotNull()
    as_is = F.array(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))
    if pinned_only:
        as_is = F.slice(as_is, 1, 0)
    pieces = F.when(pinned, short_pieces(F.col("vod_start"), F.col("vod_end"), F.col("_axis"))).otherwise(as_is)
    c = c.withColumn("_pinned", pinned).select("*", F.posexplode_outer(pieces).alias("_j", "_p")).where(F.col("_p").isNotNull())
    suffix = F.when(F.col("_j") > 0, F.concat(F.lit("_"), F.col("_j").cast("string"))).otherwise("")
    two = lambda x: F.when(F.col("_pinned"), py_round(x, 2)).otherwise(F.col(x))
    return c.withColumns(
        {
            "cue_id": F.concat("cue_id", suffix), "start": two("_p.a"), "end": two("_p.b"),
            "vod_start": py_round("vod_start", 3), "vod_end": py_round("vod_end", 3),
        }
    ).select(*columns)


def pinned_again(c: Column, use: Column, axis: Column) -> Column:
    """`struct(start, end)` of a cue in recording time: anew from its clip times on `use` (else `axis`) if it was moved by more than
    0.08 s or never pinned."""
    vs, ve = c["vod_start"], c["vod_end"]
    at = F.struct(
        F.get(short_pieces(vs, ve, use), F.lit(0))["a"].alias("shown"), vod_time(c["start"], use).alias("us"), vod_time(c["end"], use).alias("ue"),
        vod_time(c["start"], axis).alias("ns"), vod_time(c["end"], axis).alias("ne"),
    )

    def bounds(v: Column) -> Column:
        pinned = vs.isNotNull() & ve.isNotNull()
        shifted = F.coalesce(F.abs(v["shown"] - c["start"]) > 0.08, F.lit(False))
        a = F.when(pinned & shifted, v["us"]).when(pinned, vs).otherwise(F.coalesce(v["us"], v["ns"]))
        b = F.when(pinned & shifted, v["ue"]).when(pinned, ve).otherwise(F.when(v["us"].isNotNull(), v["ue"]).otherwise(v["ne"]))
        return F.struct(a.alias("a"), b.alias("b"))

    def known(v: Column) -> Column:
        lost = v["a"].isNull() | v["b"].isNull()
        return F.struct(F.when(lost, vs).otherwise(v["a"]).alias("start"), F.when(lost, ve).otherwise(v["b"]).alias("end"))

    return let(let(at, bounds), known)


def ingest_cues(cues: DataFrame, old_axis: DataFrame | None = None, new_axis: DataFrame | None = None, keys: Sequence[str] = CLIP) -> DataFrame:
    """Pin cues to recording time, then lay them on the new axis.

    A cue the user moved by more than 0.08 s on the old axis is pinned anew from its clip times. A
    clip without an old axis uses the new one. An axis that isn't given is in the cues, as `_old` or `_axis`.
    """
    c = with_axis(with_axis(cues, old_axis, keys, out="_old"), new_axis, keys)
    cue = F.struct("start", "end", "vod_start", "vod_end")
    c = c.withColumn("_at", let(F.struct(cue.alias("c"), F.coalesce("_old", "_axis").alias("use"), F.col("_axis").alias("axis")), lambda v: pinned_again(v["c"], v["use"], v["axis"])))
    c = c.withColumns({"vod_start": F.col("_at.start"), "vod_end": F.col("_at.end")})
    # A span without length has no pieces on the axis, so it drops out below.
    return _projected(c, _public(cues), pinned_only=True)


def pieces_of(c: Column, axis: Column, *, pinned_only: bool = False) -> Column:
    """A cue as an array of `cue_id, start, end, vod_start, vod_end` of its pieces on an axis, as `_projected` has them in rows."""
    pinned = c["vod_start"].isNotNull() & c["vod_end"].isNotNull()
    vs, ve = py_round(c["vod_start"], 3).alias("vod_start"), py_round(c["vod_end"], 3).alias("vod_end")
    as_is = F.array(F.struct(c["cue_id"].alias("cue_id"), c["start"].alias("start"), c["end"].alias("end"), vs, ve))
    suffix = lambda j: F.when(j > 0, F.concat(F.lit("_"), j.cast("string"))).otherwise("")
    laid = F.transform(
        short_pieces(c["vod_start"], c["vod_end"], axis),
        lambda p, j: F.struct(F.concat(c["cue_id"], suffix(j)).alias("cue_id"), py_round(p["a"], 2).alias("start"), py_round(p["b"], 2).alias("end"), vs, ve),
    )
    return F.when(pinned, F.coalesce(laid, F.slice(as_is, 1, 0))).otherwise(F.slice(as_is, 1, 0) if pinned_only else as_is)


def transcript_of_clips(segments: DataFrame, axis: DataFrame, keywords: Sequence[str], keys: Sequence[str] = CLIP) -> DataFrame:
    """A row for each clip of `axis`: `keys`, its `_axis`, `longest` (its end) and `fresh`, the cues of its recording's transcript
    (`vod_id, ord, start, end, text`) as an array of `cue_id, start, end, vod_start, vod_end, raw, text`; `raw` is the text without marks.

    A clip none of whose segments touches its axis takes the times as clip times already. Keywords are marked once a
    segment, and clips pick their segments from arrays of a time cell, so no pair of clip and segment is shuffled.
    """
    seg = segments.select("vod_id", F.col("ord").alias("i"), "start", "end", tx.strip("text").alias("raw")).where(F.col("raw") != "")
    seg = seg.withColumn("text", tx.to_markup(fresh_words("raw", keywords)))
    piece = F.struct("ord", "vod_start", "vod_end", "short_start", "short_end")
    clips = axis.groupBy(*keys).agg(
        F.min("vod_start").alias("start"), F.max("vod_end").alias("end"), F.array_sort(F.collect_list(piece)).alias("_axis"),
        F.max_by("short_end", "ord").alias("dur"), F.max("short_end").alias("longest"),
    )
    ax = F.col("_axis")

    near = near_spans(clips, seg, order=["i"])
    # Tested by itself, so that the clips without pieces needn't be laid.
    met = F.exists("_near", lambda x: F.exists(ax, lambda p: F.least(x["end"], p["vod_end"]) - F.greatest(x["start"], p["vod_start"]) >= 0.05))
    # Only segments at the beginning of a recording can lie within a clip's length.
    bare = near.where(~met).select(*keys, F.lit(0.0).alias("start"), F.col("dur").alias("end"), "_axis", "dur", "longest")
    fit = lambda c: F.least(F.greatest(F.lit(0.0), py_round(c, 2)), F.greatest(F.lit(0.0), F.col("dur")))
    local = F.transform(
        F.filter("_near", lambda x: x["end"] <= F.col("dur") + 0.5),
        lambda x: F.struct(
            F.concat(F.lit("s"), x["i"].cast("string")).alias("cue_id"), fit(x["start"]).alias("start"), fit(F.least(x["end"], F.col("dur"))).alias("end"),
            F.lit(None).cast("double").alias("vod_start"), F.lit(None).cast("double").alias("vod_end"), x["raw"].alias("raw"), x["text"].alias("text"),
        ),
    )
    local = near_spans(bare, seg, order=["i"]).withColumn("fresh", F.filter(local, lambda c: c["end"] - c["start"] >= 0.05))
    columns = [*keys, "_axis", "longest", "fresh"]
    pieces = laid(F.col("_near")["start"], F.col("_near")["end"], *[ax[c] for c in ("vod_start", "vod_end", "short_start", "short_end")])

    def named(p: Column) -> Column:
        x = F.get("_near", p["k"])
        cue_id = F.concat(F.lit("t"), x["i"].cast("string"), F.lit("_"), p["j"].cast("string")).alias("cue_id")
        return F.struct(cue_id, *[p[c].alias(c) for c in ("start", "end", "vod_start", "vod_end")], x["raw"].alias("raw"), x["text"].alias("text"))

    touched = near.withColumn("_laid", pieces).where(F.size("_laid") > 0).withColumn("fresh", F.transform("_laid", named))
    return touched.select(*columns).unionByName(local.select(*columns))


def fresh_words(raw: Column | str, keywords: Sequence[str]) -> Column:
    return tx.mark_keywords(tx.parse_markup(raw), keywords)


def cues_from_transcript(
    segments: DataFrame, axis: DataFrame, keywords: Sequence[str], keys: Sequence[str] = CLIP
) -> DataFrame:
    """Cues of each clip from its recording's transcript, a row each (see `transcript_of_clips`)."""
    # The plain explode would push "not empty" down and compute the array once more for it.
    rows = transcript_of_clips(segments, axis, keywords, keys).select(*keys, F.explode_outer("fresh").alias("f")).where(F.col("f").isNotNull())
    return rows.select(*keys, *[f"f.{c}" for c in ("cue_id", "start", "end", "vod_start", "vod_end")], fresh_words("f.raw", keywords).alias("words"), "f.text")


def cue_text(c: Column | str = "words") -> Column:
    return F.replace(tx.words_text(c), F.lit("\n"), F.lit(""))


def shown_text(text: Column | str) -> Column:
    """`cue_text` of a marked-up text; one without marks isn't taken apart."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    bare = ~c.contains("**") & ~c.contains("\\n") & ~c.contains("\r")
    return F.when(bare, F.replace(c, F.lit("\n"), F.lit(""))).otherwise(cue_text(tx.parse_markup(c)))


def plain_text(cues: DataFrame) -> Column:
    """The shown text of cues, from their words if they carry any."""
    return cue_text() if "words" in cues.columns else shown_text("text")


@F.pandas_udf(ArrayType(DoubleType()))
def shared_seconds(starts: pd.Series, ends: pd.Series, other_starts: pd.Series, other_ends: pd.Series) -> pd.Series:
    """How many seconds each span of a row shares with the other spans of the row, all together, from running sums."""

    def one(a, b, x, y):
        if len(a) == 0 or len(x) == 0:
            return np.zeros(len(a))
        x, y, zero = np.sort(x), np.sort(y), x.min()
        x, y = x - zero, y - zero
        sx, sy = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))

        def until(t):  # seconds of the other spans before t
            i, j = np.searchsorted(x, t), np.searchsorted(y, t)
            return (i * t - sx[i]) - (j * t - sy[j])

        return np.maximum(0.0, until(b - zero) - until(a - zero))

    return pd.Series([one(*row) for row in zip(starts, ends, other_starts, other_ends)])


def has_times(c: Column) -> Column:
    """Whether a cue has a span in recording time."""
    return F.coalesce(c["vod_start"].isNotNull() & c["vod_end"].isNotNull() & (c["vod_end"] > c["vod_start"]), F.lit(False))


def missing_of_clips(clips: DataFrame, fresh: str, spans: str, texts: str, text: Callable[[Column], Column]) -> DataFrame:
    """Rows of clips with only the missing ones in the array `fresh` (see `missing_cues`). `spans`: an array of the existing cues'
    `start, end` in recording time, `texts` their texts, `text` the plain text of a fresh cue."""
    at = lambda c: F.transform(fresh, lambda f: F.when(has_times(f), f[c]).otherwise(0.0))
    shared = shared_seconds(at("vod_start"), at("vod_end"), F.col(spans)["start"], F.col(spans)["end"])

    # Texts are looked up by their hashes; a place found is checked, so that equal hashes of other texts do no harm.
    hashes = lambda c, x: F.transform(c, lambda f: F.xxhash64(x(f)))
    untimed = lambda f: F.when(~has_times(f), text(f))
    found = places(hashes(fresh, untimed), hashes(texts, lambda x: x))

    def missing(f: Column, i: Column) -> Column:
        little = F.get("_shared", i) / (f["vod_end"] - f["vod_start"]) < 0.35
        k = F.get("_place", i)
        known = F.when(k < 0, False).otherwise((F.get(texts, k) == text(f)) | F.array_contains(texts, text(f)))
        return F.when(has_times(f), little).otherwise(~known)

    return clips.withColumns({"_shared": shared, "_place": found}).withColumn(fresh, F.filter(fresh, missing)).drop("_shared", "_place")


def missing_cues(fresh: DataFrame, existing: DataFrame, keys: Sequence[str] = CLIP) -> DataFrame:
    """Fresh cues that the existing ones cover by less than 35 % (in recording time).

    Cues without recording times count as missing when no existing cue has the same text. Both sides come together once a
    clip, as arrays; covered seconds are differences of running sums, so cues are never paired with each other.
    """
    span = F.when(has_times(F.struct("vod_start", "vod_end")), F.struct(F.col("vod_start").alias("start"), F.col("vod_end").alias("end")))
    # Only fresh cues without times look for equal texts, so texts travel as a set.
    old = existing.select(*keys, span.alias("_span"), F.nullif(plain_text(existing), F.lit("")).alias("_plain"))
    old = old.groupBy(*keys).agg(F.collect_list("_span").alias("_spans"), F.collect_set("_plain").alias("_texts"))
    new = fresh.withColumn("_plain", F.when(~has_times(F.struct("vod_start", "vod_end")), plain_text(fresh)))
    new = new.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in new.columns if c not in keys])).alias("_fresh"))
    clips = new.join(old, list(keys), "left").withColumns(
        {"_spans": F.coalesce("_spans", F.array().cast("array<struct<start:double,end:double>>")), "_texts": F.coalesce("_texts", F.array().cast("array<string>"))}
    )
    left = missing_of_clips(clips, "_fresh", "_spans", "_texts", lambda f: f["_plain"])
    # The plain explode would push "not empty" down and compute the array once more for it.
    rows = left.select(*keys, F.explode_outer("_fresh").alias("f")).where(F.col("f").isNotNull())
    return rows.select(*[c if c in keys else F.col("f")[c].alias(c) for c in fresh.columns])


def missing_in_clips(clips: DataFrame, fresh: str, existing: str, keys: Sequence[str] = CLIP) -> DataFrame:
    """As `missing_cues` for rows of clips that have both kinds of cues as arrays of `cue_id, vod_start, vod_end, text`: rows of the missing
    ones. No cue is shuffled."""
    timed = F.filter(existing, has_times)
    plain = F.filter(F.transform(existing, lambda c: shown_text(c["text"])), lambda x: x != "")
    # Texts are needed where a fresh cue has no times.
    plain = F.when(F.exists(fresh, lambda f: ~has_times(f)), plain).otherwise(F.array().cast("array<string>"))
    c = clips.select(*keys, F.col(fresh).alias("_fresh"), F.transform(timed, lambda c: F.struct(c["vod_start"].alias("start"), c["vod_end"].alias("end"))).alias("_spans"), plain.alias("_texts"))
    left = missing_of_clips(c, "_fresh", "_spans", "_texts", lambda f: shown_text(f["text"]))
    return left.select(*keys, F.explode_outer("_fresh").alias("f")).where(F.col("f").isNotNull()).select(*keys, "f.*")
