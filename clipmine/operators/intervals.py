"""Interval algebra per key: merge, complement, keep axis, remapping."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions.spans import let, py_round
from clipmine.operators.joins import overlapping_spans, points_in_windows


def islands(
    df: DataFrame, keys: Sequence[str], *, start: str, end: str, gap: Column | float = 0.0,
    touching: bool = True, name: str = "island",
) -> DataFrame:
    """Number the groups of rows that are chained by gaps of at most `gap` (below it if not `touching`)."""
    g = gap if isinstance(gap, Column) else F.lit(float(gap))
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    dist = F.col(start) - reach
    breaks = (dist > g) if touching else (dist >= g)
    return df.withColumn("_new", F.when(reach.isNull() | breaks, 1).otherwise(0)).withColumn(
        name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def merge_intervals(iv: DataFrame, gap: float, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """Merge intervals whose gap is at most `gap`.

    Intervals starting within half a gap of each other belong together whatever lies between, so they
    are first folded by a plain aggregate (combined before the shuffle). What is left for the ordered
    pass is at most two rows per gap length of the time line, however many intervals came in.
    """
    cell = F.floor(F.col("start") / (gap / 2)) if gap > 0 else F.col("start")
    folded = iv.groupBy(*keys, cell.alias("_cell")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return (
        islands(folded.drop("_cell"), keys, start="start", end="end", gap=gap)
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


SPANS = "array<struct<start: double, end: double>>"


def merged_spans(spans: Column) -> Column:
    """The spans of an array, in order of their starts, joined where they meet: as `merge_intervals` without a gap."""
    kind = f"struct<done: {SPANS}, start: double, end: double>"
    state = lambda done, a, b: F.struct(done.alias("done"), a.alias("start"), b.alias("end")).cast(kind)
    grown = lambda s: F.concat(s["done"], F.array(_span(s["start"], s["end"])))

    def step(s: Column, x: Column) -> Column:
        return (
            F.when(s["end"].isNull(), state(s["done"], x["start"], x["end"]))
            .when(x["start"] - s["end"] > 0, state(grown(s), x["start"], x["end"]))
            .otherwise(state(s["done"], s["start"], F.greatest(s["end"], x["end"])))
        )

    none = F.lit(None).cast("double")
    return F.aggregate(F.array_sort(spans), state(F.array().cast(SPANS), none, none), step, lambda s: F.when(s["end"].isNull(), s["done"]).otherwise(grown(s)))


def remaining(cuts: Column, dur: Column, *, min_len: float = 0.05) -> Column:
    """What is left of `[0, dur)` without the merged spans of an array, as an array."""
    at = F.concat(F.array(F.lit(0.0)), F.transform(cuts, lambda x: x["end"]))
    upto = F.concat(F.transform(cuts, lambda x: F.least(x["start"], dur)), F.array(dur.cast("double")))
    return F.filter(F.zip_with(at, upto, _span), lambda p: p["end"] - p["start"] >= min_len)


def clamped_spans(cuts: Column, dur: Column) -> Column:
    """Spans clamped into `[0, dur]`, tiny ones dropped, at three decimals, merged where they touch."""
    inside = lambda t: F.least(F.greatest(F.lit(0.0), t), dur)
    kept = F.filter(F.transform(cuts, lambda x: _span(inside(x["start"]), inside(x["end"]))), lambda x: x["end"] - x["start"] >= 0.05)
    return merged_spans(F.transform(kept, lambda x: _span(py_round(x["start"], 3), py_round(x["end"], 3))))


def _cuts_of(windows: DataFrame, cuts: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Each window's `dur` and its cuts, as an array `_c`."""
    lists = cuts.groupBy(*keys).agg(F.collect_list(_span(F.col("start"), F.col("end"))).alias("_c"))
    return windows.select(*keys, "dur").join(lists, list(keys), how).withColumn("_c", F.coalesce("_c", F.array().cast(SPANS)))


def _rows(df: DataFrame, keys: Sequence[str], spans: Column) -> DataFrame:
    return df.select(*keys, F.explode_outer(spans).alias("p")).where(F.col("p").isNotNull()).select(*keys, "p.start", "p.end")


def complement(windows: DataFrame, cuts: DataFrame, keys: Sequence[str], *, min_len: float = 0.05) -> DataFrame:
    """What is left of each window `[0, dur)` after removing its cuts; pieces of at least `min_len`."""
    c = _cuts_of(windows, cuts.where(F.col("end") > F.col("start")), keys, "left")
    return _rows(c, keys, let(merged_spans(F.col("_c")), lambda m: remaining(m, F.col("dur"), min_len=min_len)))


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))


def keep_axis(pieces: DataFrame, keys: Sequence[str] = ("vod_id", "clip_id"), *, digits: int = 3) -> DataFrame:
    """Lay the pieces of a clip end to end in `ord` order; pieces under 0.05 s vanish."""
    order = Window.partitionBy(*keys).orderBy("ord")
    dur = F.col("end") - F.col("start")
    p = pieces.where(dur >= 0.05).withColumn("_dur", dur)
    before = F.coalesce(F.sum("_dur").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return p.select(
        *keys,
        F.row_number().over(order).alias("ord"),
        py_round("start", digits).alias("vod_start"),
        py_round("end", digits).alias("vod_end"),
        py_round(before, digits).alias("short_start"),
        py_round(before + F.col("_dur"), digits).alias("short_end"),
        F.lead("ord").over(order).isNull().alias("is_last"),
    )


def play_order(pieces: DataFrame, orders: DataFrame, keys: Sequence[str] = ("vod_id", "clip_id")) -> DataFrame:
    """Re-number pieces by the clip's `play_order` array; anything but a permutation means identity."""
    by_time = Window.partitionBy(*keys).orderBy("start")
    whole = Window.partitionBy(*keys)
    idx = F.row_number().over(by_time) - 1
    n = F.count(F.lit(1)).over(whole)
    p = pieces.withColumn("_idx", idx).withColumn("_n", n).join(orders.select(*keys, "play_order"), list(keys), "left")
    return p.withColumn("ord", place_of(F.col("_idx"), F.col("_n"), F.col("play_order"))).drop("_idx", "_n", "play_order")


def place_of(idx: Column, n: Column, order: Column) -> Column:
    """Where the piece `idx` of `n` is played; an `order` that isn't a permutation means in order of time."""
    valid = F.coalesce(F.sort_array(order) == F.sequence(F.lit(0), n.cast("int") - 1), F.lit(False))
    return F.when(valid, F.array_position(order, idx).cast("int") - 1).otherwise(idx).cast("int")


def cut_offsets(cuts: DataFrame, keys: Sequence[str] = ("vod_id", "clip_id")) -> DataFrame:
    """Add `offset`: where each cut begins on the clip's own time line."""
    order = Window.partitionBy(*keys).orderBy("ord")
    before = F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return cuts.withColumn("offset", F.coalesce(before, F.lit(0.0)))


def remap_points(points: DataFrame, cuts: DataFrame, *, clip: str = "clip_id", point_id: Sequence[str], **kw) -> DataFrame:
    """Recording time to clip time through sorted cuts; points outside every cut are dropped.

    A point on the seam of two cuts belongs to the earlier one.
    """
    pairs = points_in_windows(points, cut_offsets(cuts, ("vod_id", clip)), closed=True, **kw).where(
        F.col("w_end") > F.col("w_start")
    )
    rest = [c for c in points.columns if c not in ("vod_id", "t", *point_id)]
    return (
        pairs.groupBy("vod_id", F.col("w_" + clip).alias(clip), *point_id)
        .agg(
            F.min_by(F.col("w_offset") + (F.col("t") - F.col("w_start")), "w_ord").alias("t"),
            *[F.first(c).alias(c) for c in rest],
        )
    )


def remap_spans(
    spans: DataFrame, cuts: DataFrame, *, clip: str = "clip_id", min_overlap: float = 0.05, **kw
) -> DataFrame:
    """Clip spans to the cuts and shift them onto the clip's time line; one row per (span, cut)."""
    pairs = overlapping_spans(spans, cut_offsets(cuts, ("vod_id", clip)), **kw)
    lo, hi = F.greatest("start", "w_start"), F.least("end", "w_end")
    rest = [c for c in spans.columns if c not in ("vod_id", "start", "end")]
    return pairs.where(hi - lo >= min_overlap).select(
        "vod_id",
        F.col("w_" + clip).alias(clip),
        F.col("w_ord").alias("ord"),
        (lo - F.col("w_start") + F.col("w_offset")).alias("start"),
        (hi - F.col("w_start") + F.col("w_offset")).alias("end"),
        *rest,
    )


def remap_speech(speech: DataFrame, cuts: DataFrame, *, clip: str = "clip_id", **kw) -> DataFrame:
    """Voice intervals on each clip's time line, joined again across cuts that touch."""
    return merge_intervals(remap_spans(speech, cuts, clip=clip, **kw), 0.08, ("vod_id", clip))


def remap_transcript(segments: DataFrame, cuts: DataFrame, *, clip: str = "clip_id", **kw) -> DataFrame:
    from clipmine.functions.text import strip

    s = segments.select("vod_id", "seg_id", "start", "end", strip("text").alias("text")).where(F.col("text") != "")
    return remap_spans(s, cuts, clip=clip, **kw)


def slice_transcript(segments: DataFrame, windows: DataFrame, *, ids: Sequence[str], **kw) -> DataFrame:
    """Segments overlapping a window, clipped and counted from its start."""
    pairs = overlapping_spans(segments.select("vod_id", "seg_id", "start", "end", "text"), windows.select("vod_id", *ids, "start", "end"), **kw)
    return pairs.select(
        "vod_id",
        *[F.col("w_" + c).alias(c) for c in ids],
        "seg_id",
        (F.greatest("start", "w_start") - F.col("w_start")).alias("start"),
        (F.least("end", "w_end") - F.col("w_start")).alias("end"),
        "text",
    ).where(F.col("end") > F.col("start"))


def with_axis(df: DataFrame, axis: DataFrame | None, keys: Sequence[str] = ("vod_id", "clip_id"), *, out: str = "_axis") -> DataFrame:
    """Attach each clip's keep axis as one short array: one join serves every mapping of the row.

    None: the rows carry it already. Rows that come from a range join with clips should get it there, with the clips, because
    there are far fewer clips to shuffle than pairs of clips and rows.
    """
    if axis is None:
        return df
    piece = F.struct("ord", "vod_start", "vod_end", "short_start", "short_end")
    per_clip = axis.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias(out))
    return df.join(per_clip, list(keys), "left")


def _first_hit(axis: Column, t: Column, lo: str, hi: str, value) -> Column:
    """`value(piece)` of the first piece holding `t`; only the last piece includes its end."""
    n = F.size(axis)
    hits = F.filter(
        F.transform(
            axis,
            lambda p, i: F.when(
                (p[lo] - 1e-6 <= t) & F.when(i == n - 1, t <= p[hi] + 1e-6).otherwise(t < p[hi] - 1e-9), py_round(value(p), 3)
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return F.get(hits, F.lit(0))


def short_time(t: Column, axis: Column) -> Column:
    """Recording time to clip time on an axis array; NULL inside a cut."""
    return _first_hit(axis, t, "vod_start", "vod_end", lambda p: p["short_start"] + (t - p["vod_start"]))


def vod_time(t: Column, axis: Column) -> Column:
    """Clip time to recording time; past the end it is the end of the last piece."""
    at = F.greatest(F.lit(0.0), t)
    inside = _first_hit(axis, at, "short_start", "short_end", lambda p: p["vod_start"] + (at - p["short_start"]))
    last = F.get(axis, F.size(axis) - 1)
    return F.when(t.isNotNull(), F.coalesce(inside, F.when(at > last["short_end"], last["vod_end"])))


def short_pieces(start: Column, end: Column, axis: Column) -> Column:
    """A recording span on the clip time line: array of `(a, b)`, pieces of at least 0.05 s."""
    kept = F.filter(axis, lambda p: F.least(end, p["vod_end"]) - F.greatest(start, p["vod_start"]) >= 0.05)
    place = lambda p, t: py_round(p["short_start"] + (t - p["vod_start"]), 3)
    return F.when(
        end > start,
        F.transform(
            kept,
            lambda p: F.struct(
                place(p, F.greatest(start, p["vod_start"])).alias("a"), place(p, F.least(end, p["vod_end"])).alias("b")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<a:double,b:double>>"))


def to_short(points: DataFrame, axis: DataFrame, *, keys=("vod_id", "clip_id"), t: str = "t", out: str = "short_t") -> DataFrame:
    return with_axis(points, axis, keys).withColumn(out, short_time(F.col(t), F.col("_axis"))).drop("_axis")


def to_vod(points: DataFrame, axis: DataFrame, *, keys=("vod_id", "clip_id"), t: str = "t", out: str = "vod_t") -> DataFrame:
    return with_axis(points, axis, keys).withColumn(out, vod_time(F.col(t), F.col("_axis"))).drop("_axis")


def remap_between(points: DataFrame, old_axis: DataFrame, new_axis: DataFrame, *, keys=("vod_id", "clip_id"), t: str = "t", out: str = "new_t") -> DataFrame:
    """Clip time on the old axis to clip time on the new one."""
    both = with_axis(with_axis(points, old_axis, keys, out="_old"), new_axis, keys, out="_new")
    return both.withColumn("_vod", vod_time(F.col(t), F.col("_old"))).withColumn(out, short_time(F.col("_vod"), F.col("_new"))).drop("_old", "_new", "_vod")


def padded_window(spans: DataFrame, *, pad_max: float = 60.0) -> DataFrame:
    """Widen each span by its pads (at most `pad_max`, inside the recording); adds `dur`."""
    pad = lambda c: F.least(F.lit(pad_max), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))))
    before = F.least(pad("pad_before"), F.greatest(F.lit(0.0), F.col("start")))
    room = F.greatest(F.lit(0.0), F.col("duration_sec") - F.col("end"))
    after = F.when(F.col("duration_sec") > 0, F.least(pad("pad_after"), room)).otherwise(pad("pad_after"))
    return (
        spans.withColumn("pad_before", before)
        .withColumn("pad_after", after)
        .withColumn("win_start", F.col("start") - F.col("pad_before"))
        .withColumn("win_end", F.col("end") + F.col("pad_after"))
        .withColumn("dur", F.greatest(F.lit(0.01), F.col("win_end") - F.col("win_start")))
    )


def clamp_cuts(cuts: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cuts clamped into their window (`dur`), tiny ones dropped, three decimals, merged when touching."""
    return _rows(_cuts_of(windows, cuts, keys, "inner"), keys, clamped_spans(F.col("_c"), F.col("dur")))
