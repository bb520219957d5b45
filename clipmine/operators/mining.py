"""Chat lexicon mining and alignment of a reference text."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine import lexicon
from clipmine.functions import text as tx
from clipmine.functions.spans import let
from clipmine.functions.spans import py_round


def _texts(chat: DataFrame) -> DataFrame:
    return chat.withColumn("message", tx.strip("message")).where(F.col("message") != "")


def pattern_hits(chat: DataFrame, patterns: Mapping[str, str] = lexicon.MINING_PATTERNS, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """Messages matching each pattern, one pass: `keys, pattern, hits`."""
    wide = _texts(chat).groupBy(*keys).agg(*[F.count_if(F.col("message").rlike(p)).alias(n) for n, p in patterns.items()])
    return wide.unpivot(list(keys), list(patterns), "pattern", "hits").where(F.col("hits") > 0)


def pattern_samples(
    chat: DataFrame, patterns: Mapping[str, str] = lexicon.MINING_PATTERNS, *, n: int | None = 10, width: int | None = 100, keys: Sequence[str] = ("vod_id",)
) -> DataFrame:
    """The first `n` matching messages per pattern (by `seq`); a bounded top-k, not a sorted group. `n` and `width` may be None: all."""
    names = F.filter(
        F.array(*[F.when(F.col("message").rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull()
    )
    hits = _texts(chat).select(
        *keys, "seq", py_round("t", 1).alias("t"), (F.col("message") if width is None else F.left("message", F.lit(width))).alias("message"), F.explode(names).alias("pattern")
    )
    order = Window.partitionBy(*keys, "pattern").orderBy("seq")
    numbered = hits.withColumn("ord", F.row_number().over(order)).drop("seq")
    return numbered if n is None else numbered.where(F.col("ord") <= n)


def cue_rows(chat: DataFrame, cue: str = lexicon.CLIP_CUE, *, n: int | None = 20, width: int | None = 120, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """The first `n` messages that ask for a clip: `keys, ord, t, message` (None: all)."""
    rows = _texts(chat).where(F.col("message").rlike(cue)).withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    rows = rows if n is None else rows.where(F.col("ord") <= n)
    return rows.select(*keys, "ord", py_round("t", 1).alias("t"), (F.col("message") if width is None else F.left("message", F.lit(width))).alias("message"))


def top_tokens(
    chat: DataFrame, *, pattern: str = lexicon.MINING_TOKEN, max_len: int | None = 40, n: int | None = 30, keys: Sequence[str] = ("vod_id",)
) -> DataFrame:
    """The `n` most frequent tokens of messages of up to `max_len` characters; equal counts in token order. None: all."""
    short = _texts(chat) if max_len is None else _texts(chat).where(F.length("message") <= max_len)
    tokens = short.select(*keys, F.explode_outer(F.regexp_extract_all("message", F.lit(pattern), 0)).alias("token")).where(F.col("token").isNotNull())
    counts = tokens.groupBy(*keys, F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "token")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def align_reference(
    segments: DataFrame, references: DataFrame, *, step: float = 1.5, keys: Sequence[str] = ("vod_id",)
) -> DataFrame:
    """Slide each reference text (`vod_id, ref_id, ref_text, ref_dur`) over its recording's transcript.

    Returns the first best window by bigram Jaccard. Pairs of characters are compared where a window's text is put together;
    none is ever shuffled.
    """
    from clipmine.operators.joins import window_text

    bounds = segments.groupBy("vod_id").agg(F.min_by("start", "seg_id").alias("m0"), F.max_by("end", "seg_id").alias("m1"))
    n = F.ceil((F.col("m1") - F.col("m0")) / step).cast("int")
    dur = F.greatest(F.lit(3.0), F.col("ref_dur"))
    starts = (
        references.join(bounds, "vod_id")
        .where(F.col("m1") > F.col("m0"))
        .select("vod_id", "ref_id", "ref_text", "m0", "m1", dur.alias("dur"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        .withColumn("start", F.col("m0") + F.col("i") * step)
        .where(F.col("start") < F.col("m1"))
        .withColumn("end", F.least("m1", F.col("start") + F.col("dur")))
    )
    # A window belongs to one reference, so it takes that text along and both sets of pairs meet within its row.
    rows = starts.select("vod_id", "ref_id", "i", "ref_text", "start", "end")
    text = window_text(segments, rows, ids=["ref_id", "i", "ref_text"])
    # Bound, so that both sets are made once a row.
    sets = F.struct(tx.alignment_bigrams("text").alias("a"), tx.alignment_bigrams("ref_text").alias("b"))
    score = let(sets, lambda v: let(F.size(F.array_intersect(v["a"], v["b"])), lambda n: F.try_divide(n, F.size(v["a"]) + F.size(v["b"]) - n)))
    scored = text.select("vod_id", "ref_id", "i", score.alias("score"))
    # A window that shares nothing isn't the best one of any reference.
    best = scored.groupBy("vod_id", "ref_id").agg(F.max_by(F.struct("i", "score"), F.when(F.col("score") > 0, F.struct("score", -F.col("i")))).alias("b"))
    first = starts.where("i = 0").select("vod_id", "ref_id", "m0", "m1", "dur")
    start = F.col("m0") + F.coalesce("b.i", F.lit(0)) * step
    return first.join(best, ["vod_id", "ref_id"], "left").select(
        "vod_id", "ref_id", start.alias("start"), F.least("m1", start + F.col("dur")).alias("end"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"),
    )


def nearest_highlight(aligned: DataFrame, highlights: DataFrame, *, tolerance: float) -> DataFrame:
    """The highlight whose bounds are closest to the aligned window, and whether both are within tolerance.

    Distances count at nine decimals, so that equal ones tie; the smaller id wins."""
    h = highlights.select("vod_id", F.col("id").alias("highlight_id"), F.col("start").alias("h0"), F.col("end").alias("h1"))
    ds, de = F.abs(F.col("h0") - F.col("start")), F.abs(F.col("h1") - F.col("end"))
    return (
        aligned.join(h, "vod_id")
        .groupBy("vod_id", "ref_id", "start", "end", "score")
        .agg(F.min_by(F.struct("highlight_id", ds.alias("delta_start"), de.alias("delta_end")), F.struct(F.round(ds + de, 9), "highlight_id")).alias("h"))
        .select("vod_id", "ref_id", "start", "end", "score", "h.*")
        .withColumn("pass", (F.col("delta_start") <= tolerance) & (F.col("delta_end") <= tolerance))
    )
