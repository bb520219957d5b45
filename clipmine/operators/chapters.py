"""Topic chapters: fixed blocks, cut where neighbouring blocks share few character pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.lexicon import CJK
from clipmine.operators.joins import overlapping_spans

KEYS = ("vod_id",)


def _blocks(vods: DataFrame, block_sec: float) -> DataFrame:
    n = F.ceil(F.col("duration_sec") / block_sec).cast("int")
    return (
        vods.where(F.col("duration_sec") > 0)
        .select("vod_id", "duration_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
        .select(
            "vod_id", "block", (F.col("block") * block_sec).alias("start"),
            F.least("duration_sec", (F.col("block") + 1) * block_sec).alias("end"),
        )
    )


def _span_pairs(segments: DataFrame, spans: DataFrame, span_id: str, char_class: str) -> DataFrame:
    """Character pairs of the segments of each span: `vod_id, span_id, grams, at`.

    The pair across two neighbouring segments is found from the previous segment's last character,
    so no span's text is ever put together in one place. `at` is a number below which all pairs of earlier segments have theirs.
    """
    s = segments.select("vod_id", "seg_id", "start", "end", tx.only_chars("text", char_class).alias("chars"))
    s = s.where(F.col("chars") != "")
    pairs = overlapping_spans(s, spans.select("vod_id", span_id, "start", "end"))
    flat = pairs.select("vod_id", F.col("w_" + span_id).alias(span_id), "seg_id", "chars")
    order = Window.partitionBy("vod_id", span_id).orderBy("seg_id")
    lead_in = F.coalesce(F.right(F.lag("chars").over(order), F.lit(1)), F.lit(""))
    before = F.coalesce(F.sum(F.length("chars")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = flat.select("vod_id", span_id, F.concat(lead_in, "chars").alias("chars"), before.alias("at")).where(F.length("chars") >= 2)
    # A look-ahead takes a pair at every character, in one pass of the pattern engine.
    grams = F.regexp_extract_all("chars", F.lit("(?s)(?=(..))"), F.lit(1))
    return text.select("vod_id", span_id, grams.alias("grams"), "at")


def topic_chapters(
    segments: DataFrame, vods: DataFrame, *, block_sec: float = 120.0, threshold: float = 0.12,
    min_sec: float = 180.0, max_sec: float = 900.0, char_class: str = tx.WORD_CHARS,
) -> DataFrame:
    """`vod_id, id, start, end`: chapters cut at topic changes and split at `max_sec`.

    A block without text takes over its predecessor's pairs, so only neighbouring blocks *with* text
    are compared, and the cut lies right before the later one.
    """
    blocks = _blocks(vods, block_sec)
    # The rows of a block are together already (for the pair across segments), so its set needs no
    # further shuffle; a set is bounded by the alphabet's pairs, not by the rows.
    sets = _span_pairs(segments, blocks, "block", char_class).groupBy("vod_id", "block").agg(
        F.array_distinct(F.flatten(F.collect_list(F.array_distinct("grams")))).alias("g")
    )
    order = Window.partitionBy("vod_id").orderBy("block")
    steps = sets.withColumn("_prev", F.lag("g").over(order)).withColumn("_sim", tx.jaccard("g", "_prev"))
    cuts = steps.where(F.col("_prev").isNotNull() & (F.col("_sim") < threshold)).select("vod_id", "block", F.lit(1).alias("cut"))
    short = vods.select("vod_id", (F.col("duration_sec") <= min_sec).alias("_short"))
    chained = (
        blocks.join(cuts, ["vod_id", "block"], "left")
        .join(short, "vod_id")
        .withColumn("part", F.sum(F.when(F.col("_short"), 0).otherwise(F.coalesce("cut", F.lit(0)))).over(order))
        .groupBy("vod_id", "part", "_short")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    span = F.col("end") - F.col("start")
    n = F.when(F.col("_short"), 1).otherwise(F.greatest(F.lit(1), F.ceil((span - 1e-6) / max_sec).cast("int")))
    pieces = chained.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "vod_id",
        (F.col("start") + F.col("i") * max_sec).alias("start"),
        F.when(F.col("_short"), F.col("end")).otherwise(F.least("end", F.col("start") + (F.col("i") + 1) * max_sec)).alias("end"),
    )
    return _numbered(pieces)


def fixed_chapters(vods: DataFrame, *, chapter_sec: float = 600.0) -> DataFrame:
    return _numbered(_blocks(vods, chapter_sec).drop("block"))


def _numbered(pieces: DataFrame) -> DataFrame:
    w = Window.partitionBy("vod_id").orderBy("start")
    return pieces.select("vod_id", F.row_number().over(w).alias("id"), "start", "end")


def chapter_titles(
    segments: DataFrame, chapters: DataFrame, *, char_class: str = CJK, max_chars: int = 16
) -> DataFrame:
    """Add `title`: the chapter's first characters, led by its most frequent pair when it repeats.

    Only as many leading segments as the title has characters are put together. The first-seen pair
    wins among equally frequent ones.
    """
    s = segments.select("vod_id", "seg_id", "start", "end", F.regexp_replace(tx.strip("text"), r"(?U)\s+", "").alias("text"))
    pairs = overlapping_spans(s.where(F.col("text") != ""), chapters.select("vod_id", "id", "start", "end"))
    order = Window.partitionBy("vod_id", "id").orderBy("seg_id")
    head = (
        pairs.select("vod_id", F.col("w_id").alias("id"), "seg_id", F.left("text", F.lit(max_chars)).alias("text"))
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= max_chars)
        .groupBy("vod_id", "id")
        .agg(F.array_sort(F.collect_list(F.struct("seg_id", "text"))).alias("_p"))
        .select("vod_id", "id", F.left(F.array_join(F.transform("_p", lambda p: p["text"]), ""), F.lit(max_chars)).alias("_head"))
    )
    grams = _span_pairs(segments, chapters, "id", char_class).select("vod_id", "id", "at", F.posexplode_outer("grams").alias("pos", "gram")).where(F.col("gram").isNotNull())
    # Places are numbers, not structs, so that they are counted by hash and never sorted.
    counts = grams.groupBy("vod_id", "id", "gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("at") + F.col("pos")).alias("first"))
    top = counts.groupBy("vod_id", "id").agg(
        F.sum("n").alias("_total"),
        F.min_by(F.struct("gram", "n"), F.struct(-F.col("n"), F.col("first"))).alias("_g"),
    )
    fallback = F.concat(F.format_string("%02d", F.floor(F.col("start") / 60.0)), F.lit(":00 段落"))
    # At least four characters of the class give at least three pairs.
    led = (F.col("_total") >= 3) & (F.col("_g.n") >= 2)
    title = F.when(F.col("_head").isNull(), fallback).when(
        led, F.left(F.concat("_g.gram", "_head"), F.lit(max_chars))
    ).otherwise(F.col("_head"))
    return (
        chapters.join(head, ["vod_id", "id"], "left")
        .join(top, ["vod_id", "id"], "left")
        .select("vod_id", "id", "start", "end", title.alias("title"))
    )
