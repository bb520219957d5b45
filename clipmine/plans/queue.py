"""From enriched candidates to the review queue and to highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import hour_of
from clipmine.functions.timecode import timestamp
from clipmine.lexicon import Profile
from clipmine.operators import arcs as ar
from clipmine.operators import select as sel
from clipmine.operators.chapters import chapter_titles, topic_chapters
from clipmine.operators.edit import clamp_to_sentence, suggested_bounds
from clipmine.operators.features import rank_in_hour
from clipmine.operators.joins import chapter_of
from clipmine.operators.signals import mark_reactions
from clipmine.plans.candidates import Recordings, enrich_candidates, score_candidates
from clipmine.session import cut_lineage


def chapters(rec: Recordings) -> DataFrame:
    return chapter_titles(rec.segments, topic_chapters(rec.segments, rec.vods))


def ranked_candidates(rec: Recordings, profile: Profile) -> DataFrame:
    """Every enriched candidate with its id (by score) and its rank within the hour."""
    enriched = enrich_candidates(score_candidates(rec, profile), rec, profile)
    return rank_in_hour(sel.number_by_score(enriched))


def review_queue(ranked: DataFrame, profile: Profile) -> DataFrame:
    """The diverse Top-N with a suggested action; `rank` is the id a reviewer decides on."""
    top = sel.top_n_diverse(ranked, max(1, profile.prefilter_top_n), min_gap=profile.diversity_min_gap_sec)
    return sel.suggest_actions(top, profile.clips_per_hour)


def reviewed_highlights(ranked: DataFrame, queue: DataFrame, decisions: DataFrame, profile: Profile) -> DataFrame:
    pool = sel.candidate_pool(ranked, queue.drop("action"))
    return sel.highlights_from_decisions(decisions, pool, profile.clips_per_hour)


def arc_highlights(ranked: DataFrame, chapters_df: DataFrame, rec: Recordings, profile: Profile) -> DataFrame:
    """Story arcs per hour with suggested bounds, cut at a sentence end when too long."""
    placed = chapter_of(ranked, chapters_df, ids=["candidate_id"])
    arcs = ar.story_arcs(
        placed, speech_min=profile.speech_ratio_min, story_min=profile.story_min_sec, story_max=profile.story_max_sec,
        gap_max=profile.story_gap_max_sec, per_hour=profile.clips_per_hour, continuity_min=profile.continuity_min,
    )
    order = Window.partitionBy("vod_id").orderBy("start", "end")
    # The folds ran once; the bound queries below read their result several times.
    arcs = cut_lineage(arcs.withColumn("id", F.row_number().over(order)))
    marked = mark_reactions(rec.chat, profile)
    return finish_arcs(arcs, chapters_df, marked, rec, profile)


def finish_arcs(arcs: DataFrame, chapters_df: DataFrame, marked: DataFrame, rec: Recordings, profile: Profile) -> DataFrame:
    from clipmine.operators.joins import points_in_windows

    react = marked.where("laugh or confused or cue").select("vod_id", "t")
    peaks = (
        points_in_windows(react, arcs.select("vod_id", "id", "start", "end"))
        .groupBy("vod_id", F.col("w_id").alias("id"))
        .agg(F.max("t").alias("reaction_peak_t"))
    )
    placed = chapter_of(arcs, chapters_df, ids=["id"]).join(peaks, ["vod_id", "id"], "left")
    b = suggested_bounds(placed, rec.speech, rec.segments, ids=["id"], ends=profile.sentence_ends, lag=profile.chat_lag_sec)
    # The clamps below name the bounds many times: written once, their formulas don't multiply.
    b = cut_lineage(b.drop("start", "end").withColumnsRenamed({"suggested_start": "start", "suggested_end": "end"}))
    clamp = lambda df: clamp_to_sentence(df, rec.segments, ids=["id"], max_sec=profile.story_max_sec, ends=profile.sentence_ends)
    b = clamp(b).join(rec.vods.select("vod_id", "duration_sec"), "vod_id")
    short = (F.col("end") - F.col("start") < min(profile.story_min_sec, profile.clip_min_sec)) & (F.col("duration_sec") >= profile.story_min_sec)
    b = b.withColumn("end", F.when(short, F.least("duration_sec", F.col("start") + profile.story_min_sec)).otherwise(F.col("end")))
    return clamp(b).select(
        "vod_id", "id", "start", "end", "title", "reason", tx.hook("title").alias("suggested_hook"), "score",
        hour_of("start").alias("hour_bucket"), F.col("chapter_id").cast("int").alias("chapter_id"), "speech_ratio",
        timestamp("start").alias("start_display"), timestamp("end").alias("end_display"),
        F.col("id").alias("arc_id"), "merged_from",
    )


def highlights(rec: Recordings, profile: Profile, decisions: DataFrame | None = None, *, auto_arcs: bool = False) -> DataFrame:
    """Reviewed highlights; recordings without any fall back to story arcs when `auto_arcs`."""
    if decisions is None and not auto_arcs:
        raise ValueError("no decisions given: pass them, or set auto_arcs")
    ranked = cut_lineage(ranked_candidates(rec, profile))
    done = None
    if decisions is not None:
        done = reviewed_highlights(ranked, cut_lineage(review_queue(ranked, profile)), decisions, profile)
        if not auto_arcs:
            return done
    open_ = ranked if done is None else ranked.join(done.select("vod_id").distinct(), "vod_id", "left_anti")
    # Arcs need no titles; four joins below read the chapters.
    arcs = arc_highlights(open_, cut_lineage(topic_chapters(rec.segments, rec.vods)), rec, profile)
    return arcs if done is None else done.unionByName(arcs)
