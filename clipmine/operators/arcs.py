"""Story arcs: candidates linked by topic, chapter and closeness, grown around a seed until nothing joins any more.

Links are pairs of candidates from one interval join. An arc can't grow over `story_max`, so a seed meets only the
candidates within that reach: a short array, over which growing is a fixpoint of passes (`aggregate` of `aggregate`). All
seeds grow in parallel; choosing among an hour's arcs is one more fold.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import let, overlaps
from clipmine.operators.joins import overlapping_spans
from clipmine.session import cut_lineage

HOUR = ("vod_id", "hour_bucket")

# Fixed values, begin: what makes candidates belong together.
CHAPTER_BONUS = {0: 1.0, 1: 0.55}
SHARE = {"chapter": 0.45, "topic": 0.35, "keywords": 0.1, "closeness": 0.1}
TOPIC_MIN, TOPIC_MIN_NEXT_CHAPTER = 0.12, 0.18
KEYWORDS_FULL = 4.0
# Fixed values, end.


def gap(a0, a1, b0, b1) -> Column:
    """Time between two spans; 0 if they meet."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def link(topic: Column, keywords: Column, step: Column, titled: Column, apart: Column, gap_max: float) -> Column:
    """How much a candidate continues another one or an arc, 0 to 1. `step`: chapters between them (NULL: unknown)."""
    bonus = F.when(step == 0, CHAPTER_BONUS[0]).when(step == 1, CHAPTER_BONUS[1]).otherwise(0.0)
    value = (
        bonus * SHARE["chapter"] + topic * SHARE["topic"] + F.least(F.lit(1.0), keywords / KEYWORDS_FULL) * SHARE["keywords"]
        + F.greatest(F.lit(0.0), 1.0 - apart / max(gap_max, 1e-6)) * SHARE["closeness"]
    )
    next_ = F.coalesce(step == 1, F.lit(False))
    far = (apart > gap_max) | F.coalesce(step > 1, F.lit(False))
    return F.when(far | (next_ & (topic < TOPIC_MIN_NEXT_CHAPTER)) | (~next_ & (topic < TOPIC_MIN) & titled), 0.0).otherwise(value)


def whole_bigrams(candidates: DataFrame) -> Column:
    """Bigrams of the whole transcript where they are carried, else of what there is of it."""
    return F.col("transcript_bigrams") if "transcript_bigrams" in candidates.columns else tx.bigrams("transcript_excerpt")


def near_pairs(candidates: DataFrame, reach: float, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Every two candidates of a group within `reach` of each other, once, with the smaller id on the left (`w_` is the
    other): `topic`, `keywords`, `step`, `titled`. Topics are compared once a pair."""
    spoken = F.coalesce(F.col("transcript_excerpt"), F.lit("")) != ""
    body = F.when(spoken, whole_bigrams(candidates)).otherwise(tx.bigrams("title"))
    c = candidates.select(
        *keys, "candidate_id", "start", "end", "keyword_hits", "chapter_id", *extra,
        tx.bigrams("title").alias("_head"), body.alias("_body"), (F.trim(F.coalesce("title", F.lit(""))) != "").alias("_titled"),
    )
    pairs = overlapping_spans(c, c, keys=keys, pad=reach + 1e-6).where(F.col("candidate_id") < F.col("w_candidate_id"))
    return pairs.withColumns(
        {
            "topic": F.greatest(tx.jaccard("_head", "w__head"), tx.jaccard("_body", "w__body")),
            "keywords": F.coalesce("keyword_hits", F.lit(0)) + F.coalesce("w_keyword_hits", F.lit(0)),
            "step": F.abs(F.col("chapter_id") - F.col("w_chapter_id")),
            "titled": F.col("_titled") & F.col("w__titled"),
        }
    ).drop("_head", "_body", "_titled", "w__head", "w__body", "w__titled")


def continuity(candidates: DataFrame, *, gap_max: float, keys: Sequence[str] = HOUR) -> DataFrame:
    """Continuity of every pair that is close enough to have one (others are 0 by definition), in both directions.

    Needs `candidate_id, start, end, title, transcript_excerpt, keyword_hits, chapter_id`; topics are compared by
    `transcript_bigrams` (of the whole text) if that is there.
    """
    apart = gap(F.col("w_start"), F.col("w_end"), F.col("start"), F.col("end"))
    pairs = near_pairs(candidates, gap_max, keys)
    value = link(F.col("topic"), F.col("keywords"), F.col("step"), F.col("titled"), apart, gap_max).alias("continuity")
    once = pairs.select(*keys, F.col("candidate_id").alias("a"), F.col("w_candidate_id").alias("b"), value)
    ends = F.explode(F.array(F.struct(F.col("a").alias("seed_id"), F.col("b").alias("other_id")), F.struct(F.col("b").alias("seed_id"), F.col("a").alias("other_id"))))
    return once.select(*keys, ends.alias("p"), "continuity").select(*keys, "p.seed_id", "p.other_id", "continuity")


def arc_pool(queue: DataFrame, speech_min: float, unvoiced: int | None) -> DataFrame:
    """The candidates of each hour that arcs are made of: no intros and outros if there are others, those with enough
    speech if there are any, else the `unvoiced` ones with most (None: all)."""
    hour = Window.partitionBy(*HOUR)
    plain = ~(F.coalesce("is_intro", F.lit(False)) | F.coalesce("is_outro", F.lit(False)))
    voiced = F.coalesce(F.col("speech_ratio") >= speech_min, F.lit(False))
    rows = queue.withColumn("_plain", plain).withColumn("_any", F.max("_plain").over(hour)).where("_plain or not _any")
    rows = rows.withColumn("_voiced", voiced).withColumn("_any", F.max("_voiced").over(hour)).where("_voiced or not _any")
    if unvoiced is not None:
        rank = F.row_number().over(hour.orderBy(F.desc("speech_ratio"), "candidate_id"))
        rows = rows.withColumn("_rank", rank).where((F.col("_rank") <= unvoiced) | F.col("_any")).drop("_rank")
    return rows.drop("_plain", "_voiced", "_any")


def story_arcs(
    queue: DataFrame, *, speech_min: float, story_min: float, story_max: float, gap_max: float, per_hour: int,
    continuity_min: float = 0.5, unvoiced: int | None = None, seeds: int | None = None,
) -> DataFrame:
    """Grow up to `per_hour` arcs per (recording, hour) from its best candidates: `vod_id, start, end, score, title, reason,
    speech_ratio, merged_from`. `unvoiced` as in `arc_pool`; `seeds`: how many candidates of an hour may begin an arc (None: all)."""
    columns = ["candidate_id", "start", "end", "score", "speech_ratio", "title", "reason", "transcript_excerpt", "keyword_hits", "chapter_id"]
    pool = arc_pool(queue.withColumn("transcript_bigrams", whole_bigrams(queue)), speech_min, unvoiced).select(*HOUR, *columns, "transcript_bigrams")
    pool = cut_lineage(pool)  # read by the join from both sides, and by the seeds
    pairs = near_pairs(pool, story_max, HOUR, ("score", "speech_ratio"))
    hull = F.greatest("end", "w_end") - F.least("start", "w_start")
    apart = gap(F.col("start"), F.col("end"), F.col("w_start"), F.col("w_end"))
    linked = link(F.col("topic"), F.col("keywords"), F.col("step"), F.col("titled"), apart, gap_max) >= continuity_min
    pairs = cut_lineage(pairs.where(hull <= story_max + 1e-6).withColumn("linked", linked))

    side = lambda p: [F.col(p + c).alias(c) for c in ("candidate_id", "start", "end", "score", "speech_ratio", "chapter_id")]
    one = lambda seed, p: pairs.select(*HOUR, F.col(seed + "candidate_id").alias("seed"), *side(p), "topic", "keywords", "titled", "linked")
    both = one("", "w_").unionByName(one("w_", ""))
    neighbours = both.where("linked").groupBy(*HOUR, F.col("seed").alias("candidate_id")).agg(F.collect_set("candidate_id").alias("links"))
    reach = both.join(neighbours, [*HOUR, "candidate_id"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<int>")))
    other = F.struct((-F.col("score")).alias("less"), F.col("candidate_id").alias("id"), "start", "end", "score", "speech_ratio", "chapter_id", "topic", "keywords", "titled", "links")
    near = reach.groupBy(*HOUR, F.col("seed").alias("candidate_id")).agg(F.array_sort(F.collect_list(other)).alias("near"))
    starts = pool.drop("transcript_excerpt", "transcript_bigrams", "keyword_hits").join(near, [*HOUR, "candidate_id"], "left")
    if seeds is not None:
        rank = F.row_number().over(Window.partitionBy(*HOUR).orderBy(F.desc("score"), "candidate_id"))
        starts = starts.withColumn("_rank", rank).where(F.col("_rank") <= seeds).drop("_rank")
    none = F.slice(F.array(F.get("near", F.lit(0))), 1, 0)
    grown = starts.withColumn("near", F.coalesce("near", none)).withColumn("arc", grow(F.col("near"), story_max=story_max, gap_max=gap_max, need=continuity_min))
    a, b = F.col("arc.start"), F.col("arc.end")
    short = b - a < story_min
    begin = F.when(short, F.greatest(F.lit(0.0), (a + b) / 2.0 - story_min / 2.0)).otherwise(a)
    end = F.least(F.when(short, begin + story_min).otherwise(b), begin + story_max)
    joined = F.filter("near", lambda r: F.array_contains(F.col("arc.members"), r["id"]))
    best = lambda c: F.array_max(F.concat(F.array(F.col(c)), F.transform(joined, lambda r: r[c])))
    arcs = grown.select(
        *HOUR, (-F.col("score")).alias("less"), "candidate_id", begin.alias("start"), end.alias("end"), best("score").alias("score"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit(tx.DEFAULT_TITLE)).alias("title"),
        F.concat(F.lit("故事弧合併 "), F.size("arc.members").cast("string"), F.lit(" 段；"), F.coalesce("reason", F.lit(""))).alias("reason"),
        best("speech_ratio").alias("speech_ratio"), F.array_sort(F.col("arc.members")).alias("merged_from"),
    )
    fields = ["less", "candidate_id", "start", "end", "score", "title", "reason", "speech_ratio", "merged_from"]
    hours = arcs.groupBy(*HOUR).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("arcs"))

    def choose(out: Column, arc: Column) -> Column:
        free = (F.size(out) < max(1, int(per_hour))) & ~F.exists(out, lambda c: overlaps(arc["start"], arc["end"], c["start"], c["end"]))
        return F.when(free, F.concat(out, F.array(arc))).otherwise(out)

    chosen = hours.select("vod_id", F.explode(F.aggregate("arcs", F.slice("arcs", 1, 0), choose)).alias("arc"))
    return chosen.select("vod_id", *[f"arc.{c}" for c in fields[2:]])


def grow(near: Column, *, story_max: float, gap_max: float, need: float) -> Column:
    """`struct(start, end, chapter, members, grew)` of the arc around the row's candidate. `near`: the candidates in reach, best first.

    A pass takes every candidate that fits and is linked with the arc or one of its members; passes are repeated until
    one takes none. The arc's chapter is that of its earliest part.
    """
    kind = "struct<start: double, end: double, chapter: int, members: array<int>, grew: boolean>"
    state = lambda a, b, c, m, g: F.struct(a.alias("start"), b.alias("end"), c.alias("chapter"), m.alias("members"), g.alias("grew")).cast(kind)

    def take(s: Column, r: Column) -> Column:
        apart = gap(s["start"], s["end"], r["start"], r["end"])
        hull = F.greatest(s["end"], r["end"]) - F.least(s["start"], r["start"])
        fits = (hull <= story_max + 1e-6) & (apart <= gap_max) & ~F.array_contains(s["members"], r["id"])
        to_arc = link(r["topic"], r["keywords"], F.abs(s["chapter"] - r["chapter_id"]), r["titled"], apart, gap_max)
        ok = fits & ((to_arc >= need) | F.arrays_overlap(r["links"], s["members"]))
        chapter = F.when(r["start"] < s["start"], r["chapter_id"]).otherwise(s["chapter"])
        larger = state(F.least(s["start"], r["start"]), F.greatest(s["end"], r["end"]), chapter, F.concat(s["members"], F.array(r["id"])), F.lit(True))
        return F.when(ok, larger).otherwise(s)

    def a_pass(s: Column, near_: Column) -> Column:
        return F.aggregate(near_, state(s["start"], s["end"], s["chapter"], s["members"], F.lit(False)), take)

    first = state(F.col("start"), F.col("end"), F.col("chapter_id"), F.array("candidate_id"), F.lit(True))
    passes = lambda v: F.sequence(F.lit(1), F.size(v) + 1)
    return let(near, lambda v: F.aggregate(passes(v), first, lambda s, _: F.when(s["grew"], a_pass(s, v)).otherwise(s)))
