"""Ranking, Top-N and greedy selection over scored candidates.

Candidates are few per hour of recording (capped slides plus thinned seeds). Greedy choices only
look a short way along the time line, so each chain of nearby candidates is folded on its own and
a long recording spreads over many tasks.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import hour_of, overlaps, py_round
from clipmine.functions.timecode import timestamp
from clipmine.operators.intervals import islands

VOD = ("vod_id",)


def number_by_score(candidates: DataFrame, *, keys: Sequence[str] = VOD, order: str = "gen_order", out: str = "candidate_id") -> DataFrame:
    """1, 2, … by falling score; equal scores keep the generation order."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(order))
    return candidates.withColumn(out, F.row_number().over(w))


def best_per_seed(scored: DataFrame, *, keys: Sequence[str] = ("vod_id", "seed")) -> DataFrame:
    """The best-scored window of each seed; the longer one wins a tie."""
    cols = [c for c in scored.columns if c not in keys]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("score", "wlen")).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in cols])


def top_n(rows: DataFrame, n: int, *, keys: Sequence[str] = VOD) -> DataFrame:
    """The `n` best by score (earlier start first on ties), numbered; `n <= 0` keeps all."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("start"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if n <= 0 else ranked.where(F.col("rank") <= n)


def top_n_diverse(
    candidates: DataFrame, n: int, *, min_gap: float = 90.0, dominance: float = 1.35, score: str = "rank_score",
    keys: Sequence[str] = VOD, tie: str = "candidate_id",
) -> DataFrame:
    """Greedy Top-N by score: a candidate near a chosen one needs `dominance` times its score.

    Stopping after `n` does not change who was chosen before, so everything is selected per chain of
    nearby candidates and the first `n` are taken afterwards.
    """
    mid = (F.col("start") + F.col("end")) / 2.0
    reach = candidates.withColumn("_lo", F.least("start", mid - min_gap / 2)).withColumn("_hi", F.greatest("end", mid + min_gap / 2))
    chained = islands(reach, keys, start="_lo", end="_hi").drop("_lo", "_hi")
    schema = chained.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, "start", tie], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        s, e, v = (pdf[c].to_numpy(dtype=float) for c in ("start", "end", score))
        m = (s + e) / 2.0
        chosen: list[int] = []
        for i in range(len(pdf)):
            c = np.asarray(chosen, dtype=int)
            near = ((s[i] < e[c]) & (s[c] < e[i])) | (np.abs(m[i] - m[c]) < min_gap)
            if not np.any(near & (v[i] < v[c] * dominance)):
                chosen.append(i)
        return pdf.iloc[chosen]

    picked = chained.groupBy(*keys, "island").applyInPandas(choose, schema).drop("island")
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("start"), F.col(tie))
    return picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pick_non_overlapping(candidates: DataFrame, *, keys: Sequence[str] = VOD, tie: str = "gen_order") -> DataFrame:
    """Greedy by score: each candidate that overlaps no better chosen one."""
    chained = islands(candidates, keys, start="start", end="end")
    schema = chained.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "start", tie], ascending=[False, True, True], kind="stable")
        s, e = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        chosen: list[int] = []
        for i in range(len(pdf)):
            c = np.asarray(chosen, dtype=int)
            if not np.any((s[i] < e[c]) & (s[c] < e[i])):
                chosen.append(i)
        return pdf.iloc[chosen]

    return chained.groupBy(*keys, "island").applyInPandas(choose, schema).drop("island")


# --- decisions -----------------------------------------------------------------------------------


def candidate_pool(enriched: DataFrame, top: DataFrame, *, keys: Sequence[str] = VOD) -> DataFrame:
    """Review ids: the Top-N first, then the other candidates at other (rounded) spans."""
    span = lambda df: df.withColumn("_s", py_round("start", 1)).withColumn("_e", py_round("end", 1))
    rest = span(enriched).join(span(top).select(*keys, "_s", "_e").distinct(), [*keys, "_s", "_e"], "left_anti").drop("_s", "_e")
    size = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("_top"))
    w = Window.partitionBy(*keys).orderBy("candidate_id")
    rest = (
        rest.withColumn("_rn", F.row_number().over(w))
        .join(size, list(keys), "left")
        .withColumn("candidate_id", (F.coalesce("_top", F.lit(0)) + F.col("_rn")).cast("int"))
        .drop("_rn", "_top")
    )
    head = top.withColumn("candidate_id", F.col("rank").cast("int")).drop("rank")
    return head.unionByName(rest.select(*head.columns))


def resolve_decisions(decisions: DataFrame, pool: DataFrame) -> DataFrame:
    """Keep decisions with their final bounds: decision, else suggested, else raw.

    A decision on an unknown candidate needs both bounds of its own. Columns of `decisions`:
    `vod_id, candidate_id, action, ord` and optional `start, end, title, hook`.
    """
    base = pool.select(
        "vod_id", "candidate_id",
        *[F.col(c).alias("b_" + c) for c in ("start", "end", "suggested_start", "suggested_end", "score", "title", "reason", "suggested_hook", "speech_ratio")],
    )
    kept = decisions.where(F.col("action") == "keep").join(base, ["vod_id", "candidate_id"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("b_title", F.lit("")), F.lit(tx.DEFAULT_TITLE))
    return kept.select(
        "vod_id", "candidate_id", "ord",
        F.coalesce("start", "b_suggested_start", "b_start").alias("start"),
        F.coalesce("end", "b_suggested_end", "b_end").alias("end"),
        F.coalesce("b_score", F.lit(0.0)).alias("score"),
        title.alias("title"),
        F.coalesce(F.nullif("hook", F.lit("")), F.nullif("b_suggested_hook", F.lit("")), tx.hook(title)).alias("suggested_hook"),
        F.coalesce("b_reason", F.lit("LLM/人工審核保留")).alias("reason"),
        F.coalesce("b_speech_ratio", F.lit(0.0)).alias("speech_ratio"),
    ).where(F.col("end") > F.col("start"))


def apply_quota(keeps: DataFrame, per_hour: int | None, *, keys: Sequence[str] = VOD) -> DataFrame:
    """Keeps by falling score, at most `per_hour` per hour of their start, overlaps skipped.

    The quota is tested before the overlap. Hours interact only where a keep runs past its hour, so
    each such chain of hours is folded on its own.
    """
    hour0 = F.floor(F.col("start") / 3600.0) * 3600.0
    wide = keeps.withColumn("_lo", hour0).withColumn("_hi", F.greatest(hour0 + 3599.999999, "end"))
    chained = islands(wide, keys, start="_lo", end="_hi").drop("_lo", "_hi")
    schema = chained.schema
    quota = max(1, int(per_hour)) if per_hour else None

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "ord"], ascending=[False, True], kind="stable")
        used: dict[int, int] = {}
        taken: list[int] = []
        s, e = pdf["start"].to_numpy(), pdf["end"].to_numpy()
        for i in range(len(pdf)):
            hour = int(s[i] // 3600)
            if quota is not None and used.get(hour, 0) >= quota:
                continue
            c = np.asarray(taken, dtype=int)
            if np.any((s[c] < e[i]) & (s[i] < e[c])):
                continue
            taken.append(i)
            used[hour] = used.get(hour, 0) + 1
        return pdf.iloc[taken]

    return chained.groupBy(*keys, "island").applyInPandas(choose, schema).drop("island")


def highlights_from_decisions(decisions: DataFrame, pool: DataFrame, per_hour: int | None) -> DataFrame:
    kept = apply_quota(resolve_decisions(decisions, pool), per_hour)
    w = Window.partitionBy("vod_id").orderBy("start")
    return kept.withColumn("id", F.row_number().over(w)).select(
        "vod_id", "id", "start", "end", "title", "reason", "suggested_hook", "score",
        hour_of("start").alias("hour_bucket"),
        F.lit(None).cast("int").alias("chapter_id"),
        "speech_ratio",
        timestamp("start").alias("start_display"),
        timestamp("end").alias("end_display"),
        F.col("id").alias("arc_id"),
        F.array(F.col("candidate_id").cast("int")).alias("merged_from"),
    )


def suggest_actions(queue: DataFrame, per_hour: int, *, keys: Sequence[str] = VOD, order: str = "rank") -> DataFrame:
    """keep / reject suggestion: eligible candidates in order, up to the hour's quota."""
    eligible = (
        ~F.col("is_intro") & ~F.col("is_outro")
        & ((F.col("chat_cue") > 0) | (F.col("chat_react") > 0.08) | (F.col("rank_score") >= 2.0))
    )
    w = Window.partitionBy(*keys, "hour_bucket", "_ok").orderBy(order)
    return (
        queue.withColumn("_ok", eligible)
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("action", F.when(F.col("_ok") & (F.col("_rn") <= per_hour), "keep").otherwise("reject"))
        .drop("_ok", "_rn")
    )
