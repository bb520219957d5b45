"""Review state: scores, keep / drop / purge, queues and progress counts."""

from __future__ import annotations

from typing import Any, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, begin: review rules.
PURGE_BELOW = 10
RECENT_MAX = 3
SCORE_DEFAULT = 3
# Fixed values, end.

STATE_SCHEMA = "reviewer string, job_id string, n int, total int, status string, submitted boolean"


def total_score(like="like", content="content", visual="visual") -> Column:
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    return c(like) + c(content) + c(visual)


def best_artifact(artifacts: DataFrame, priority: Sequence[str], keys: Sequence[str] = ("job_id", "n")) -> DataFrame:
    """The existing file of the highest priority kind per clip."""
    rank = F.array_position(F.array(*[F.lit(k) for k in priority]), F.col("kind"))
    return (
        artifacts.withColumn("_r", rank).where(F.col("_r") > 0).groupBy(*keys).agg(F.min_by("path", "_r").alias("path"), F.min_by("kind", "_r").alias("kind"))
    )


class Session:
    """One reviewer's session: the clips scored last, and the clips dropped last.

    A clip leaving the three most recent becomes kept, or is purged when its total is low. Purging is
    final. Only recent clips can still change by leaving, so the state is small however long the log.
    """

    def __init__(self, recent: Iterable[tuple] = (), dropped: Iterable[tuple] = ()):
        self.recent: list[tuple] = list(recent)
        self.dropped: list[tuple] = list(dropped)

    def apply(self, kind: str, clip: tuple, total: int, states: dict[tuple, dict]) -> list[tuple]:
        """Apply one event to `states`; returns the clips whose state changed."""
        state = states.setdefault(clip, {"total": 3 * SCORE_DEFAULT, "status": "pending", "submitted": False})
        if state["status"] == "purged":
            return []
        changed = [clip]
        if kind == "score":
            state.update(total=total, submitted=True, status="doomed" if total < PURGE_BELOW else "kept")
            self.recent = [c for c in self.recent if c != clip] + [clip]
            while len(self.recent) > RECENT_MAX:
                old = self.recent.pop(0)
                gone = states[old]
                if gone["status"] != "purged":
                    gone.update(submitted=True, status="purged" if gone["total"] < PURGE_BELOW else "kept")
                    changed.append(old)
        elif kind == "drop":
            state["status"] = "dropped"
            self.dropped = [c for c in self.dropped if c != clip] + [clip]
            while len(self.dropped) > RECENT_MAX:
                old = self.dropped.pop(0)
                if states[old]["status"] == "dropped":
                    states[old].update(submitted=True, status="purged")
                    changed.append(old)
        elif kind == "undrop" and state["status"] == "dropped":
            state["status"] = "kept"
            self.dropped = [c for c in self.dropped if c != clip]
        else:
            changed = []
        return changed


def clip_states(events: DataFrame) -> DataFrame:
    """Final state of every clip from its session's events (`reviewer, seq, kind, job_id, n, like, content, visual`).

    A session's events stream through one task in order, a batch at a time; what is held are the states of the clips met
    so far (a purged one has to be remembered), not the log.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reviewer, session, states, changed = None, Session(), {}, set()

        def finished() -> pd.DataFrame:
            rows = [(reviewer, job, n, *(states[job, n][k] for k in ("total", "status", "submitted"))) for job, n in sorted(changed)]
            return pd.DataFrame(rows, columns=["reviewer", "job_id", "n", "total", "status", "submitted"])

        for batch in batches:
            for who, kind, job, n, total in zip(batch["reviewer"], batch["kind"], batch["job_id"], batch["n"], batch["total"]):
                if who != reviewer:
                    if changed:
                        yield finished()
                    reviewer, session, states, changed = who, Session(), {}, set()
                changed.update(session.apply(kind, (job, int(n)), int(total), states))
        if changed:
            yield finished()

    log = events.where(F.col("reviewer").isNotNull()).select("reviewer", "seq", "kind", "job_id", "n", total_score().alias("total"))
    return log.repartition("reviewer").sortWithinPartitions("reviewer", "seq").mapInPandas(fold, STATE_SCHEMA)


# --- queues --------------------------------------------------------------------------------------


def without_deleted(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("job_id").distinct(), "job_id", "left_anti")


def review_pool(clips: DataFrame, states: DataFrame, decisions: DataFrame, artifacts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Clips that can be reviewed: live job with a keep decision, a file, and not purged."""
    keeps = decisions.where(F.col("action") == "keep").select("job_id").distinct()
    s = states.select("job_id", "n", "status", "submitted", "total")
    return (
        without_deleted(clips, tombstones)
        .join(keeps, "job_id", "left_semi")
        .join(artifacts.select("job_id", "n").distinct(), ["job_id", "n"], "left_semi")
        .join(s, ["job_id", "n"], "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
        .withColumn("submitted", F.coalesce("submitted", F.lit(False)))
        .where(F.col("status") != "purged")
    )


def kept_queue(states: DataFrame, tombstones: DataFrame) -> DataFrame:
    good = F.col("submitted") & (F.col("total") >= PURGE_BELOW)
    return without_deleted(states, tombstones).where(
        ~F.col("status").isin("purged", "dropped") & ((F.col("status") == "kept") | good)
    )


def recent_clips(events: DataFrame, states: DataFrame, *, kind: str = "score") -> DataFrame:
    """The last three distinct clips of each session, newest first, that are still there."""
    last = events.where(F.col("kind") == kind).groupBy("reviewer", "job_id", "n").agg(F.max("seq").alias("seq"))
    order = Window.partitionBy("reviewer").orderBy(F.col("seq").desc())
    top = last.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= RECENT_MAX)
    gone = states.where(F.col("status") == "purged").select("reviewer", "job_id", "n")
    return top.join(gone, ["reviewer", "job_id", "n"], "left_anti")


def next_pending(pool: DataFrame, recent: DataFrame, *, seed: int = 0, reviewer: str = "reviewer") -> DataFrame:
    """The next clip for each reviewer: pending, not recent, rather not from the job seen twice in a row.

    "At random" is a hash order of the seed and the clip, so a rerun gives the same answer. Each
    reviewer's choice is a running minimum (a partial aggregate), not a sorted list of the pool.
    """
    last2 = recent.where(F.col("ord") <= 2).groupBy(reviewer, "job_id").agg((F.count(F.lit(1)) >= 2).alias("_tired"))
    pending = pool.where((F.col("status") == "pending") & ~F.col("submitted"))
    return (
        pending.join(recent.select(reviewer, "job_id", "n"), [reviewer, "job_id", "n"], "left_anti")
        .join(last2, [reviewer, "job_id"], "left")
        .groupBy(reviewer)
        .agg(
            F.min_by(
                F.struct("job_id", "n"),
                F.struct(F.coalesce("_tired", F.lit(False)).cast("int"), F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "job_id", F.col("n").cast("string"))), "job_id", "n"),
            ).alias("_c")
        )
        .select(reviewer, "_c.job_id", "_c.n")
    )


def with_highlight(clips: DataFrame, highlights: DataFrame, decisions: DataFrame) -> DataFrame:
    """Title, hook, reason, score and bounds of each clip: by highlight id, else by position;
    the decision's own title and hook win."""
    order = Window.partitionBy("job_id").orderBy("ord")
    cols = ["title", "suggested_hook", "reason", "score", "start", "end"]
    h = highlights.withColumn("_pos", F.row_number().over(order))
    by_id = h.select("job_id", F.col("id").alias("n"), F.struct(*cols).alias("_i"))
    by_pos = h.select("job_id", F.col("_pos").alias("n"), F.struct(*cols).alias("_p"))
    d = decisions.groupBy("job_id", F.col("candidate_id").alias("n")).agg(
        F.min_by(F.struct("title", "hook"), "ord").alias("_d")
    )
    pick = F.coalesce("_i", "_p")
    blank = lambda c: F.nullif(c, F.lit(""))
    return (
        clips.join(by_id, ["job_id", "n"], "left")
        .join(by_pos, ["job_id", "n"], "left")
        .join(d, ["job_id", "n"], "left")
        .withColumn("_h", pick)
        .select(
            *clips.columns,
            F.coalesce(blank(F.col("_d.title")), F.col("_h.title")).alias("title"),
            F.coalesce(blank(F.col("_d.hook")), F.col("_h.suggested_hook")).alias("hook"),
            "_h.reason", "_h.score", "_h.start", "_h.end",
        )
    )


# --- counts --------------------------------------------------------------------------------------


def progress_counts(jobs: DataFrame, candidates: DataFrame, decisions: DataFrame, highlights: DataFrame, states: DataFrame) -> DataFrame:
    """Per job: total, scored, reviewable, ready for edit, alive, eliminated.

    Clips are the highlight ids (or 1..keeps when there are none) and every clip with a state.
    """
    queued = candidates.groupBy("job_id").agg(F.count(F.lit(1)).alias("queued"))
    dec = decisions.groupBy("job_id").agg(
        F.count_if(F.col("action") == "keep").alias("keep"), F.count_if(F.col("action") == "reject").alias("reject")
    )
    ids = highlights.where(F.col("id") > 0).select("job_id", F.col("id").cast("int").alias("n")).distinct()
    hl = ids.groupBy("job_id").agg(F.count(F.lit(1)).alias("hl"))
    numbered = (
        dec.join(hl, "job_id", "left_anti").where(F.col("keep") > 0)
        .select("job_id", F.explode(F.sequence(F.lit(1), F.col("keep").cast("int"))).alias("n"))
    )
    clips = ids.unionByName(numbered).unionByName(states.select("job_id", "n")).distinct()
    st = clips.join(states.select("job_id", "n", "status", "submitted", "total"), ["job_id", "n"], "left")
    purged, dropped = F.col("status") == "purged", F.col("status") == "dropped"
    live = ~F.coalesce(purged | dropped, F.lit(False))
    submitted = live & F.coalesce("submitted", F.lit(False))
    ready = submitted & ((F.col("status") == "kept") | (F.col("total") >= PURGE_BELOW))
    counts = st.groupBy("job_id").agg(
        F.count_if(purged).alias("purged"),
        F.count_if(purged | dropped | submitted).alias("scored"),
        F.count_if(ready).alias("edit_ready"),
        F.count_if(dropped | submitted).alias("edit_total"),
    )
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = F.when(z("queued") > 0, z("queued")).otherwise(z("keep") + z("reject"))
    return (
        jobs.select("job_id").join(queued, "job_id", "left").join(dec, "job_id", "left").join(hl, "job_id", "left").join(counts, "job_id", "left")
        .select(
            "job_id", total.alias("total_clips"), z("scored").alias("scored"),
            F.when(z("keep") > 0, z("keep")).otherwise(z("hl")).alias("reviewable"),
            z("edit_ready").alias("edit_ready"), z("edit_total").alias("edit_total"),
            (z("reject") + z("purged")).alias("eliminated"),
        )
    )
