"""Registered queries: subtitle quality, job progress, review queues and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.tables import with_
from clipmine.operators import reports as rp
from clipmine.operators import review as rv
from clipmine.streaming.progress import latest_steps

STEP_CASE = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(rp.STEPS))
STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'done' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'pending' END"
STEPS = f"""steps AS (SELECT job_id, step, arg_max(status, event_id) AS status FROM (SELECT 'j' || user_id AS job_id, CASE event_id % 8 {STEP_CASE} END AS step, {STATUS} AS status, event_id FROM events) GROUP BY ALL)"""
WEIGHT = "CASE step " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in rp.STEP_WEIGHTS.items()) + " END"


def steps(t):
    name = F.get(F.array(*[F.lit(s) for s in rp.STEPS]), (F.col("event_id") % 8).cast("int"))
    status = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for x in ("purchase", "done", "view", "done", "click", "running", "error", "failed")]), "event_type"), F.lit("pending")
    )
    e = t.read("events").select(
        F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), name.alias("step"), status.alias("status"), F.lit("boom").alias("error"), F.col("event_id").alias("ts")
    )
    return latest_steps(e)


def jobs(t):
    return t.read("events").groupBy(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id")).agg(
        F.max_by(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "completed").otherwise("running"), "event_id").alias("status"),
        F.max("event_id").cast("double").alias("last_activity"), (F.count(F.lit(1)) * 10.0).alias("duration_sec"),
        (F.min("user_id") % 2 == 0).alias("allow_cpu"), F.when(F.min("user_id") % 3 > 0, F.min("user_id")).alias("serial"),
    )


JOBS = """jobs AS (SELECT 'j' || user_id AS job_id, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'completed' ELSE 'running' END, event_id) AS status, max(event_id) AS last, count(*) * 10e0 AS dur,
     min(user_id) % 2 = 0 AS cpu, CASE WHEN min(user_id) % 3 > 0 THEN min(user_id) END AS serial FROM events GROUP BY user_id)"""


def highlights(t):
    e = t.read("events").where(F.col("event_type") == "signup")
    return e.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("id"), F.lit(0.0).alias("start"), F.col("value").alias("end"))


def outputs(t):
    e = t.read("events").where(F.col("event_type").isin("click", "view") & (F.col("event_id") % 8 >= 3))
    name = F.get(F.array(*[F.lit(s) for s in rp.STEPS]), (F.col("event_id") % 8).cast("int"))
    return e.select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), name.alias("step"))


BACKLOG = f"""hl AS (SELECT 'j' || user_id AS job_id, count(*) AS n, avg(greatest(0e0, value)) AS mean FROM events WHERE event_type = 'signup' GROUP BY ALL),
  have AS (SELECT 'j' || user_id AS job_id, CASE event_id % 8 {STEP_CASE} END AS step, count(*) AS done FROM events WHERE event_type IN ('click', 'view') AND event_id % 8 >= 3 GROUP BY ALL),
  bl AS (SELECT j.job_id, s.step, cpu, coalesce(h.done, 0) AS done, greatest(CASE WHEN coalesce(hl.n, 0) > 0 THEN hl.n ELSE coalesce(e.done, 0) END, coalesce(h.done, 0)) AS total, coalesce(mean, 90e0) AS mean
         FROM jobs j CROSS JOIN (SELECT unnest(['04_edit', '05_subtitle', '06_effects', '07_flourish', '08_hook']) AS step) s LEFT JOIN hl ON hl.job_id = j.job_id
         LEFT JOIN have h ON h.job_id = j.job_id AND h.step = s.step LEFT JOIN have e ON e.job_id = j.job_id AND e.step = '04_edit')"""


@query("ag_step_percent", f"WITH {STEPS} SELECT job_id, round(100 * sum(CASE status WHEN 'done' THEN {WEIGHT} * 1e0 WHEN 'running' THEN {WEIGHT} * 0.35e0 ELSE 0e0 END) / 100, 6) AS pct FROM steps GROUP BY job_id")
def _(t):
    return rp.step_percent(steps(t), digits=6)


@query("ag_stage_backlog", f"WITH {JOBS}, {BACKLOG} SELECT job_id, step, done, total, round(mean, 6) AS mean_sec FROM bl")
def _(t):
    return rp.stage_backlog(jobs(t), highlights(t), outputs(t)).withColumn("mean_sec", F.round("mean_sec", 6))


@query(
    "flow_job_progress",
    f"""WITH {JOBS}, {STEPS}, {BACKLOG},
        w AS (SELECT job_id, {', '.join(f"bool_or(step = '{s}' AND status = 'done') AS d{i}" for i, s in enumerate(rp.STEPS))}, min(CASE WHEN status = 'running' THEN step END) AS run, count(*) FILTER (status = 'done') AS nd,
                round(100 * sum(CASE status WHEN 'done' THEN {WEIGHT} * 1e0 WHEN 'running' THEN {WEIGHT} * 0.35e0 ELSE 0e0 END) / 100, 6) AS pct, bool_or(status = 'failed') AS anyf FROM steps GROUP BY job_id),
        rs AS (SELECT job_id, sum((total - done) * mean * CASE step WHEN '04_edit' THEN CASE WHEN cpu THEN 1.2e0 ELSE 0.5e0 END WHEN '05_subtitle' THEN CASE WHEN cpu THEN 1.8e0 ELSE 0.45e0 END WHEN '06_effects' THEN 0.45e0 WHEN '07_flourish' THEN 0.35e0 ELSE 0.4e0 END) AS r FROM bl GROUP BY job_id),
        l AS (SELECT *, CASE WHEN status = 'running' AND 9000 - last > 180 THEN 'stale' WHEN status = 'completed' THEN 'done' ELSE status END AS live FROM jobs)
        SELECT job_id, live AS status, pct, CASE WHEN live = 'running' THEN round_even(CASE WHEN d0 THEN 0e0 ELSE 90e0 END + CASE WHEN d1 THEN 0e0 ELSE dur * CASE WHEN cpu THEN 0.85e0 ELSE 0.18e0 END END + CASE WHEN d2 THEN 0e0 ELSE 45e0 END
                 + CASE WHEN d3 AND d4 AND d5 AND d6 AND d7 THEN 0e0 ELSE r END, 0) END AS eta_sec,
               CASE live WHEN 'running' THEN run WHEN 'failed' THEN CASE WHEN anyf THEN 'boom' ELSE 'failed' END ELSE nd || '/8' END AS detail
        FROM l JOIN w USING (job_id) JOIN rs USING (job_id)""",
)
def _(t):
    return rp.job_progress(jobs(t), steps(t), highlights(t), outputs(t), now=9000.0, digits=6)


@query(
    "ag_job_summary",
    f"""WITH {JOBS}, {STEPS}, d AS (SELECT 'j' || doc_id AS job_id, count(*) FILTER (quality = 1) AS keep, count(*) FILTER (quality = 0) AS rej FROM labels GROUP BY doc_id),
        s AS (SELECT job_id, bool_or(step = '03_highlights' AND status = 'done') AS s3, bool_or(step = '04_edit' AND status IN ('done', 'running')) AS s4 FROM steps GROUP BY job_id),
        h AS (SELECT 'j' || user_id AS job_id, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 100 GROUP BY ALL)
        SELECT job_id, serial, coalesce(s3, false) AND keep IS NULL AND NOT coalesce(s4, false) AS awaiting_review, coalesce(keep, 0) AS keep_count, coalesce(rej, 0) AS reject_count,
               CASE WHEN coalesce(n, 0) > 0 THEN n ELSE coalesce(keep, 0) END AS total_segments FROM jobs LEFT JOIN s USING (job_id) LEFT JOIN d USING (job_id) LEFT JOIN h USING (job_id)""",
)
def _(t):
    d = t.read("labels").select(F.concat(F.lit("j"), F.col("doc_id").cast("string")).alias("job_id"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("action"))
    return rp.job_summary(jobs(t), steps(t), d, highlights(t).where(F.col("end") > 100))


@query(
    "ag_batch_progress",
    """SELECT CAST(ts AS DATE)::VARCHAR AS batch, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round(coalesce(avg(greatest(0e0, value)), 90e0), 6) AS mean_clip_sec FROM events GROUP BY ALL""",
)
def _(t):
    i = t.events.select(
        F.col("vod_id").alias("batch"), F.when(F.col("message") == "purchase", "done").when(F.col("message") == "error", "failed").otherwise("pending").alias("status"),
        F.lit(0.0).alias("start"), F.col("value").alias("end"),
    )
    return rp.batch_progress(i).withColumn("mean_clip_sec", F.round("mean_clip_sec", 6))


# --- subtitle quality -----------------------------------------------------------------------------


def turn_events(t):
    return t.turns.select(
        "vod_id", F.lit(1).alias("clip_id"), "start", F.when(F.col("seg_id") % 4 == 1, F.col("start") + 0.4).otherwise(F.col("end")).alias("end"),
        F.concat(F.lit("{\\clip(1,2)}"), F.replace("text", F.lit("\n"), F.lit("\\N"))).alias("text"),
    )


QA = r"""qa AS (SELECT vod_id, count(*) AS events, count(*) FILTER (d < 0.5) AS flashes, avg(d) AS dm, max(d) AS dx, greatest(0e0, coalesce(max(gap), 0e0)) AS mg, count(*) FILTER (ll > 200) AS over_long, count(*) FILTER (br) AS keeps_break
   FROM (SELECT vod_id, e2 - s AS d, lead(s) OVER (PARTITION BY vod_id ORDER BY s) - e2 AS gap, contains(text, chr(10)) AS br, list_max(list_transform(string_split(text, chr(10)), lambda x: length(replace(x, ' ', '')))) AS ll
         FROM (SELECT *, CASE WHEN seg_id % 4 = 1 THEN s + 0.4e0 ELSE e END AS e2 FROM turns)) GROUP BY vod_id)"""


@query(
    "ag_subtitle_quality",
    with_("turns", body="SELECT vod_id, events, flashes, round(dm, 3) AS dur_mean, round(dx, 3) AS dur_max, round(mg, 3) AS max_gap, over_long, keeps_break, events AS has_clip_tag FROM qa", recursive=QA),
)
def _(t):
    q = rp.subtitle_quality(turn_events(t), max_chars=200)
    return q.select("vod_id", "events", "flashes", *[F.round(c, 3).alias(c) for c in ("dur_mean", "dur_max", "max_gap")], "over_long", "keeps_break", "has_clip_tag")


@query(
    "ag_quality_rollup",
    with_("turns", body="SELECT count(*) AS clips, CAST(sum(events) AS BIGINT) AS events, CAST(sum(flashes) AS BIGINT) AS flashes, round(max(mg), 3) AS max_gap, CAST(sum(over_long) AS BIGINT) AS over_long FROM qa", recursive=QA),
)
def _(t):
    return rp.quality_rollup(rp.subtitle_quality(turn_events(t), max_chars=200), keys=()).withColumn("max_gap", F.round("max_gap", 3))


@query(
    "ag_mid_word_cuts",
    r"""WITH d AS (SELECT doc_id, replace(replace(replace(text, '{', '('), ' ', ''), chr(9), '') AS x FROM documents),
        lines AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
                    SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(list_transform(p, lambda l: length(l))) AS n FROM (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda l: l <> '') AS p FROM d))),
        inner_stops AS (SELECT doc_id, stop, count(*) OVER (PARTITION BY doc_id) AS lines, max(i) OVER (PARTITION BY doc_id) = i AS last FROM lines)
        SELECT CAST(d.doc_id AS VARCHAR) AS vod_id, CAST(count(DISTINCT CASE WHEN NOT last AND stop % 7 <> 0 THEN stop // 7 END) AS BIGINT) AS mid_word_cuts
        FROM d LEFT JOIN inner_stops i ON i.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def _(t):
    """Tokens of seven characters each: a break cuts one unless it falls on a multiple of seven."""
    d = t.read("documents")
    bare = F.translate("text", "{ \t", "(")
    e = d.select(
        F.col("doc_id").cast("string").alias("vod_id"), F.lit(1).alias("clip_id"), F.replace(bare, F.lit("\n"), F.lit("\\N")).alias("text"),
        F.regexp_extract_all(F.replace(bare, F.lit("\n"), F.lit("")), F.lit("(?s).{1,7}"), F.lit(0)).alias("tok"),
    )
    return rp.mid_word_cuts(e, "tok").select("vod_id", "mid_word_cuts")


# --- review ---------------------------------------------------------------------------------------

ST = """st AS (SELECT source AS job_id, CAST(doc_id AS INTEGER) AS n, CAST(3 + doc_id % 20 AS INTEGER) AS total, CASE doc_id % 6 WHEN 0 THEN 'purged' WHEN 1 THEN 'dropped' WHEN 2 THEN 'kept' WHEN 3 THEN 'doomed' ELSE 'pending' END AS status, doc_id % 6 < 4 AS submitted
   FROM labels JOIN documents USING (doc_id)),
  dec AS (SELECT source AS job_id, CAST(doc_id AS INTEGER) AS candidate_id, CASE quality WHEN 1 THEN 'keep' ELSE 'reject' END AS action FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 = 0)"""


def states(t):
    m = F.col("doc_id") % 6
    status = F.when(m == 0, "purged").when(m == 1, "dropped").when(m == 2, "kept").when(m == 3, "doomed").otherwise("pending")
    return t.read("labels").join(t.read("documents").select("doc_id", "source"), "doc_id").select(
        F.lit("r").alias("reviewer"), F.col("source").alias("job_id"), F.col("doc_id").cast("int").alias("n"), (3 + F.col("doc_id") % 20).cast("int").alias("total"),
        status.alias("status"), (m < 4).alias("submitted"), "quality",
    )


def decisions(t):
    s = states(t).where(F.col("n") % 3 == 0)
    return s.select(
        "job_id", F.col("n").alias("candidate_id"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("action"), F.col("n").alias("ord"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("T"), F.col("n").cast("string"))).alias("title"), F.lit("").alias("hook"),
    )


def clip_rows(t):
    return t.read("documents").select(F.col("source").alias("job_id"), F.col("doc_id").cast("int").alias("n"))


def tombstones(t):
    return t.read("documents").where(F.col("source").endswith("9")).select(F.col("source").alias("job_id"))


@query("fn_review_total", "SELECT doc_id, CAST(1 + quality * 4 + coalesce(toxic, 0) + doc_id % 3 AS INTEGER) AS total FROM labels")
def _(t):
    s = t.read("labels").select("doc_id", (F.lit(1) + F.col("quality") * 4).alias("like"), "toxic", (F.col("doc_id") % 3).cast("int").alias("visual"))
    return s.select("doc_id", rv.total_score("like", "toxic", "visual").cast("int").alias("total"))


@query(
    "jn_review_pool",
    f"""WITH {ST} SELECT source AS job_id, CAST(doc_id AS INTEGER) AS n, coalesce(status, 'pending') AS status FROM documents LEFT JOIN st ON st.n = doc_id
        WHERE source NOT LIKE '%9' AND source IN (SELECT job_id FROM dec WHERE action = 'keep') AND doc_id % 5 <> 0 AND coalesce(status, 'pending') <> 'purged'""",
)
def _(t):
    files = clip_rows(t).where(F.col("n") % 5 != 0)
    return rv.review_pool(clip_rows(t), states(t), decisions(t), files, tombstones(t)).select("job_id", "n", "status")


@query("jn_kept_queue", f"WITH {ST} SELECT job_id, n FROM st WHERE job_id NOT LIKE '%9' AND status NOT IN ('purged', 'dropped') AND (status = 'kept' OR (submitted AND total >= 10))")
def _(t):
    return rv.kept_queue(states(t), tombstones(t)).select("job_id", "n")


def review_events(t):
    """One session per hundred labels: scores, re-scores, drops."""
    kind = F.when(F.col("doc_id") % 7 == 3, "drop").when(F.col("doc_id") % 7 == 5, "undrop").otherwise("score")
    i = lambda c: c.cast("int")
    return t.read("labels").select(
        F.concat(F.lit("s"), F.floor(F.col("doc_id") / 100).cast("string")).alias("reviewer"), F.col("doc_id").alias("seq"), kind.alias("kind"),
        F.concat(F.lit("j"), (F.col("doc_id") % 2).cast("string")).alias("job_id"), i(F.floor(F.col("doc_id") % 100 / 7)).alias("n"),
        i(1 + F.col("quality") * 3).alias("like"), i(1 + F.col("doc_id") % 4).alias("content"), i(1 + F.col("doc_id") % 3).alias("visual"),
    )


#: A reviewer's session event by event: all clip states `st`, the clips scored (`rc`) and dropped (`dr`) last.
SESSION = """ce AS (SELECT 's' || (doc_id // 100) AS reviewer, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS k, CASE WHEN doc_id % 7 = 3 THEN 'drop' WHEN doc_id % 7 = 5 THEN 'undrop' ELSE 'score' END AS kind,
      'j' || (doc_id % 2) || '|' || ((doc_id % 100) // 7) AS c, coalesce(1 + quality * 3, 0) + 1 + doc_id % 4 + 1 + doc_id % 3 AS total FROM labels),
  cs AS (SELECT reviewer, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(c VARCHAR, t BIGINT, s VARCHAR, sub BOOLEAN)[]) AS st, CAST([] AS VARCHAR[]) AS rc, CAST([] AS VARCHAR[]) AS dr FROM ce GROUP BY reviewer
    UNION ALL SELECT reviewer, k, CASE WHEN gone THEN st ELSE list_transform(st1, lambda x: CASE WHEN x.c = coalesce(ro, '') AND x.s <> 'purged' THEN {'c': x.c, 't': x.t, 's': CASE WHEN x.t < 10 THEN 'purged' ELSE 'kept' END, 'sub': true}
          WHEN x.c = coalesce(d_o, '') AND x.s = 'dropped' THEN {'c': x.c, 't': x.t, 's': 'purged', 'sub': true} ELSE x END) END,
        CASE WHEN gone OR kind <> 'score' THEN rc WHEN len(rc1) > 3 THEN rc1[2:] ELSE rc1 END, CASE WHEN gone THEN dr WHEN kind = 'drop' AND len(dr1) > 3 THEN dr1[2:] WHEN kind = 'drop' THEN dr1 WHEN kind = 'undrop' AND was = 'dropped' THEN list_filter(dr, lambda x: x <> c) ELSE dr END FROM (
      SELECT *, CASE WHEN kind = 'score' AND len(rc1) > 3 THEN rc1[1] END AS ro, CASE WHEN kind = 'drop' AND len(dr1) > 3 THEN dr1[1] END AS d_o,
          list_transform(CASE WHEN was IS NULL THEN list_append(st, {'c': c, 't': 9, 's': 'pending', 'sub': false}) ELSE st END, lambda x: CASE WHEN x.c <> c THEN x
            WHEN kind = 'score' THEN {'c': x.c, 't': total, 's': CASE WHEN total < 10 THEN 'doomed' ELSE 'kept' END, 'sub': true} WHEN kind = 'drop' THEN {'c': x.c, 't': x.t, 's': 'dropped', 'sub': x.sub}
            WHEN x.s = 'dropped' THEN {'c': x.c, 't': x.t, 's': 'kept', 'sub': x.sub} ELSE x END) AS st1 FROM (
        SELECT ce.*, st, rc, dr, list_append(list_filter(rc, lambda x: x <> ce.c), ce.c) AS rc1, list_append(list_filter(dr, lambda x: x <> ce.c), ce.c) AS dr1,
          list_filter(st, lambda x: x.c = ce.c)[1].s AS was, coalesce(list_filter(st, lambda x: x.c = ce.c)[1].s = 'purged', false) AS gone FROM cs JOIN ce ON ce.reviewer = cs.reviewer AND ce.k = cs.k + 1))),
  cf AS (SELECT reviewer, unnest(arg_max(st, k)) AS x FROM cs GROUP BY reviewer)"""
STATES = f"""WITH RECURSIVE {SESSION} SELECT reviewer, split_part(x.c, '|', 1) AS job_id, CAST(split_part(x.c, '|', 2) AS INTEGER) AS n, CAST(x.t AS INTEGER) AS total, x.s AS status, x.sub AS submitted FROM cf WHERE x.s <> 'pending'"""


@query("flow_clip_states", STATES)
def _(t):
    return rv.clip_states(review_events(t))


@query(
    "jn_recent_clips",
    """WITH e AS (SELECT 's' || (doc_id // 100) AS reviewer, doc_id AS seq, 'j' || (doc_id % 2) AS job_id, CAST((doc_id % 100) // 7 AS INTEGER) AS n FROM labels WHERE doc_id % 7 NOT IN (3, 5))
       SELECT reviewer, job_id, n, CAST(rn AS INTEGER) AS ord FROM (SELECT reviewer, job_id, n, row_number() OVER (PARTITION BY reviewer ORDER BY max(seq) DESC) AS rn FROM e GROUP BY reviewer, job_id, n) WHERE rn <= 3""",
)
def _(t):
    none = t.spark.createDataFrame([], rv.STATE_SCHEMA)
    return rv.recent_clips(review_events(t), none).select("reviewer", "job_id", "n", "ord")


@query(
    "tk_next_pending",
    """WITH e AS (SELECT 's' || (doc_id // 100) AS reviewer, doc_id AS seq, 'j' || (doc_id % 2) AS job_id, CAST((doc_id % 100) // 7 AS INTEGER) AS n FROM labels WHERE doc_id % 7 NOT IN (3, 5)),
         r AS (SELECT reviewer, job_id, n, row_number() OVER (PARTITION BY reviewer ORDER BY max(seq) DESC) AS rn FROM e GROUP BY reviewer, job_id, n),
         p AS (SELECT 's' || (doc_id % 5) AS reviewer, source AS job_id, CAST(doc_id AS INTEGER) AS n FROM documents)
       SELECT reviewer, job_id, n FROM (SELECT p.*, row_number() OVER (PARTITION BY reviewer ORDER BY tired, h, job_id, n) AS k FROM (
         SELECT p.*, md5('7|' || job_id || '|' || n) AS h, (SELECT count(*) >= 2 FROM r WHERE r.reviewer = p.reviewer AND r.job_id = p.job_id AND rn <= 2) AS tired FROM p
         WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.reviewer = p.reviewer AND r.job_id = p.job_id AND r.n = p.n AND rn <= 3)) p) WHERE k = 1""",
)
def _(t):
    pool = clip_rows(t).withColumns({"reviewer": F.concat(F.lit("s"), (F.col("n") % 5).cast("string")), "status": F.lit("pending"), "submitted": F.lit(False)})
    none = t.spark.createDataFrame([], rv.STATE_SCHEMA)
    return rv.next_pending(pool, rv.recent_clips(review_events(t), none), seed=7)


@query(
    "jn_with_highlight",
    f"""WITH {ST}, h AS (SELECT source AS job_id, doc_id AS id, 'H' || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents WHERE doc_id % 2 = 0)
        SELECT d.source AS job_id, CAST(d.doc_id AS INTEGER) AS n, coalesce(CASE WHEN dec.candidate_id % 2 = 0 THEN 'T' || dec.candidate_id END, i.title, p.title) AS title
        FROM documents d LEFT JOIN h i ON i.job_id = d.source AND i.id = d.doc_id LEFT JOIN h p ON p.job_id = d.source AND p.pos = d.doc_id LEFT JOIN dec ON dec.job_id = d.source AND dec.candidate_id = d.doc_id""",
)
def _(t):
    h = clip_rows(t).where(F.col("n") % 2 == 0).select(
        "job_id", F.col("n").alias("id"), F.col("n").alias("ord"), F.concat(F.lit("H"), F.col("n").cast("string")).alias("title"),
        *[F.lit("x").alias(c) for c in ("suggested_hook", "reason")], *[F.lit(1.0).alias(c) for c in ("score", "start", "end")],
    )
    return rv.with_highlight(clip_rows(t), h, decisions(t)).select("job_id", "n", "title")


@query(
    "ag_progress_counts",
    f"""WITH {ST}, j AS (SELECT DISTINCT source AS job_id FROM documents), q AS (SELECT source AS job_id, count(*) AS c FROM documents WHERE doc_id % 4 = 0 GROUP BY source),
        d AS (SELECT job_id, count(*) FILTER (action = 'keep') AS k, count(*) FILTER (action = 'reject') AS r FROM dec GROUP BY job_id),
        h AS (SELECT source AS job_id, CAST(doc_id AS INTEGER) AS n FROM documents WHERE doc_id % 11 = 1),
        hn AS (SELECT job_id, count(*) AS c FROM h GROUP BY job_id),
        cl AS (SELECT job_id, n FROM h UNION SELECT d.job_id, CAST(i AS INTEGER) FROM (SELECT job_id, unnest(range(1, k + 1)) AS i FROM d WHERE job_id NOT IN (SELECT job_id FROM h)) d UNION SELECT job_id, n FROM st),
        x AS (SELECT cl.job_id, count(*) FILTER (status = 'purged') AS purged, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status NOT IN ('purged', 'dropped') AND submitted) AS sub,
                     count(*) FILTER (status NOT IN ('purged', 'dropped') AND submitted AND (status = 'kept' OR total >= 10)) AS ready FROM cl LEFT JOIN st ON st.job_id = cl.job_id AND st.n = cl.n GROUP BY cl.job_id)
        SELECT job_id, CASE WHEN coalesce(q.c, 0) > 0 THEN q.c ELSE coalesce(k, 0) + coalesce(r, 0) END AS total_clips, coalesce(purged + dropped + sub, 0) AS scored, CASE WHEN coalesce(k, 0) > 0 THEN k ELSE coalesce(hn.c, 0) END AS reviewable,
               coalesce(ready, 0) AS edit_ready, coalesce(dropped + sub, 0) AS edit_total, coalesce(r, 0) + coalesce(purged, 0) AS eliminated
        FROM j LEFT JOIN q USING (job_id) LEFT JOIN d USING (job_id) LEFT JOIN hn USING (job_id) LEFT JOIN x USING (job_id)""",
)
def _(t):
    c = clip_rows(t)
    h = c.where(F.col("n") % 11 == 1).select("job_id", F.col("n").alias("id"))
    return rv.progress_counts(c.select("job_id").distinct(), c.where(F.col("n") % 4 == 0), decisions(t), h, states(t))
