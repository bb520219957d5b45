"""Registered queries: whole flows over the day recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.intervals import SUGGEST
from clipmine.catalog.signals import HIST, THIN
from clipmine.catalog.tables import DAY, with_
from clipmine.operators import select as sel
from clipmine.operators.features import rank_in_hour
from clipmine.plans import queue as qu
from clipmine.plans.candidates import enrich_candidates, score_candidates, softban

r6 = lambda c: F.round(c, 6)


def snap(src: str, name: str, lookback: int) -> str:
    """`name`: rows of `src(vod_id, key, s, e)` with `s` moved to the nearest voice onset."""
    return f"""{name} AS (SELECT vod_id, key, CASE WHEN o IS NOT NULL AND e > s THEN greatest(0e0, o - 0.08e0) ELSE s END AS s, e FROM (
      SELECT w.vod_id, w.key, w.s, w.e, arg_min(v.s, abs(v.s - w.s) * 1e6 + v.s / 1e9) AS o FROM {src} w
      LEFT JOIN speech v ON v.vod_id = w.vod_id AND v.e > w.s AND v.s < w.e AND v.s >= greatest(0e0, w.s - {lookback}) GROUP BY ALL))"""


def around(n: int) -> str:
    return f"""a{n} AS (SELECT vod_id, t AS key, greatest(0e0, least(86400e0, greatest(0e0, t - {n} / 2e0) + {n}) - {n}) AS s, least(86400e0, greatest(0e0, t - {n} / 2e0) + {n}) AS e FROM seeds),
  {snap(f'a{n}', f'b{n}', 8)},
  c{n} AS (SELECT vod_id, key, s, least(86400e0, s + {n}) AS e FROM b{n}),
  d{n} AS (SELECT vod_id, key, greatest(0e0, e - {n}) AS s, e FROM c{n} WHERE e - s < {n} AND s > 0),
  {snap(f'd{n}', f'f{n}', 4)},
  g{n} AS (SELECT * FROM c{n} WHERE NOT (e - s < {n} AND s > 0) UNION ALL SELECT * FROM f{n})"""


SCORED = ",\n".join(
    (
        HIST, THIN, around(600), around(300), "sl AS (SELECT vod_id, win_id * 1e0 AS key, s, e FROM win)", snap("sl", "sn", 8),
        """al AS (SELECT vod_id, 0 AS source, key, 600 AS wlen, s, e FROM g600 UNION ALL SELECT vod_id, 0, key, 300, s, e FROM g300 UNION ALL SELECT vod_id, 1, key, 0, s, e FROM sn),
  al2 AS (SELECT *, row_number() OVER () AS id, e - s AS len FROM al),
  fc AS (SELECT id, count(*) AS n, count(*) FILTER (message = 'purchase') AS la, count(*) FILTER (message = 'error') AS co, count(*) FILTER (message = 'signup') AS cu,
           sum(CASE WHEN message = 'click' THEN 1 WHEN message IN ('purchase', 'error', 'view') THEN 1 ELSE 0 END) AS kw FROM al2 JOIN ev ON ev.vod_id = al2.vod_id AND t >= s AND t < e GROUP BY id),
  fz AS (SELECT id, avg(z) AS z FROM al2 JOIN loud l ON l.vod_id = al2.vod_id AND t >= s AND t < e GROUP BY id),
  fe AS (SELECT id, max(score) AS em FROM al2 JOIN emo l ON l.vod_id = al2.vod_id AND t >= s AND t < e GROUP BY id),
  fs AS (SELECT id, least(1e0, sum(least(al2.e, v.e) - greatest(al2.s, v.s)) / any_value(len)) AS sp FROM al2 JOIN speech v ON v.vod_id = al2.vod_id AND v.e > al2.s AND v.s < al2.e GROUP BY id),
  ftx AS (SELECT id, string_agg(trim(text), '' ORDER BY seg_id) AS x FROM al2 JOIN seg v ON v.vod_id = al2.vod_id AND v.e > al2.s AND v.s < al2.e GROUP BY id),
  sc AS (SELECT al2.*, coalesce(z, 0e0) AS z, coalesce(em, 0e0) AS em, coalesce(sp, 0e0) AS sp, coalesce(x, '') AS x, CAST(coalesce(kw, 0) AS BIGINT) AS kw,
      coalesce(n, 0) / len AS den, least(2e0, coalesce(la, 0) / len) + 0.7e0 * least(2e0, coalesce(co, 0) / len) AS react, least(3e0, coalesce(cu, 0) * 1.5e0) AS cue,
      CAST((length(coalesce(x, '')) - length(replace(coalesce(x, ''), 'u1', ''))) // 2 + (length(coalesce(x, '')) - length(replace(coalesce(x, ''), 'k7', ''))) // 2 AS BIGINT) AS hits
    FROM al2 LEFT JOIN fc USING (id) LEFT JOIN fz USING (id) LEFT JOIN fe USING (id) LEFT JOIN fs USING (id) LEFT JOIN ftx USING (id)),
  sv AS (SELECT *, 2e0 * den + 0.8e0 * greatest(0e0, z) + 1.4e0 * hits + 1.2e0 * kw + 1.6e0 * react + 2.5e0 * cue + em + 0.5e0 * sp AS score FROM sc),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vod_id, source, key ORDER BY score DESC, wlen DESC) AS rn FROM sv) WHERE rn = 1)""",
    )
)


@query(
    "flow_score_candidates",
    with_(
        "ev", "loud", "emo", "vods", "speech", "seg", "win",
        body="""SELECT vod_id, CAST(source AS INTEGER) AS source, round(key, 3) AS place, round(s, 6) AS start, round(e, 6) AS "end", round(score, 8) AS score, hits AS keyword_hits, kw AS chat_kw_hits, round(sp, 6) AS speech_ratio, round(em, 6) AS emotion_score FROM best""",
        recursive=SCORED,
    ),
)
def _(t):
    c = score_candidates(t.recordings, DAY)
    r5 = lambda x: F.round(x, 6).alias(x)
    return c.select("vod_id", "source", F.round("place", 3).alias("place"), r5("start"), r5("end"), F.round("score", 8).alias("score"), "keyword_hits", "chat_kw_hits", r5("speech_ratio"), r5("emotion_score"))


def ban(o: float, i: float) -> str:
    return f"""least(CASE WHEN outro THEN {max(0.05, o)}e0 WHEN s >= 86400 * 0.92e0 THEN 0.55e0 ELSE 1e0 END,
      CASE WHEN intro AND s < 86400 * 0.08e0 THEN {max(0.05, i)}e0 WHEN intro THEN {max(0.12, i * 1.2):.2f}e0 WHEN s < 86400 * 0.08e0 THEN 0.65e0 ELSE 1e0 END)"""


@query(
    "fn_softban",
    with_(
        "win", "seg",
        body=f"""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, intro AS is_intro, outro AS is_outro, round({ban(0.15, 0.15)}, 6) AS multiplier FROM (
                   SELECT *, contains(x, 'k12') OR contains(x, 'u33') AS intro, contains(x, 'k9') OR contains(x, 'u44') AS outro FROM (
                     SELECT w.vod_id, win_id, w.s, coalesce(string_agg(text, '' ORDER BY seg_id), '') AS x FROM win w LEFT JOIN seg g ON g.vod_id = w.vod_id AND g.e > w.s AND g.s < w.e GROUP BY ALL))""",
    ),
)
def _(t):
    from clipmine.catalog.signals import windows
    from clipmine.operators.joins import window_text

    w = windows(t)
    x = w.join(window_text(t.segments, w, ids=["win_id"]), ["vod_id", "win_id"], "left").withColumns(
        {"duration_sec": F.lit(86400.0), "content_type": F.lit("talk")}
    )
    return softban(x, DAY, text="text").select("vod_id", "win_id", "is_intro", "is_outro", r6("multiplier").alias("multiplier"))


#: `er`: enriched candidates, numbered by score and ranked in their hour; `sug`: their bounds.
ENRICHED = f"""cands AS (SELECT vod_id, id AS clip_id, s, e FROM best), {SUGGEST.replace('FROM clips c', 'FROM cands c')},
  e0 AS (SELECT *, contains(x, 'k12') OR contains(x, 'u33') AS intro, contains(x, 'k9') OR contains(x, 'u44') AS outro FROM best),
  e1 AS (SELECT e0.*, {ban(0.15, 0.15)} AS mult, CAST(floor(s / 3600) AS INTEGER) AS hour FROM e0),
  e2 AS (SELECT e1.* EXCLUDE score, score AS raw, round(score * mult, 9) AS score FROM e1),
  e3 AS (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY score DESC, source, key) AS cid, score + (score - avg(score) OVER h) / CASE WHEN var_pop(score) OVER h > 1e-12 THEN stddev_pop(score) OVER h ELSE 1 END AS rank_score FROM e2 WINDOW h AS (PARTITION BY vod_id, hour)),
  er AS (SELECT * REPLACE (round(rank_score, 9) AS rank_score) FROM e3)"""
ENRICHED_FROM = ("ev", "loud", "emo", "vods", "speech", "seg", "win")


def in_nine_digits(df):
    """Scores at nine decimals, so that ties are ties."""
    return df.withColumns({c: F.round(c, 9) for c in ("score", "rank_score") if c in df.columns})


@query(
    "flow_enriched_candidates",
    with_(
        *ENRICHED_FROM,
        recursive=f"{SCORED}, {ENRICHED}",
        body="""SELECT er.vod_id, CAST(source AS INTEGER) AS source, round(key, 3) AS place, round(er.s, 6) AS start, round(er.e, 6) AS "end", round(score, 6) AS score, round(mult, 6) AS multiplier, intro AS is_intro, outro AS is_outro,
                round(round_even(a, 3), 1) AS suggested_start, round(round_even(b, 3), 1) AS suggested_end, round(den, 6) AS density, kw AS kw_hits, 'normal' AS strategy FROM er JOIN sug ON sug.clip_id = er.id""",
    ),
)
def _(t):
    e = in_nine_digits(enrich_candidates(score_candidates(t.recordings, DAY), t.recordings, DAY))
    return e.select(
        "vod_id", "source", F.round("place", 3).alias("place"), r6("start").alias("start"), r6("end").alias("end"), r6("score").alias("score"), r6("multiplier").alias("multiplier"), "is_intro", "is_outro",
        F.round("suggested_start", 1).alias("suggested_start"), F.round("suggested_end", 1).alias("suggested_end"), r6("breakdown.chat_density").alias("density"), F.col("breakdown.chat_kw_hits").alias("kw_hits"), "breakdown.strategy",
    )


#: The review queue `qq` of `er`: greedy, diverse, ten at most.
QUEUE = """rq AS (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY rank_score DESC, s, cid) AS k FROM er),
  dq AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, s DOUBLE, e DOUBLE, v DOUBLE)[]) AS c FROM rq GROUP BY vod_id
    UNION ALL SELECT dq.vod_id, rq.k, CASE WHEN len(list_filter(c, lambda y: ((rq.s < y.e AND y.s < rq.e) OR abs((rq.s + rq.e) / 2 - (y.s + y.e) / 2) < 900) AND rq.rank_score < y.v * 1.35e0)) = 0
        THEN list_append(c, {'id': CAST(rq.id AS BIGINT), 's': rq.s, 'e': rq.e, 'v': rq.rank_score}) ELSE c END
    FROM dq JOIN rq ON rq.vod_id = dq.vod_id AND rq.k = dq.k + 1 WHERE len(c) < 10),
  tq AS (SELECT vod_id, unnest(c).id AS id, generate_subscripts(c, 1) AS rank FROM (SELECT vod_id, arg_max(c, k) AS c FROM dq GROUP BY vod_id)),
  uq AS (SELECT er.*, rank, NOT intro AND NOT outro AND (cue > 0 OR react > 0.08 OR rank_score >= 2.0) AS ok FROM tq JOIN er USING (vod_id, id)),
  qq AS (SELECT *, CASE WHEN ok AND row_number() OVER (PARTITION BY vod_id, hour, ok ORDER BY rank) <= 4 THEN 'keep' ELSE 'reject' END AS action FROM uq)"""


def review_queue_of(t):
    e = in_nine_digits(enrich_candidates(score_candidates(t.recordings, DAY), t.recordings, DAY))
    return qu.review_queue(in_nine_digits(rank_in_hour(sel.number_by_score(e))), DAY)


@query(
    "flow_review_queue",
    with_(
        *ENRICHED_FROM,
        recursive=f"{SCORED}, {ENRICHED}, {QUEUE}",
        body=r"""SELECT vod_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS start, round(e, 6) AS "end", round(rank_score, 6) AS rank_score, CASE WHEN x = '' THEN '精華片段' ELSE left(regexp_replace(x, '\s+', '', 'g'), 20) END AS title, action FROM qq""",
    ),
)
def _(t):
    return review_queue_of(t).select("vod_id", "rank", r6("start").alias("start"), r6("end").alias("end"), r6("rank_score").alias("rank_score"), "title", "action")


VIEW = """sm AS (SELECT id, string_agg('t=' || CAST(round_even(t, 1) AS VARCHAR) || '「' || message || '」', '; ' ORDER BY seq) AS samples FROM (
      SELECT qq.id, ev.seq, ev.t, ev.message, row_number() OVER (PARTITION BY qq.id ORDER BY ev.seq) AS n FROM qq JOIN ev ON ev.vod_id = qq.vod_id AND ev.t >= qq.s AND ev.t < qq.e WHERE ev.message IN ('purchase', 'error', 'signup')) WHERE n <= 3 GROUP BY id),
  vw AS (SELECT qq.*, peak, coalesce(samples, '') AS samples, CASE WHEN x = '' THEN '精華片段' ELSE left(regexp_replace(x, '\\s+', '', 'g'), 20) END AS title FROM qq JOIN sug ON sug.clip_id = qq.id JOIN sp ON sp.clip_id = qq.id LEFT JOIN sm USING (id))"""


@query(
    "sink_review_view",
    with_(
        *ENRICHED_FROM,
        recursive=f"{SCORED}, {ENRICHED}, {QUEUE}, {VIEW}",
        body="""SELECT vod_id, CAST(cid AS INTEGER) AS candidate_id, round(score, 6) AS score, round(s, 6) AS start, round(e, 6) AS "end", title, '「當' || title || '…」' AS suggested_hook,
                  concat_ws(',', CASE WHEN outro THEN 'outro' END, CASE WHEN intro THEN 'intro' END, CASE WHEN cue > 0 THEN 'clip_cue' END) AS flags,
                  concat_ws('；', CASE WHEN cue > 0 THEN '觀眾剪輯 cue' END, CASE WHEN react > 0.05 THEN printf('彈幕反應 %.2f', react) END, CASE WHEN peak IS NOT NULL THEN printf('反應峰 t=%.0f（內容約前推 %.0fs）', peak, 30e0) END,
                    CASE WHEN hits > 0 THEN printf('字幕關鍵字×%d', hits) END) AS why, samples, left(x, 700) AS transcript FROM vw""",
    ),
)
def _(t):
    from clipmine.operators.reports import review_view

    v = review_view(review_queue_of(t))
    return v.select("vod_id", "candidate_id", r6("score").alias("score"), r6("start").alias("start"), r6("end").alias("end"), "title", "suggested_hook", "flags", "why", "samples", "transcript")


@query("flow_arc_highlights")
def _(t):
    return qu.highlights(t.recordings, DAY, auto_arcs=True).select("vod_id", "id", "start", "end", "title", "reason", r6("score").alias("score"), "chapter_id")


STAMPED = "printf('%02d:%02d:%02d', {m} // 3600000, {m} % 3600000 // 60000, {m} % 60000 // 1000)"
REVIEWED = """rd AS (SELECT qq.vod_id, rank, round_even(a, 3) AS s, round_even(b, 3) AS e, score, CASE WHEN x = '' THEN '精華片段' ELSE left(regexp_replace(x, '\\s+', '', 'g'), 20) END AS title FROM qq JOIN sug ON sug.clip_id = qq.id WHERE action = 'keep'),
  ro AS (SELECT *, CAST(floor(s / 3600) AS BIGINT) AS hr, row_number() OVER (PARTITION BY vod_id ORDER BY score DESC, rank) AS k FROM rd WHERE e > s),
  ap AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(r BIGINT, hr BIGINT, s DOUBLE, e DOUBLE)[]) AS c FROM ro GROUP BY vod_id
    UNION ALL SELECT ap.vod_id, ro.k, CASE WHEN len(list_filter(c, lambda y: y.hr = ro.hr)) < 4 AND len(list_filter(c, lambda y: y.s < ro.e AND ro.s < y.e)) = 0 THEN list_append(c, {'r': CAST(ro.rank AS BIGINT), 'hr': ro.hr, 's': ro.s, 'e': ro.e}) ELSE c END
    FROM ap JOIN ro ON ro.vod_id = ap.vod_id AND ro.k = ap.k + 1),
  hl AS (SELECT ro.*, row_number() OVER (PARTITION BY vod_id ORDER BY s) AS id, CAST(round_even(s * 1000, 0) AS BIGINT) AS m FROM (SELECT vod_id, unnest(arg_max(c, k)).r AS rank FROM ap GROUP BY vod_id) JOIN ro USING (vod_id, rank))"""


@query(
    "flow_reviewed_highlights",
    with_(
        *ENRICHED_FROM,
        recursive=f"{SCORED}, {ENRICHED}, {QUEUE}, {REVIEWED}",
        body=f"""SELECT vod_id, CAST(id AS INTEGER) AS id, round(s, 1) AS start, round(e, 1) AS "end", title, {STAMPED.format(m='m')} AS start_display FROM hl""",
    ),
)
def _(t):
    """Reviewers follow the suggested actions."""
    from clipmine.session import cut_lineage

    e = in_nine_digits(enrich_candidates(score_candidates(t.recordings, DAY), t.recordings, DAY))
    ranked = cut_lineage(in_nine_digits(rank_in_hour(sel.number_by_score(e))))
    queue = cut_lineage(qu.review_queue(ranked, DAY))
    none = F.lit(None)
    d = queue.select(
        "vod_id", F.col("rank").alias("candidate_id"), "action", F.col("rank").alias("ord"), none.cast("double").alias("start"),
        none.cast("double").alias("end"), none.cast("string").alias("title"), none.cast("string").alias("hook"),
    )
    h = qu.reviewed_highlights(ranked, queue, d, DAY)
    return h.select("vod_id", "id", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"), "title", F.left("start_display", F.lit(8)).alias("start_display"))
