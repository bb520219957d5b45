"""Registered queries: signals, histograms, seeds, window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.tables import DAY, merge_sql, with_
from clipmine.operators import features as ft
from clipmine.operators import signals as sg
from clipmine.operators.joins import points_in_windows

r6 = lambda c: F.round(c, 6)


def windows(t):
    w = ft.hourly_windows(t.vods, DAY)
    return w.select("vod_id", (F.col("h") * 1000 + F.col("i")).cast("long").alias("win_id"), "start", "end")


def scored(t):
    """Chat-scored sliding windows of every day."""
    w = windows(t)
    f = ft.chat_features(sg.mark_reactions(t.chat, DAY), w)
    score = 2.0 * F.col("chat_density") + 1.6 * (F.col("laugh") + 0.7 * F.col("confused")) + 2.5 * F.col("chat_cue") + 1.2 * F.col("chat_kw_hits")
    return w.join(f, ["vod_id", "win_id"]).withColumn("score", score).withColumn("hour_bucket", F.floor(F.col("start") / 3600).cast("int"))


@query("iv_hourly_windows", with_("win", body='SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, s AS start, e AS "end" FROM win'))
def _(t):
    return windows(t)


@query(
    "ag_chat_features",
    with_(
        "chatf",
        body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, round(density, 6) AS chat_density, round(laugh, 6) AS laugh, round(confused, 6) AS confused,
                       round(cue, 6) AS chat_cue, CAST(kw AS BIGINT) AS chat_kw_hits, peak AS reaction_peak_t FROM chatf""",
    ),
)
def _(t):
    f = ft.chat_features(sg.mark_reactions(t.chat, DAY), windows(t))
    return f.select(
        "vod_id", "win_id", *[r6(c).alias(c) for c in ("chat_density", "laugh", "confused", "chat_cue")], "chat_kw_hits", "reaction_peak_t"
    )


@query(
    "ag_chat_samples",
    with_(
        "ev", "win",
        body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, coalesce(string_agg(message, '|' ORDER BY seq), '') AS samples FROM (
                  SELECT w.vod_id, win_id, seq, message, row_number() OVER (PARTITION BY w.vod_id, win_id ORDER BY seq) AS rn
                  FROM win w LEFT JOIN ev ON ev.vod_id = w.vod_id AND ev.t >= w.s AND ev.t < w.e AND message IN ('purchase', 'error', 'signup'))
                WHERE rn <= 3 GROUP BY vod_id, win_id""",
    ),
)
def _(t):
    f = ft.chat_features(sg.mark_reactions(t.chat, DAY), windows(t))
    return f.select("vod_id", "win_id", F.array_join(F.transform("chat_samples", lambda s: s["message"]), "|").alias("samples"))


@query(
    "ag_loudness_zscore",
    with_("loud", body="SELECT vod_id, peak_id, round(z, 6) AS zscore FROM loud"),
)
def _(t):
    return t.loudness.select("vod_id", "peak_id", r6("zscore").alias("zscore"))


@query(
    "ag_emotion_peaks",
    with_("emo", body="SELECT vod_id, t, round(score, 6) AS score, kind FROM emo"),
)
def _(t):
    return sg.emotion_peaks(t.frames).select("vod_id", "t", r6("score").alias("score"), "kind")


@query(
    "ag_signal_features",
    with_(
        "win", "loud", "emo",
        body="""SELECT w.vod_id, CAST(w.win_id AS BIGINT) AS win_id, round(coalesce(a.z, 0e0), 6) AS mean_zscore, round(coalesce(b.m, 0e0), 6) AS emotion_score
                FROM win w
                LEFT JOIN (SELECT w.vod_id, win_id, avg(z) AS z FROM win w JOIN loud l ON l.vod_id = w.vod_id AND l.t >= w.s AND l.t < w.e GROUP BY ALL) a USING (vod_id, win_id)
                LEFT JOIN (SELECT w.vod_id, win_id, max(score) AS m FROM win w JOIN emo l ON l.vod_id = w.vod_id AND l.t >= w.s AND l.t < w.e GROUP BY ALL) b USING (vod_id, win_id)""",
    ),
)
def _(t):
    f = ft.signal_features(t.loudness, t.emotion, windows(t))
    return f.select("vod_id", "win_id", r6("mean_zscore").alias("mean_zscore"), r6("emotion_score").alias("emotion_score"))


@query(
    "jn_points_in_windows",
    with_(
        "ev", "clips",
        body="""SELECT clip_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM clips c JOIN ev ON ev.vod_id = c.vod_id AND ev.t >= c.s AND ev.t < c.e GROUP BY clip_id""",
    ),
)
def _(t):
    # Thresholds far below the defaults, so that hot keys are split here too.
    pairs = points_in_windows(t.chat.select("vod_id", "seq", "t"), t.clips, spread=("seq",), min_rows=3, share=1e-5)
    return pairs.groupBy(F.col("w_clip_id").alias("clip_id")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "ag_chat_histogram",
    with_(
        "ev",
        body="""SELECT vod_id, CAST(floor(t / 300) AS BIGINT) AS bin, count(*) AS n,
                       round(sum(CASE message WHEN 'purchase' THEN 1e0 WHEN 'error' THEN 0.8e0 WHEN 'signup' THEN 2.5e0 ELSE 0e0 END), 6) AS react
                FROM ev GROUP BY ALL""",
    ),
)
def _(t):
    h = sg.chat_histogram(sg.mark_reactions(t.chat, DAY), bin_sec=300.0)
    return h.select("vod_id", "bin", "n", r6("react").alias("react"))


@query(
    "ag_upper_median",
    with_(
        "ev",
        body="""SELECT vod_id, list_sort(list(n))[len(list(n)) // 2 + 1] AS median FROM (
                  SELECT vod_id, floor(t / 300) AS bin, count(*) AS n FROM ev GROUP BY ALL) GROUP BY vod_id""",
    ),
)
def _(t):
    h = sg.chat_histogram(sg.mark_reactions(t.chat, DAY), bin_sec=300.0)
    return sg.upper_median(h, "n")


HIST = """hist AS (SELECT vod_id, CAST(floor(t / 5) AS BIGINT) AS bin, count(*) AS n,
            sum(CASE message WHEN 'purchase' THEN 1e0 WHEN 'error' THEN 0.8e0 WHEN 'signup' THEN 2.5e0 ELSE 0e0 END) AS react FROM ev GROUP BY ALL),
  med AS (SELECT vod_id, list_sort(list(n))[len(list(n)) // 2 + 1] AS mn FROM hist GROUP BY vod_id),
  rmed AS (SELECT vod_id, list_sort(list(react))[len(list(react)) // 2 + 1] AS mr FROM hist WHERE react > 0 GROUP BY vod_id),
  burst AS (SELECT vod_id, bin, n, react, n >= greatest(2, floor(mn * 1.2e0)) AS by_count, coalesce(react > 0 AND react >= greatest(1.5e0, mr * 1.2e0), false) AS by_react
            FROM hist JOIN med USING (vod_id) LEFT JOIN rmed USING (vod_id)),
  raw AS (SELECT DISTINCT vod_id, round_even(t, 1) AS t FROM (
            SELECT vod_id, t FROM loud WHERE z >= 1.5 UNION ALL SELECT vod_id, t FROM emo WHERE score >= 2.5
            UNION ALL SELECT vod_id, greatest(0e0, bin * 5e0 + 2.5e0 - 30) FROM burst WHERE by_count OR by_react) WHERE t >= 0 AND t < 86400)"""
THIN = """thin AS (
    SELECT vod_id, min(t) AS t FROM raw GROUP BY vod_id
    UNION ALL
    SELECT thin.vod_id, (SELECT min(r.t) FROM raw r WHERE r.vod_id = thin.vod_id AND r.t - thin.t >= 60) AS t FROM thin WHERE thin.t IS NOT NULL),
  seeds AS (SELECT vod_id, t FROM thin WHERE t IS NOT NULL
    UNION ALL
    SELECT vod_id, (h * 3600e0 + least((h + 1) * 3600e0, duration_sec)) / 2 FROM vods, (SELECT unnest(range(24)) AS h)
    WHERE NOT EXISTS (SELECT 1 FROM thin x WHERE x.vod_id = vods.vod_id AND floor(x.t / 3600) = h))"""


@query(
    "ag_burst_bins",
    with_("ev", "loud", "emo", body="SELECT vod_id, bin, n, round(react, 6) AS react, by_count, by_react FROM burst WHERE by_count OR by_react", recursive=HIST),
)
def _(t):
    h = sg.chat_histogram(sg.mark_reactions(t.chat, DAY))
    return sg.burst_bins(h, mult=1.2).select("vod_id", "bin", "n", r6("react").alias("react"), "by_count", "by_react")


@query("iv_raw_seeds", with_("ev", "loud", "emo", body="SELECT vod_id, round(t, 3) AS t FROM raw", recursive=HIST))
def _(t):
    s = sg.raw_seeds(t.loudness, t.emotion, sg.mark_reactions(t.chat, DAY), t.vods, mult=1.2, lag=30.0)
    return s.select("vod_id", F.round("t", 3).alias("t"))


@query("iv_thinned_seeds", with_("ev", "loud", "emo", "vods", body="SELECT vod_id, round(t, 3) AS t FROM seeds", recursive=HIST + ",\n" + THIN))
def _(t):
    from clipmine.plans.candidates import Recordings, seed_times

    rec = Recordings(t.vods, t.chat, t.segments, t.loudness, t.emotion, t.speech)
    s = seed_times(rec, sg.mark_reactions(t.chat, DAY), DAY)
    return s.select("vod_id", F.round("t", 3).alias("t"))


@query(
    "ag_rank_in_hour",
    with_("ranked", body="SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, round(score, 6) AS score, round(rank_score, 6) AS rank_score FROM ranked"),
)
def _(t):
    return ft.rank_in_hour(scored(t)).select("vod_id", "win_id", r6("score").alias("score"), r6("rank_score").alias("rank_score"))


@query(
    "flow_top_windows",
    with_(
        "ranked",
        body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, s AS start, e AS "end", round(score, 6) AS score, round(rank_score, 6) AS rank_score FROM (
                  SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY round(rank_score, 9) DESC, win_id) AS rn FROM ranked) WHERE rn <= 5""",
    ),
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("vod_id").orderBy(F.round("rank_score", 9).desc(), "win_id")
    top = ft.rank_in_hour(scored(t)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 5)
    return top.select("vod_id", "win_id", "start", "end", r6("score").alias("score"), r6("rank_score").alias("rank_score"))


@query(
    "fn_reason",
    with_(
        "chatf",
        body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, concat_ws('、',
                  CASE WHEN density > 0 THEN '彈幕密度 ' || printf('%.3f', density) || '/s' END,
                  CASE WHEN round(laugh + 0.7e0 * confused, 4) > 0 THEN '彈幕反應 ' || printf('%.4f', round(laugh + 0.7e0 * confused, 4)) END,
                  CASE WHEN cue > 0 THEN '剪輯 cue ' || printf('%.1f', cue) END,
                  CASE WHEN kw > 0 THEN '彈幕關鍵字 ' || kw END, '語音占比 0.50') AS why FROM chatf""",
    ).replace("彈幕反應 ' || printf('%.4f', round(laugh + 0.7e0 * confused, 4))", "彈幕反應 ' || printf('%.2f', round(laugh + 0.7e0 * confused, 4))"),
)
def _(t):
    from clipmine.functions import text as tx

    f = ft.chat_features(sg.mark_reactions(t.chat, DAY), windows(t))
    f = f.withColumn("chat_react", F.round(F.col("laugh") + 0.7 * F.col("confused"), 4)).withColumns(
        {"mean_zscore": F.lit(0.0), "keyword_hits": F.lit(0), "emotion_score": F.lit(0.0), "speech_ratio": F.lit(0.5)}
    )
    cols = ("chat_density", "chat_react", "chat_cue", "mean_zscore", "keyword_hits", "chat_kw_hits", "emotion_score", "speech_ratio")
    return f.select("vod_id", "win_id", tx.reason(**{c: c for c in cols}).alias("why"))


@query(
    "ag_frame_rms",
    """SELECT vod_id, round(frame * 8 / 16e0, 6) AS t, round(sqrt(sum(y * y) / 8), 6) AS rms FROM (
         SELECT vod_id, CAST(floor((i + 4) / 8) AS BIGINT) AS frame, y FROM (
           SELECT CAST(vec_id AS VARCHAR) AS vod_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings))
       GROUP BY vod_id, frame""",
)
def _(t):
    pcm = t.read("embeddings").select(F.col("vec_id").cast("string").alias("vod_id"), F.posexplode("embedding").alias("i", "y")).withColumn("y", F.col("y").cast("double"))
    return sg.frame_rms(pcm, 8, sample_rate=16).select("vod_id", r6("t").alias("t"), r6("rms").alias("rms"))


@query(
    "ag_voice_activity",
    f"""WITH fr AS (SELECT CAST(vec_id AS VARCHAR) AS vod_id, generate_subscripts(embedding, 1) - 1 AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS rms FROM embeddings),
       st AS (SELECT vod_id, greatest(quantile_cont(rms, 0.35), avg(rms) * 0.35e0) AS thr, max(i) AS last FROM fr GROUP BY vod_id),
       loud AS (SELECT vod_id, i, i - row_number() OVER (PARTITION BY vod_id ORDER BY i) AS g FROM fr JOIN st USING (vod_id) WHERE rms >= thr),
       runs AS (SELECT vod_id, min(i) * 0.125e0 AS s, (max(i) + 1) * 0.125e0 AS e FROM loud GROUP BY vod_id, g),
       long AS (SELECT * FROM runs WHERE e - s >= 0.25)
       SELECT vod_id, round(s, 6) AS start, round(e, 6) AS "end" FROM ({merge_sql('long', '0.125e0')})""",
)
def _(t):
    fr = t.read("embeddings").select(F.col("vec_id").cast("string").alias("vod_id"), F.posexplode("embedding").alias("i", "rms"))
    fr = fr.select("vod_id", "i", (F.col("i") * 0.125).alias("t"), F.abs(F.col("rms").cast("double")).alias("rms"))
    return sg.voice_activity(fr, frame_sec=0.125, merge_gap=0.125).select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


def roi_samples(t):
    """Two clips' worth of samples per label and vector block, from the first vector elements."""
    e = t.read("embeddings")
    v = lambda i: (F.get("embedding", i).cast("double") + 0.5)
    return e.select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("clip_id"), (F.col("vec_id") % 8).cast("double").alias("t"),
        v(0).alias("cx"), v(1).alias("cy"), (F.get("embedding", 2) > 0).alias("hit"),
    )


ROI = """roi AS (SELECT vec_id // 8 AS clip_id, CAST(vec_id % 8 AS DOUBLE) AS t, CAST(embedding[1] AS DOUBLE) + 0.5e0 AS cx,
               CAST(embedding[2] AS DOUBLE) + 0.5e0 AS cy, embedding[3] > 0 AS hit FROM embeddings)"""


@query(
    "ag_robust_roi",
    f"""WITH {ROI} SELECT clip_id, count(*) AS samples, count(*) FILTER (hit) AS hits,
          round(coalesce(least(0.85e0, greatest(0.15e0, (list_sort(list(cx) FILTER (hit)))[(count(*) FILTER (hit)) // 2 + 1])), 0.5e0), 6) AS cx,
          round(coalesce(least(0.65e0, greatest(0.12e0, (list_sort(list(cy) FILTER (hit)))[(count(*) FILTER (hit)) // 2 + 1] * 0.92e0)), 0.38e0), 6) AS cy,
          count(*) FILTER (hit) > 0 AS detected FROM roi GROUP BY clip_id""",
)
def _(t):
    return sg.robust_roi(roi_samples(t), ["clip_id"]).select("clip_id", "samples", "hits", r6("cx").alias("cx"), r6("cy").alias("cy"), "detected")


@query(
    "iv_smooth_roi",
    f"""WITH RECURSIVE {ROI},
        f AS (
          SELECT clip_id, -1e0 AS t, 0.5e0 AS hx, 0.38e0 AS hy, 0.5e0 AS tx, 0.38e0 AS ty, 0.5e0 AS x, 0.38e0 AS y FROM roi GROUP BY clip_id
          UNION ALL
          SELECT clip_id, t, hx, hy, tx2, ty2, x + 0.35e0 * (tx2 - x), y + 0.35e0 * (ty2 - y) FROM (
            SELECT *, CASE WHEN abs(hx - tx) > 0.12 OR abs(hy - ty) > 0.12 THEN hx ELSE tx END AS tx2,
                      CASE WHEN abs(hx - tx) > 0.12 OR abs(hy - ty) > 0.12 THEN hy ELSE ty END AS ty2
            FROM (SELECT f.clip_id, r.t, CASE WHEN r.hit THEN r.cx ELSE f.hx END AS hx, CASE WHEN r.hit THEN r.cy ELSE f.hy END AS hy, f.tx, f.ty, f.x, f.y
                  FROM f JOIN roi r ON r.clip_id = f.clip_id AND r.t = f.t + 1)))
        SELECT clip_id, t, round(x, 6) AS cx, round(y, 6) AS cy FROM f WHERE t >= 0""",
)
def _(t):
    s = sg.smooth_roi(roi_samples(t), ["clip_id"])
    return s.select("clip_id", "t", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query(
    "ag_mean_roi",
    f"""WITH {ROI} SELECT clip_id, round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy FROM roi GROUP BY clip_id""",
)
def _(t):
    m = sg.mean_roi(roi_samples(t), ["clip_id"])
    return m.select("clip_id", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query(
    "ag_interval_totals",
    with_("speech", body="SELECT vod_id, count(*) AS speech_count, round(sum(e - s), 3) AS speech_total_sec FROM speech GROUP BY vod_id"),
)
def _(t):
    out = sg.interval_totals(t.speech, "speech")
    return out.withColumn("speech_total_sec", F.round("speech_total_sec", 3))
