"""Registered queries: interval algebra, range joins, time lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.tables import DAY, merge_sql, with_
from clipmine.functions.spans import let
from clipmine.operators import edit as ed
from clipmine.operators import intervals as iv
from clipmine.operators import joins as jn
from clipmine.plans.voice import voice_debug, voice_intervals

r3 = lambda c: F.round(c, 3)
r6 = lambda c: F.round(c, 6)


@query("iv_merge", with_("speech", body='SELECT vod_id, round(s, 6) AS start, round(e, 6) AS "end" FROM speech'))
def _(t):
    return t.speech.select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


@query(
    "jn_window_text",
    with_(
        "seg", "clips",
        body="""SELECT clip_id, string_agg(trim(text), '' ORDER BY seg_id) AS text FROM clips c JOIN seg ON seg.vod_id = c.vod_id AND seg.e > c.s AND seg.s < c.e GROUP BY clip_id""",
    ),
)
def _(t):
    return jn.window_text(t.segments, t.clips, ids=["clip_id"]).select("clip_id", "text")


@query(
    "jn_speech_coverage",
    with_(
        "speech", "clips",
        body="""SELECT c.clip_id, round(least(1e0, sum(CASE WHEN v.s IS NULL THEN 0e0 ELSE least(c.e, v.e) - greatest(c.s, v.s) END) / (c.e - c.s)), 6) AS speech_ratio
                FROM clips c LEFT JOIN speech v ON v.vod_id = c.vod_id AND v.e > c.s AND v.s < c.e GROUP BY c.clip_id, c.s, c.e""",
    ),
)
def _(t):
    return jn.speech_coverage(t.speech, t.clips, ids=["clip_id"]).select("clip_id", r6("speech_ratio").alias("speech_ratio"))


ASR = f"asr_raw AS (SELECT vod_id, s, e FROM seg WHERE e > s), asr AS ({merge_sql('asr_raw', '0.35e0')})"
KEPT = """kept AS (SELECT v.vod_id, v.s, v.e FROM energy v WHERE EXISTS (SELECT 1 FROM asr a WHERE a.vod_id = v.vod_id AND a.e > v.s AND a.s < v.e
            AND (least(a.e, v.e) - greatest(a.s, v.s)) / (greatest(a.e, v.e) - least(a.s, v.s)) > 0.2))"""
EXT = """ext AS (SELECT a.vod_id, least(a.s, coalesce(min(k.s), a.s)) AS s, greatest(a.e, coalesce(max(k.e), a.e)) AS e
           FROM asr a LEFT JOIN kept k ON k.vod_id = a.vod_id AND k.e > a.s - 0.15e0 AND k.s < a.e + 0.15e0 GROUP BY a.vod_id, a.s, a.e)"""
MRG = "mrg AS (SELECT vod_id, s, e FROM asr UNION ALL SELECT vod_id, s, e FROM kept)"
OUT = 'SELECT vod_id, round(s, 6) AS start, round(e, 6) AS "end" FROM '


@query("jn_iou_semi", with_("seg", "energy", body=OUT + "kept", recursive=ASR + ", " + KEPT))
def _(t):
    from clipmine.operators.signals import speech_from_segments

    return jn.iou_semi_join(t.energy, speech_from_segments(t.segments)).select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


@query("flow_voice_asr", with_("seg", "energy", body=OUT + f"({merge_sql('ext', '0.35e0')})", recursive=", ".join((ASR, KEPT, EXT))))
def _(t):
    return voice_intervals(t.segments, t.energy).select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


@query("flow_voice_merged", with_("seg", "energy", body=OUT + f"({merge_sql('mrg', '0.2e0')})", recursive=", ".join((ASR, KEPT, MRG))))
def _(t):
    return voice_intervals(t.segments, t.energy, "merged").select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


@query("flow_voice_energy", with_("energy", body=OUT + "energy"))
def _(t):
    return voice_intervals(t.segments, t.energy, "energy").select("vod_id", r6("start").alias("start"), r6("end").alias("end"))


@query(
    "flow_voice_debug",
    with_(
        "seg", "energy",
        body=f"""SELECT vod_id, a.n AS asr_count, round(a.x, 3) AS asr_total_sec, coalesce(b.n, 0) AS energy_count, round(coalesce(b.x, 0e0), 3) AS energy_total_sec,
                        coalesce(c.n, 0) AS energy_kept_count, d.n AS speech_count, round(d.x, 3) AS speech_total_sec
                 FROM (SELECT vod_id, count(*) AS n, sum(e - s) AS x FROM asr GROUP BY vod_id) a
                 LEFT JOIN (SELECT vod_id, count(*) AS n, sum(e - s) AS x FROM energy GROUP BY vod_id) b USING (vod_id)
                 LEFT JOIN (SELECT vod_id, count(*) AS n FROM kept GROUP BY vod_id) c USING (vod_id)
                 LEFT JOIN (SELECT vod_id, count(*) AS n, sum(e - s) AS x FROM ({merge_sql('ext', '0.35e0')}) GROUP BY vod_id) d USING (vod_id)""",
        recursive=", ".join((ASR, KEPT, EXT)),
    ),
)
def _(t):
    d = voice_debug(t.segments, t.energy)
    return d.select(*[r3(c).alias(c) if c.endswith("_sec") else F.col(c) for c in d.columns])


ONSET = """onset AS (SELECT c.vod_id, c.clip_id, c.s, c.e, arg_min(v.s, abs(v.s - c.s) * 1e6 + v.s / 1e9) AS o
             FROM clips c LEFT JOIN speech v ON v.vod_id = c.vod_id AND v.e > c.s AND v.s < c.e AND v.s >= greatest(0e0, c.s - 8) GROUP BY ALL)"""


@query(
    "jn_nearest_onset",
    with_("clips", "speech", body="SELECT clip_id, round(CASE WHEN o IS NULL THEN s ELSE greatest(0e0, o - 0.08e0) END, 6) AS start FROM onset", recursive=ONSET),
)
def _(t):
    return jn.nearest_onset(t.speech, t.clips, ids=["clip_id"]).select("clip_id", r6("start").alias("start"))


@query(
    "jn_best_overlap",
    with_(
        "clips", "speech",
        body="""SELECT clip_id, round(a, 6) AS in_start, round(b, 6) AS in_end FROM clips LEFT JOIN (
                  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY b - a DESC, vs) AS rn FROM (
                    SELECT clip_id, v.s AS vs, greatest(c.s, v.s) AS a, least(c.e, v.e) AS b FROM clips c JOIN speech v ON v.vod_id = c.vod_id AND v.e > c.s AND v.s < c.e)
                  WHERE b - a >= 0.08) x USING (clip_id) WHERE coalesce(rn, 1) = 1""",
    ),
)
def _(t):
    return jn.best_overlap(t.speech, t.clips, ids=["clip_id"]).select("clip_id", r6("in_start").alias("in_start"), r6("in_end").alias("in_end"))


@query(
    "jn_containing_or_next",
    with_(
        "clips", "speech",
        body="""SELECT clip_id, round(a, 6) AS iv_start, round(b, 6) AS iv_end FROM clips LEFT JOIN (
                  SELECT clip_id, v.s AS a, v.e AS b, row_number() OVER (PARTITION BY clip_id ORDER BY NOT (v.s - 1e-6 <= c.s AND c.s < v.e + 1e-6), v.s) AS rn
                  FROM clips c JOIN speech v ON v.vod_id = c.vod_id AND ((v.s - 1e-6 <= c.s AND c.s < v.e + 1e-6) OR v.s >= c.s)) x USING (clip_id)
                WHERE coalesce(rn, 1) = 1""",
    ),
)
def _(t):
    p = t.clips.select("vod_id", "clip_id", F.col("start").alias("t"))
    return jn.containing_or_next(t.speech, p, ids=["clip_id"]).select("clip_id", r6("iv_start").alias("iv_start"), r6("iv_end").alias("iv_end"))


@query(
    "jn_first_peaks",
    with_(
        "clips", "emo",
        body="""SELECT clip_id, peak_id, CAST(rn AS INTEGER) AS ord FROM (SELECT clip_id, peak_id, row_number() OVER (PARTITION BY clip_id ORDER BY t, peak_id) AS rn
                FROM clips c JOIN emo ON emo.vod_id = c.vod_id AND emo.t >= c.s AND emo.t <= c.e) WHERE rn <= 8""",
    ),
)
def _(t):
    return jn.first_in_window(t.emotion.select("vod_id", "t", "peak_id"), t.clips, 8, ids=["clip_id"]).select("clip_id", "peak_id", "ord")


# --- edit plan -----------------------------------------------------------------------------------

REFINE = """hull AS (SELECT c.vod_id, c.clip_id, c.s, c.e, min(v.s) AS v0, max(v.e) AS v1
              FROM clips c LEFT JOIN speech v ON v.vod_id = c.vod_id AND v.e > c.s AND v.s < c.e GROUP BY ALL),
  ref AS (SELECT vod_id, clip_id, CASE WHEN v0 IS NULL OR least(e, v1 + 0.35e0) <= greatest(s, v0 - 0.08e0) THEN s ELSE greatest(s, v0 - 0.08e0) END AS s,
                 CASE WHEN v0 IS NULL OR least(e, v1 + 0.35e0) <= greatest(s, v0 - 0.08e0) THEN e ELSE least(e, v1 + 0.35e0) END AS e FROM hull)"""


def cuts_cte(name: str, silence: str, pad: str) -> str:
    merged = merge_sql(f"{name}_in", f"0.05e0 + 2 * {pad}", "vod_id, clip_id")
    return f"""{name}_in AS (SELECT r.vod_id, r.clip_id, greatest(r.s, v.s) AS s, least(r.e, v.e) AS e FROM ref r JOIN speech v ON v.vod_id = r.vod_id AND v.e > r.s AND v.s < r.e
                 WHERE least(r.e, v.e) - greatest(r.s, v.s) > 0.05),
      {name}_m AS (SELECT *, row_number() OVER (PARTITION BY vod_id, clip_id ORDER BY s) AS o FROM ({merged})),
      {name} AS (SELECT m.vod_id, m.clip_id, m.o, CASE WHEN m.o = 1 AND m.s - r.s < {silence} THEN r.s ELSE greatest(r.s, m.s - {pad}) END AS s, least(r.e, m.e + {pad}) AS e
                 FROM {name}_m m JOIN ref r USING (vod_id, clip_id)
                 UNION ALL SELECT vod_id, clip_id, 1, s, e FROM ref WHERE (vod_id, clip_id) NOT IN (SELECT (vod_id, clip_id) FROM {name}_m))"""


CHOOSE = (
    REFINE + ",\n" + cuts_cte("j1", "0.45e0", "0.12e0") + ",\n" + cuts_cte("j2", "0.25e0", "0.1e0")
    + """,
  cov AS (SELECT r.vod_id, r.clip_id, sum(CASE WHEN v.s IS NULL THEN 0e0 ELSE least(r.e, v.e) - greatest(r.s, v.s) END) / (r.e - r.s) AS ratio
          FROM ref r LEFT JOIN speech v ON v.vod_id = r.vod_id AND v.e > r.s AND v.s < r.e GROUP BY r.vod_id, r.clip_id, r.s, r.e),
  forced AS (SELECT vod_id, clip_id FROM cov WHERE ratio < 0.85 AND (SELECT count(*) FROM j1 WHERE j1.clip_id = cov.clip_id) = 1
               AND (SELECT count(*) FROM j2 WHERE j2.clip_id = cov.clip_id) > 1),
  chosen AS (SELECT * FROM j1 WHERE clip_id NOT IN (SELECT clip_id FROM forced) UNION ALL SELECT * FROM j2 WHERE clip_id IN (SELECT clip_id FROM forced)),
  bounds AS (SELECT vod_id, clip_id, arg_min(s, o) AS ws, arg_max(e, o) AS we FROM chosen GROUP BY ALL),
  voice AS (SELECT b.vod_id, b.clip_id, ws, we, greatest(ws, coalesce(min(greatest(ws, v.s)) - 0.08e0, ws)) AS ts, least(we, coalesce(max(least(we, v.e)) + 0.35e0, we)) AS te, min(v.s) IS NOT NULL AS voiced
            FROM bounds b LEFT JOIN speech v ON v.vod_id = b.vod_id AND v.e > ws AND v.s < we AND least(we, v.e) - greatest(ws, v.s) > 0.05 GROUP BY b.vod_id, b.clip_id, ws, we),
  cuts AS (SELECT vod_id, clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY a) AS o, a AS s, b AS e, greatest(0e0, ts - ws) AS lead_trim, greatest(0e0, we - te) AS trail_trim FROM (
             SELECT c.*, v.*, CASE WHEN voiced THEN greatest(c.s, ts) ELSE c.s END AS a, CASE WHEN voiced THEN least(c.e, te) ELSE c.e END AS b
             FROM chosen c JOIN voice v USING (vod_id, clip_id)) WHERE NOT voiced OR b - a > 0.05)"""
)


@query("iv_refine_bounds", with_("clips", "speech", body='SELECT clip_id, round(s, 6) AS start, round(e, 6) AS "end" FROM ref', recursive=REFINE))
def _(t):
    return ed.refine_bounds(t.clips, t.speech).select("clip_id", r6("start").alias("start"), r6("end").alias("end"))


@query(
    "iv_jump_cuts",
    with_("clips", "speech", body='SELECT clip_id, CAST(o AS INTEGER) AS ord, round(s, 6) AS start, round(e, 6) AS "end" FROM j1', recursive=REFINE + ",\n" + cuts_cte("j1", "0.45e0", "0.12e0")),
)
def _(t):
    c = ed.jump_cuts(ed.refine_bounds(t.clips, t.speech), t.speech)
    return c.select("clip_id", "ord", r6("start").alias("start"), r6("end").alias("end"))


@query(
    "flow_edit_cuts",
    with_(
        "clips", "speech",
        body='SELECT clip_id, CAST(o AS INTEGER) AS ord, round(s, 6) AS start, round(e, 6) AS "end", round(lead_trim, 6) AS lead_trim, round(trail_trim, 6) AS trail_trim FROM cuts',
        recursive=CHOOSE,
    ),
)
def _(t):
    c = ed.plan_cuts(t.clips, t.speech)
    return c.select("clip_id", "ord", *[r6(x).alias(x) for x in ("start", "end", "lead_trim", "trail_trim")])


@query(
    "ag_cut_statistics",
    with_(
        "clips", "speech",
        body="""SELECT vod_id, count(*) AS clip_count, round(avg(n), 3) AS avg_cuts, count(*) FILTER (n >= 2) AS multi_cut_clips
                FROM (SELECT vod_id, clip_id, count(*) AS n FROM cuts GROUP BY ALL) GROUP BY vod_id""",
        recursive=CHOOSE,
    ),
)
def _(t):
    return ed.cut_statistics(ed.plan_cuts(t.clips, t.speech))


AXIS = """off AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY clip_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS f FROM cuts)"""


@query(
    "iv_remap_points",
    with_(
        "clips", "speech", "emo",
        body="""SELECT clip_id, peak_id, round(arg_min(f + (t - s), o), 6) AS t FROM emo JOIN off ON off.vod_id = emo.vod_id AND t >= s AND t <= e GROUP BY clip_id, peak_id""",
        recursive=CHOOSE + ",\n" + AXIS,
    ),
)
def _(t):
    cuts = ed.plan_cuts(t.clips, t.speech)
    return iv.remap_points(t.emotion.select("vod_id", "peak_id", "t"), cuts, point_id=["peak_id"]).select("clip_id", "peak_id", r6("t").alias("t"))


@query(
    "iv_remap_transcript",
    with_(
        "clips", "speech", "seg",
        body="""SELECT clip_id, seg_id, CAST(o AS INTEGER) AS ord, round(greatest(x.s, off.s) - off.s + f, 6) AS start, round(least(x.e, off.e) - off.s + f, 6) AS "end", text
                FROM seg x JOIN off ON off.vod_id = x.vod_id AND x.e > off.s AND x.s < off.e WHERE least(x.e, off.e) - greatest(x.s, off.s) >= 0.05""",
        recursive=CHOOSE + ",\n" + AXIS,
    ),
)
def _(t):
    m = iv.remap_transcript(t.segments, ed.plan_cuts(t.clips, t.speech))
    return m.select("clip_id", "seg_id", "ord", r6("start").alias("start"), r6("end").alias("end"), "text")


@query(
    "iv_remap_speech",
    with_(
        "clips", "speech",
        body='SELECT clip_id, round(s, 6) AS start, round(e, 6) AS "end" FROM ('
        + merge_sql("rs", "0.08e0", "vod_id, clip_id") + ")",
        recursive=CHOOSE + ",\n" + AXIS + """, rs AS (SELECT off.vod_id, clip_id, greatest(x.s, off.s) - off.s + f AS s, least(x.e, off.e) - off.s + f AS e
            FROM speech x JOIN off ON off.vod_id = x.vod_id AND x.e > off.s AND x.s < off.e WHERE least(x.e, off.e) - greatest(x.s, off.s) >= 0.05)""",
    ),
)
def _(t):
    m = iv.remap_speech(t.speech, ed.plan_cuts(t.clips, t.speech))
    return m.select("clip_id", r6("start").alias("start"), r6("end").alias("end"))


@query(
    "iv_slice_transcript",
    with_(
        "clips", "seg",
        body="""SELECT clip_id, seg_id, round(greatest(x.s, c.s) - c.s, 6) AS start, round(least(x.e, c.e) - c.s, 6) AS "end" FROM seg x JOIN clips c ON c.vod_id = x.vod_id AND x.e > c.s AND x.s < c.e""",
    ),
)
def _(t):
    m = iv.slice_transcript(t.segments, t.clips, ids=["clip_id"])
    return m.select("clip_id", "seg_id", r6("start").alias("start"), r6("end").alias("end"))


KEEP = """ax AS (SELECT vod_id, clip_id, o, round_even(s, 3) AS v0, round_even(e, 3) AS v1, round_even(f, 3) AS s0, round_even(f + (e - s), 3) AS s1, lead(o) OVER (PARTITION BY clip_id ORDER BY o) IS NULL AS last FROM (
             SELECT *, coalesce(sum(e - s) OVER (PARTITION BY clip_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS f FROM cuts WHERE e - s >= 0.05))"""


def axis(t):
    return iv.keep_axis(ed.plan_cuts(t.clips, t.speech))


@query(
    "iv_keep_axis",
    with_(
        "clips", "speech",
        body="SELECT clip_id, CAST(o AS INTEGER) AS ord, v0 AS vod_start, v1 AS vod_end, s0 AS short_start, s1 AS short_end, last AS is_last FROM ax",
        recursive=CHOOSE + ",\n" + KEEP,
    ),
)
def _(t):
    return axis(t).drop("vod_id")


@query(
    "iv_to_short_to_vod",
    with_(
        "clips", "speech", "seg",
        body="""SELECT clip_id, seg_id, short_t, (SELECT arg_min(round_even(v0 + (short_t - s0), 3), o) FROM ax WHERE ax.clip_id = p.clip_id AND s0 - 1e-6 <= short_t AND CASE WHEN last THEN short_t <= s1 + 1e-6 ELSE short_t < s1 - 1e-9 END) AS back
                FROM (SELECT c.clip_id, x.seg_id, (SELECT arg_min(round_even(s0 + (x.s - v0), 3), o) FROM ax WHERE ax.clip_id = c.clip_id AND v0 - 1e-6 <= x.s AND CASE WHEN last THEN x.s <= v1 + 1e-6 ELSE x.s < v1 - 1e-9 END) AS short_t
                      FROM clips c JOIN seg x ON x.vod_id = c.vod_id AND x.s >= c.s AND x.s < c.e) p""",
        recursive=CHOOSE + ",\n" + KEEP,
    ),
)
def _(t):
    p = jn.points_in_windows(t.segments.select("vod_id", "seg_id", F.col("start").alias("t")), iv.with_axis(t.clips, axis(t)))
    p = p.select("vod_id", F.col("w_clip_id").alias("clip_id"), "seg_id", "t", F.col("w__axis").alias("_axis"))
    p = p.withColumn("short_t", iv.short_time(F.col("t"), F.col("_axis")))
    return p.select("clip_id", "seg_id", "short_t", iv.vod_time(F.col("short_t"), F.col("_axis")).alias("back"))


# --- draft windows -------------------------------------------------------------------------------


def trims(t):
    """Clips with pads and cuts derived from their neighbours in the event stream."""
    c = t.clips.select(
        "vod_id", "clip_id", "start", "end", F.lit(86400.0).alias("duration_sec"),
        (F.col("clip_id") % 90).cast("double").alias("pad_before"), (F.col("clip_id") % 70).cast("double").alias("pad_after"),
        F.when(F.col("clip_id") % 2 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0))).alias("play_order"),
    )
    w = iv.padded_window(c)
    errors = t.events.where(F.col("message") == "error").select("vod_id", "seq", F.col("t").alias("start"), (F.col("t") + F.col("value") / 10.0).alias("end"), "value")
    near = jn.near_spans(w.drop("start", "end").withColumnsRenamed({"win_start": "start", "win_end": "end"}), errors, order=["seq"])
    at = lambda x: x["start"] - F.col("start")
    cuts = F.transform(F.filter("_near", lambda x: x["start"] >= F.col("start")), lambda x: F.struct(at(x).alias("start"), (at(x) + x["value"] / 10.0).alias("end")))
    return c, near.withColumn("_cuts", cuts).drop("_near")


def pieces(w):
    """What the cuts leave of each padded window: cuts come as an array of the window, so no pair of both is shuffled."""
    return w.withColumn("_pieces", let(iv.clamped_spans(F.col("_cuts"), F.col("dur")), lambda m: iv.remaining(m, F.col("dur"))))


TRIM = """pw AS (SELECT vod_id, clip_id, s, e, least(60, clip_id % 90, s) AS pb, least(60, clip_id % 70, greatest(0e0, 86400 - e)) AS pa FROM clips),
  wn AS (SELECT *, s - pb AS ws, e + pa AS we, e + pa - (s - pb) AS dur FROM pw),
  rawcut AS (SELECT wn.vod_id, clip_id, round_even(least(greatest(0e0, t - ws), dur), 3) AS s, round_even(least(greatest(0e0, t - ws + value / 10e0), dur), 3) AS e
             FROM wn JOIN ev ON ev.vod_id = wn.vod_id AND message = 'error' AND t >= ws AND t < we WHERE least(t - ws + value / 10e0, dur) - (t - ws) >= 0.05),
  mcut AS (""" + merge_sql("rawcut", "0", "vod_id, clip_id") + """),
  piece AS (SELECT vod_id, clip_id, s, e FROM (
     SELECT clip_id, wn.vod_id, coalesce(lag(m.e) OVER (PARTITION BY clip_id ORDER BY m.s), 0e0) AS s, m.s AS e FROM mcut m JOIN wn USING (vod_id, clip_id)
     UNION ALL SELECT clip_id, wn.vod_id, max(m.e), any_value(dur) FROM mcut m JOIN wn USING (vod_id, clip_id) GROUP BY ALL
     UNION ALL SELECT clip_id, vod_id, 0e0, dur FROM wn WHERE clip_id NOT IN (SELECT clip_id FROM mcut)) WHERE e - s >= 0.05),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM piece)"""


@query(
    "iv_padded_window",
    with_("clips", body="SELECT clip_id, round(s - pb, 6) AS win_start, round(e + pa, 6) AS win_end, round(dur, 6) AS dur FROM wn", recursive=TRIM.split(",\n  rawcut")[0]),
)
def _(t):
    c, _cuts = trims(t)
    return iv.padded_window(c).select("clip_id", r6("win_start").alias("win_start"), r6("win_end").alias("win_end"), r6("dur").alias("dur"))


@query(
    "iv_complement",
    with_("clips", "ev", body='SELECT clip_id, round(s, 6) AS start, round(e, 6) AS "end" FROM piece', recursive=TRIM),
)
def _(t):
    p = pieces(trims(t)[1]).select("clip_id", F.explode_outer("_pieces").alias("p")).where(F.col("p").isNotNull())
    return p.select("clip_id", r6("p.start").alias("start"), r6("p.end").alias("end"))


@query(
    "iv_play_order",
    with_(
        "clips", "ev",
        body="SELECT clip_id, CAST(i AS INTEGER) AS piece, CAST(CASE WHEN n = 2 AND clip_id % 2 = 0 THEN 1 - i ELSE i END AS INTEGER) AS ord FROM numbered",
        recursive=TRIM,
    ),
)
def _(t):
    p = pieces(trims(t)[1]).select("clip_id", "play_order", F.size("_pieces").alias("n"), F.posexplode_outer("_pieces").alias("piece", "p")).where(F.col("p").isNotNull())
    return p.select("clip_id", "piece", iv.place_of(F.col("piece"), F.col("n"), F.col("play_order")).alias("ord"))


# --- suggested bounds ----------------------------------------------------------------------------

SUGGEST = """sp AS (SELECT c.vod_id, c.clip_id, c.s, c.e, max(CASE WHEN message IN ('purchase', 'error', 'signup') THEN t END) AS peak
           FROM clips c LEFT JOIN ev ON ev.vod_id = c.vod_id AND ev.t >= c.s AND ev.t < c.e GROUP BY ALL),
  vv AS (SELECT sp.clip_id, sp.s, sp.e, v.s AS vs, v.e AS ve, lead(v.s) OVER (PARTITION BY clip_id ORDER BY v.s, v.e) AS nx FROM sp JOIN speech v ON v.vod_id = sp.vod_id AND v.e > sp.s AND v.s < sp.e),
  env AS (SELECT clip_id, min(vs) AS v0, max(ve) AS v1, max(CASE WHEN nx - ve >= 4 AND nx <= s + (e - s) * 0.5e0 THEN nx - 0.08e0 END) AS pz FROM vv GROUP BY clip_id),
  b1 AS (SELECT sp.*, CASE WHEN v0 IS NULL THEN s ELSE greatest(s, v0 - 0.08e0, coalesce(pz, s)) END AS s1, CASE WHEN v0 IS NULL THEN e ELSE least(e, v1 + 0.15e0) END AS e1 FROM sp LEFT JOIN env USING (clip_id)),
  b2 AS (SELECT b1.*, max(x.e) AS lst FROM b1 LEFT JOIN seg x ON x.vod_id = b1.vod_id AND x.text LIKE '%!' AND x.e > b1.s AND x.e <= b1.e AND x.e <= e1 + 0.5e0 GROUP BY ALL),
  b3 AS (SELECT * REPLACE (CASE WHEN peak IS NULL THEN e2 ELSE greatest(e2, least(e, peak + 2)) END AS e2), greatest(s, peak - 30) AS cc FROM (SELECT *, CASE WHEN lst IS NULL THEN e1 ELSE greatest(s1 + 5, lst) END AS e2 FROM b2)),
  b4 AS (SELECT b3.*, arg_min(v.s, abs(v.s - cc) * 1e6 + v.s / 1e9) AS o FROM b3 LEFT JOIN speech v ON v.vod_id = b3.vod_id AND v.e > cc AND v.s < e2 AND v.s >= greatest(0e0, cc - 6) GROUP BY ALL),
  b5 AS (SELECT *, CASE WHEN o IS NOT NULL AND e2 > cc THEN greatest(0e0, o - 0.08e0) ELSE cc END AS sn FROM b4),
  b6 AS (SELECT *, CASE WHEN peak IS NOT NULL AND s <= sn AND sn <= e2 - 5 THEN greatest(s, sn) ELSE s1 END AS s3 FROM b5),
  sug AS (SELECT vod_id, clip_id, CASE WHEN e2 <= s3 + 1 THEN s ELSE s3 END AS a, CASE WHEN e2 <= s3 + 1 THEN e ELSE e2 END AS b FROM b6)"""


def suggested(t):
    react = t.chat.where(F.col("message").isin("purchase", "error", "signup")).select("vod_id", "t")
    peak = jn.points_in_windows(react, t.clips).groupBy("vod_id", F.col("w_clip_id").alias("clip_id")).agg(F.max("t").alias("reaction_peak_t"))
    spans = t.clips.join(peak, ["vod_id", "clip_id"], "left")
    return ed.suggested_bounds(spans, t.speech, t.segments, ids=["clip_id"], ends=DAY.sentence_ends, lag=30.0)


@query(
    "iv_suggested_bounds",
    with_("clips", "speech", "seg", "ev", body="SELECT clip_id, round(a, 6) AS suggested_start, round(b, 6) AS suggested_end FROM sug", recursive=SUGGEST),
)
def _(t):
    return suggested(t).select("clip_id", r6("suggested_start").alias("suggested_start"), r6("suggested_end").alias("suggested_end"))


@query(
    "iv_clamp_sentence",
    with_(
        "clips", "seg",
        body="""SELECT clip_id, round(CASE WHEN c.e - c.s <= 100 THEN c.e ELSE coalesce(max(x.e), c.s + 100) END, 6) AS "end"
                FROM clips c LEFT JOIN seg x ON x.vod_id = c.vod_id AND x.text LIKE '%!' AND x.e > c.s AND x.e - c.s <= 100 + 1e-6 GROUP BY c.clip_id, c.s, c.e""",
    ),
)
def _(t):
    return ed.clamp_to_sentence(t.clips, t.segments, ids=["clip_id"], max_sec=100.0, ends=DAY.sentence_ends).select("clip_id", r6("end").alias("end"))
