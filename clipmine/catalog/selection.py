"""Registered queries: ranking, Top-N, greedy selection, chapters, mining, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.signals import scored
from clipmine.catalog.tables import with_
from clipmine.functions import text as tx
from clipmine.operators import arcs as ar
from clipmine.operators import chapters as ch
from clipmine.operators import features as ft
from clipmine.operators import mining as mi
from clipmine.operators import select as sel
from clipmine.operators.joins import chapter_of, window_text

r6 = lambda c: F.round(c, 6)


def ranked(t):
    """Scored windows with id and hour rank; scores at nine decimals so that ties are ties."""
    s = ft.rank_in_hour(scored(t)).withColumn("score", F.round("score", 9)).withColumn("rank_score", F.round("rank_score", 9))
    return sel.number_by_score(s, order="win_id")


def slim(t):
    return ranked(t).select("vod_id", "win_id", "start", "end", "score", "rank_score", "candidate_id", "hour_bucket")


@query("tk_number_by_score", with_("ranked", body="SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, CAST(candidate_id AS INTEGER) AS candidate_id FROM ranked"))
def _(t):
    return ranked(t).select("vod_id", "win_id", "candidate_id")


@query(
    "tk_best_per_seed",
    with_("slide", body="""SELECT vod_id, CAST(h AS BIGINT) AS seed, CAST(i AS BIGINT) AS wlen, round(score, 6) AS score FROM (
              SELECT *, row_number() OVER (PARTITION BY vod_id, h ORDER BY round(score, 9) DESC, i DESC) AS rn FROM slide) WHERE rn = 1"""),
)
def _(t):
    s = ranked(t).select("vod_id", F.floor(F.col("win_id") / 1000).alias("seed"), (F.col("win_id") % 1000).alias("wlen"), "score")
    return sel.best_per_seed(s).select("vod_id", "seed", "wlen", r6("score").alias("score"))


@query(
    "tk_top_n",
    with_("slide", body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, CAST(rn AS INTEGER) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY round(score, 9) DESC, s) AS rn FROM slide) WHERE rn <= 7"""),
)
def _(t):
    return sel.top_n(ranked(t), 7).select("vod_id", "win_id", "rank")


DIVERSE = """rk AS (SELECT vod_id, win_id, s, e, round(rank_score, 9) AS v, row_number() OVER (PARTITION BY vod_id ORDER BY round(rank_score, 9) DESC, s, candidate_id) AS k FROM ranked),
  dv AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(w BIGINT, s DOUBLE, e DOUBLE, v DOUBLE)[]) AS c FROM vods
    UNION ALL
    SELECT dv.vod_id, rk.k, CASE WHEN len(list_filter(c, lambda x: ((rk.s < x.e AND x.s < rk.e) OR abs((rk.s + rk.e) / 2 - (x.s + x.e) / 2) < 900) AND rk.v < x.v * 1.35e0)) = 0
           THEN list_append(c, {'w': CAST(rk.win_id AS BIGINT), 's': rk.s, 'e': rk.e, 'v': rk.v}) ELSE c END
    FROM dv JOIN rk ON rk.vod_id = dv.vod_id AND rk.k = dv.k + 1 WHERE len(c) < 10),
  top AS (SELECT vod_id, unnest(c).w AS win_id, generate_subscripts(c, 1) AS rank FROM (SELECT vod_id, arg_max(c, k) AS c FROM dv GROUP BY vod_id))"""


@query("tk_top_n_diverse", with_("ranked", body="SELECT vod_id, win_id, CAST(rank AS INTEGER) AS rank FROM top", recursive=DIVERSE))
def _(t):
    return sel.top_n_diverse(slim(t), 10, min_gap=900.0).select("vod_id", "win_id", "rank")


@query(
    "tk_non_overlapping",
    with_(
        "slide",
        body="SELECT vod_id, unnest(c).w AS win_id FROM (SELECT vod_id, arg_max(c, k) AS c FROM dv GROUP BY vod_id)",
        recursive="""rk AS (SELECT vod_id, win_id, s, e, row_number() OVER (PARTITION BY vod_id ORDER BY round(score, 9) DESC, s) AS k FROM slide),
  dv AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(w BIGINT, s DOUBLE, e DOUBLE)[]) AS c FROM vods
    UNION ALL SELECT dv.vod_id, rk.k, CASE WHEN len(list_filter(c, lambda x: rk.s < x.e AND x.s < rk.e)) = 0 THEN list_append(c, {'w': CAST(rk.win_id AS BIGINT), 's': rk.s, 'e': rk.e}) ELSE c END
    FROM dv JOIN rk ON rk.vod_id = dv.vod_id AND rk.k = dv.k + 1)""",
    ),
)
def _(t):
    return sel.pick_non_overlapping(slim(t), tie="win_id").select("vod_id", "win_id")


@query(
    "tk_suggest_actions",
    with_(
        "ranked",
        body="""SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, CASE WHEN ok AND row_number() OVER (PARTITION BY vod_id, hour_bucket, ok ORDER BY candidate_id) <= 4 THEN 'keep' ELSE 'reject' END AS action
                FROM (SELECT *, win_id % 5 <> 0 AND win_id % 7 <> 0 AND (cue > 0 OR round(laugh + 0.7e0 * confused, 9) > 0.08 OR round(rank_score, 9) >= 2.0) AS ok FROM ranked)""",
    ),
)
def _(t):
    q = ranked(t).withColumns(
        {"is_intro": F.col("win_id") % 5 == 0, "is_outro": F.col("win_id") % 7 == 0, "chat_react": F.round(F.col("laugh") + 0.7 * F.col("confused"), 9)}
    )
    return sel.suggest_actions(q, 4, order="candidate_id").select("vod_id", "win_id", "action")


def pool(t):
    top = sel.top_n_diverse(slim(t), 10, min_gap=900.0)
    return sel.candidate_pool(slim(t), top)


@query(
    "jn_candidate_pool",
    with_(
        "ranked",
        body="""SELECT vod_id, win_id, CAST(rank AS INTEGER) AS candidate_id FROM top
                UNION ALL SELECT vod_id, CAST(win_id AS BIGINT), CAST(10 + row_number() OVER (PARTITION BY vod_id ORDER BY candidate_id) AS INTEGER)
                FROM ranked WHERE (vod_id, win_id) NOT IN (SELECT (vod_id, win_id) FROM top)""",
        recursive=DIVERSE,
    ),
)
def _(t):
    return pool(t).select("vod_id", "win_id", "candidate_id")


@query(
    "flow_decisions",
    with_(
        "ranked",
        body="""SELECT vod_id, CAST(row_number() OVER (PARTITION BY vod_id ORDER BY x.s) AS INTEGER) AS id, CAST(x.cid AS INTEGER) AS candidate_id, x.s AS start, x.e AS "end"
                FROM (SELECT vod_id, unnest(c) AS x FROM (SELECT vod_id, arg_max(c, k) AS c FROM ap GROUP BY vod_id))""",
        recursive="""kd AS (SELECT vod_id, candidate_id AS cid, round(score, 9) AS v, CASE WHEN candidate_id % 4 = 0 THEN s + 5 ELSE s + 1 END AS s, e - 1 AS e FROM ranked WHERE candidate_id % 2 = 0),
  rk AS (SELECT *, CAST(floor(s / 3600) AS BIGINT) AS hr, row_number() OVER (PARTITION BY vod_id ORDER BY v DESC, cid) AS k FROM kd),
  ap AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(cid BIGINT, hr BIGINT, s DOUBLE, e DOUBLE)[]) AS c FROM vods
    UNION ALL SELECT ap.vod_id, rk.k, CASE WHEN len(list_filter(c, lambda x: x.hr = rk.hr)) < 3 AND len(list_filter(c, lambda x: x.s < rk.e AND rk.s < x.e)) = 0
        THEN list_append(c, {'cid': CAST(rk.cid AS BIGINT), 'hr': rk.hr, 's': rk.s, 'e': rk.e}) ELSE c END
    FROM ap JOIN rk ON rk.vod_id = ap.vod_id AND rk.k = ap.k + 1)""",
    ),
)
def _(t):
    p = slim(t).withColumns(
        {
            "suggested_start": F.col("start") + 1.0, "suggested_end": F.col("end") - 1.0, "title": F.lit("x"), "reason": F.lit("y"),
            "suggested_hook": F.lit("z"), "speech_ratio": F.lit(0.5),
        }
    )
    d = p.select(
        "vod_id", "candidate_id", F.col("candidate_id").alias("ord"), F.when(F.col("candidate_id") % 2 == 0, "keep").otherwise("reject").alias("action"),
        F.when(F.col("candidate_id") % 4 == 0, F.col("start") + 5.0).alias("start"), F.lit(None).cast("double").alias("end"),
        F.lit(None).cast("string").alias("title"), F.lit("").alias("hook"),
    )
    h = sel.highlights_from_decisions(d, p, 3)
    return h.select("vod_id", "id", F.get("merged_from", F.lit(0)).alias("candidate_id"), "start", "end")


@query(
    "jn_chapter_lookup",
    with_("win", body="SELECT vod_id, CAST(win_id AS BIGINT) AS win_id, CAST(least(144, floor((s + 300) / 600) + 1) AS INTEGER) AS chapter_id FROM win"),
)
def _(t):
    from clipmine.catalog.signals import windows

    c = ch.fixed_chapters(t.vods, chapter_sec=600.0)
    w = windows(t).withColumn("at", F.col("start") + 300.0)
    return chapter_of(w, c, t="at", ids=["win_id"]).select("vod_id", "win_id", "chapter_id")


@query(
    "iv_fixed_chapters",
    with_("vods", body='SELECT vod_id, CAST(i + 1 AS INTEGER) AS id, i * 700e0 AS start, least(86400e0, (i + 1) * 700e0) AS "end" FROM vods, (SELECT unnest(range(124)) AS i)'),
)
def _(t):
    return ch.fixed_chapters(t.vods, chapter_sec=700.0)


BLOCKS = r"""b AS (SELECT vod_id, unnest(range(CAST(ceil(d / 30) AS BIGINT))) AS blk, d FROM (SELECT CAST(doc_id AS VARCHAR) AS vod_id, len(string_split(text, chr(10))) * 10e0 AS d FROM documents)),
  bt AS (SELECT b.vod_id, blk, string_agg(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'), '' ORDER BY seg_id) AS x FROM b JOIN doclines l ON l.vod_id = b.vod_id AND l.e > blk * 30 AND l.s < least(d, (blk + 1) * 30) GROUP BY ALL),
  g AS (SELECT vod_id, blk, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS g FROM bt WHERE length(x) >= 2),
  st AS (SELECT *, lag(g) OVER (PARTITION BY vod_id ORDER BY blk) AS pg FROM g),
  cut AS (SELECT vod_id, blk FROM st WHERE pg IS NOT NULL AND len(list_intersect(g, pg)) / (len(g) + len(pg) - len(list_intersect(g, pg))) < 0.12),
  part AS (SELECT b.vod_id, b.blk, d, CASE WHEN d <= 60 THEN 0 ELSE sum(CASE WHEN cut.blk IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.vod_id ORDER BY b.blk ROWS UNBOUNDED PRECEDING) END AS p FROM b LEFT JOIN cut ON cut.vod_id = b.vod_id AND cut.blk = b.blk),
  isl AS (SELECT vod_id, p, min(blk) * 30e0 AS s, least(any_value(d), (max(blk) + 1) * 30e0) AS e, any_value(d) AS d FROM part GROUP BY vod_id, p),
  chap AS (SELECT vod_id, row_number() OVER (PARTITION BY vod_id ORDER BY s) AS id, s, e FROM (
     SELECT vod_id, s + i * 150 AS s, least(e, s + (i + 1) * 150) AS e FROM (SELECT *, unnest(range(CASE WHEN d <= 60 THEN 1 ELSE greatest(1, CAST(ceil((e - s - 1e-6) / 150) AS BIGINT)) END)) AS i FROM isl)))"""


def topic(t):
    return ch.topic_chapters(t.lines, t.line_vods, block_sec=30.0, min_sec=60.0, max_sec=150.0, char_class=r"\p{L}\p{N}")


@query("flow_topic_chapters", with_("doclines", body='SELECT vod_id, CAST(id AS INTEGER) AS id, s AS start, e AS "end" FROM chap', recursive=BLOCKS))
def _(t):
    return topic(t)


@query(
    "flow_chapter_titles",
    with_(
        "doclines",
        body=r"""SELECT vod_id, CAST(id AS INTEGER) AS id, CASE WHEN hd = '' THEN printf('%02d', CAST(floor(s / 60) AS INTEGER)) || ':00 段落' WHEN n >= 2 AND length(x) >= 4 THEN left(gram || hd, 16) ELSE left(hd, 16) END AS title
                 FROM tt LEFT JOIN (SELECT vod_id, id, gram, n FROM (SELECT vod_id, id, gram, count(*) AS n, row_number() OVER (PARTITION BY vod_id, id ORDER BY count(*) DESC, min(i)) AS rn FROM (
                   SELECT vod_id, id, unnest(range(1, length(x))) AS i, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS gram FROM tt WHERE length(x) >= 2) GROUP BY vod_id, id, gram) WHERE rn = 1) USING (vod_id, id)""",
        recursive=BLOCKS + r""", tt AS (SELECT c.vod_id, c.id, c.s, coalesce(string_agg(regexp_replace(text, '\s+', '', 'g'), '' ORDER BY seg_id), '') AS hd,
             coalesce(string_agg(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'), '' ORDER BY seg_id), '') AS x FROM chap c LEFT JOIN doclines l ON l.vod_id = c.vod_id AND l.e > c.s AND l.s < c.e GROUP BY c.vod_id, c.id, c.s)""",
    ),
)
def _(t):
    return ch.chapter_titles(t.lines, topic(t), char_class=r"\p{L}\p{N}").select("vod_id", "id", "title")


def placed(t):
    """Windows with text, chapter and the columns arc growth needs."""
    r = ranked(t)
    text = window_text(t.segments, r.select("vod_id", "win_id", "start", "end"), ids=["win_id"])
    return r.join(text, ["vod_id", "win_id"], "left").select(
        "vod_id", "hour_bucket", "candidate_id", "win_id", "start", "end", "score", tx.title("text").alias("title"), F.lit("r").alias("reason"),
        tx.excerpt("text").alias("transcript_excerpt"), tx.bigrams("text").alias("transcript_bigrams"), F.col("chat_kw_hits").alias("keyword_hits"), (F.floor(F.col("start") / 1200).cast("int") + 1).alias("chapter_id"),
        (F.col("win_id") % 10 / 10.0).alias("speech_ratio"), (F.col("win_id") % 9 == 0).alias("is_intro"), (F.col("win_id") % 11 == 0).alias("is_outro"),
    )


WINDOW_TEXTS = r"""w0 AS (SELECT r.vod_id, r.hour_bucket, r.candidate_id, r.s, r.e, CAST(floor(r.s / 1200) AS INTEGER) + 1 AS ch, r.kw, coalesce(string_agg(text, '' ORDER BY seg_id), '') AS x
    FROM ranked r LEFT JOIN seg ON seg.vod_id = r.vod_id AND seg.e > r.s AND seg.s < r.e GROUP BY ALL),
  w1 AS (SELECT *, CASE WHEN x = '' THEN '精華片段' ELSE left(regexp_replace(x, '\s+', '', 'g'), 20) END AS ti FROM w0),
  wt AS (SELECT *, list_distinct(list_transform(range(1, length(ti)), lambda i: substr(ti, i, 2))) AS g1,
            list_distinct(list_transform(range(1, length(CASE WHEN x = '' THEN ti ELSE x END)), lambda i: substr(CASE WHEN x = '' THEN ti ELSE x END, i, 2))) AS g2 FROM w1)"""


@query(
    "tk_continuity",
    with_(
        "ranked", "seg",
        body=r"""SELECT vod_id, CAST(a.candidate_id AS INTEGER) AS seed_id, CAST(b.candidate_id AS INTEGER) AS other_id, round(CASE
                   WHEN abs(a.ch - b.ch) > 1 THEN 0e0 WHEN abs(a.ch - b.ch) = 1 AND topic < 0.18 THEN 0e0 WHEN a.ch = b.ch AND topic < 0.12 THEN 0e0
                   ELSE CASE WHEN a.ch = b.ch THEN 1e0 ELSE 0.55e0 END * 0.45e0 + topic * 0.35e0 + least(1e0, (a.kw + b.kw) / 4e0) * 0.1e0 + (1 - gap / 120e0) * 0.1e0 END, 6) AS continuity
                 FROM (SELECT *, greatest(CASE WHEN len(a.g1) = 0 OR len(b.g1) = 0 THEN 0e0 ELSE len(list_intersect(a.g1, b.g1)) / (len(a.g1) + len(b.g1) - len(list_intersect(a.g1, b.g1))) END,
                              CASE WHEN len(a.g2) = 0 OR len(b.g2) = 0 THEN 0e0 ELSE len(list_intersect(a.g2, b.g2)) / (len(a.g2) + len(b.g2) - len(list_intersect(a.g2, b.g2))) END) AS topic
                       FROM (SELECT a.vod_id, a, b, greatest(0e0, b.s - a.e, a.s - b.e) AS gap FROM wt a JOIN wt b ON a.vod_id = b.vod_id AND a.hour_bucket = b.hour_bucket AND a.candidate_id <> b.candidate_id
                             WHERE greatest(0e0, b.s - a.e, a.s - b.e) <= 120))""",
        recursive=WINDOW_TEXTS,
    ),
)
def _(t):
    c = ar.continuity(placed(t), gap_max=120.0)
    return c.select("vod_id", "seed_id", "other_id", r6("continuity").alias("continuity"))


LINK = """CASE WHEN {gap} > 120 OR abs({step}) > 1 THEN 0e0 WHEN abs({step}) = 1 AND topic < 0.18 THEN 0e0 WHEN {step} = 0 AND topic < 0.12 THEN 0e0
    ELSE CASE WHEN {step} = 0 THEN 1e0 ELSE 0.55e0 END * 0.45e0 + topic * 0.35e0 + least(1e0, kw / 4e0) * 0.1e0 + (1 - {gap} / 120e0) * 0.1e0 END >= 0.4"""
SAME = "CASE WHEN len(a.{g}) = 0 OR len(b.{g}) = 0 THEN 0e0 ELSE len(list_intersect(a.{g}, b.{g})) / (len(a.{g}) + len(b.{g}) - len(list_intersect(a.{g}, b.{g}))) END"
#: A row of `gw` is a seed after `k` looks at the candidates in its reach, best first, over and over until a round adds nothing.
ARCS = rf"""{WINDOW_TEXTS},
  q0 AS (SELECT wt.*, win_id % 10 / 10e0 AS sr, win_id % 9 <> 0 AND win_id % 11 <> 0 AS plain, score FROM wt JOIN ranked USING (vod_id, candidate_id)),
  q1 AS (SELECT * FROM (SELECT *, bool_or(plain) OVER (PARTITION BY vod_id, hour_bucket) AS found FROM q0) WHERE plain OR NOT found),
  q2 AS (SELECT vod_id, hour_bucket AS h, candidate_id AS id, s, e, ch, kw, ti, sr, score, g1, g2 FROM (SELECT *, bool_or(sr >= 0.3) OVER (PARTITION BY vod_id, hour_bucket) AS voiced FROM q1) WHERE sr >= 0.3 OR NOT voiced),
  nr AS (SELECT a.vod_id, a.id, b.id AS oid, b.s AS os, b.e AS oe, b.ch AS och, a.kw + b.kw AS kw, greatest(0e0, b.s - a.e, a.s - b.e) AS gap, b.ch - a.ch AS step, greatest({SAME.format(g='g1')}, {SAME.format(g='g2')}) AS topic
      FROM q2 a JOIN q2 b ON b.vod_id = a.vod_id AND b.h = a.h AND b.id <> a.id WHERE greatest(a.e, b.e) - least(a.s, b.s) <= 1500 + 1e-6),
  lk AS (SELECT vod_id, oid, list(id) AS links FROM nr WHERE {LINK.format(gap='gap', step='step')} GROUP BY vod_id, oid),
  rr AS (SELECT nr.*, row_number() OVER (PARTITION BY nr.vod_id, nr.id ORDER BY nr.oid) AS i, count(*) OVER (PARTITION BY nr.vod_id, nr.id) AS n, coalesce(links, []) AS links FROM nr LEFT JOIN lk ON lk.vod_id = nr.vod_id AND lk.oid = nr.oid),
  gw AS (SELECT vod_id, id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS i, s, e, ch, [id] AS mem, false AS grew FROM q2
    UNION ALL SELECT vod_id, id, k + 1, CASE WHEN i < n THEN i + 1 WHEN ok OR grew THEN 1 ELSE n + 1 END, CASE WHEN ok THEN least(s, os) ELSE s END, CASE WHEN ok THEN greatest(e, oe) ELSE e END,
      CASE WHEN ok AND os < s THEN och ELSE ch END, CASE WHEN ok THEN list_append(mem, oid) ELSE mem END, CASE WHEN i < n THEN ok OR grew ELSE false END FROM (
        SELECT *, NOT list_contains(mem, oid) AND greatest(e, oe) - least(s, os) <= 1500 + 1e-6 AND ag <= 120 AND ({LINK.format(gap='ag', step='(och - ch)')} OR len(list_intersect(links, mem)) > 0) AS ok FROM (
          SELECT gw.*, rr.* EXCLUDE (vod_id, id, i), greatest(0e0, os - gw.e, gw.s - oe) AS ag FROM gw JOIN rr ON rr.vod_id = gw.vod_id AND rr.id = gw.id AND rr.i = gw.i))),
  ge AS (SELECT vod_id, id, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(mem, k) AS mem FROM gw GROUP BY vod_id, id),
  ac AS (SELECT vod_id, id, h, ti, mem, a, least(CASE WHEN e - s < 300 THEN a + 300 ELSE e END, a + 1500) AS b, row_number() OVER (PARTITION BY vod_id, h ORDER BY id) AS r FROM (
      SELECT ge.*, h, ti, CASE WHEN ge.e - ge.s < 300 THEN greatest(0e0, (ge.s + ge.e) / 2 - 150) ELSE ge.s END AS a FROM ge JOIN q2 USING (vod_id, id))),
  pk AS (SELECT vod_id, h, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, id BIGINT)[]) AS c FROM ac GROUP BY vod_id, h
    UNION ALL SELECT ac.vod_id, ac.h, ac.r, CASE WHEN len(c) < 2 AND len(list_filter(c, lambda x: ac.a < x.b AND x.a < ac.b)) = 0 THEN list_append(c, {{'a': ac.a, 'b': ac.b, 'id': ac.id}}) ELSE c END
    FROM pk JOIN ac ON ac.vod_id = pk.vod_id AND ac.h = pk.h AND ac.r = pk.r + 1),
  arc AS (SELECT ac.vod_id, ac.a AS s, ac.b AS e, ac.ti, mem, max(m.score) AS score FROM (SELECT vod_id, h, unnest(arg_max(c, r)).id AS id FROM pk GROUP BY vod_id, h) x JOIN ac USING (vod_id, h, id) JOIN q2 m ON m.vod_id = ac.vod_id AND list_contains(mem, m.id) GROUP BY ALL)"""


@query("tk_story_arcs", with_("ranked", "seg", body='SELECT vod_id, s AS start, e AS "end", round(score, 6) AS score, ti AS title, CAST(len(mem) AS INTEGER) AS members FROM arc', recursive=ARCS))
def _(t):
    arcs = ar.story_arcs(placed(t), speech_min=0.3, story_min=300.0, story_max=1500.0, gap_max=120.0, per_hour=2, continuity_min=0.4)
    return arcs.select("vod_id", "start", "end", r6("score").alias("score"), "title", F.size("merged_from").alias("members"))


PATTERNS = {"the": "(?i)the", "que": "(?i)que", "ends": r"[.!?]$", "double": "(ll|tt|ss)"}
PSQL = " UNION ALL ".join(
    f"SELECT vod_id, seg_id, s, message, '{n}' AS pattern FROM msg WHERE regexp_matches(message, '{p}')" for n, p in PATTERNS.items()
)
MSG = r"msg AS (SELECT role AS vod_id, CAST(vod_id AS BIGINT) * 100 + seg_id AS seg_id, s, regexp_replace(text, '^\s+|\s+$', '', 'g') AS message FROM turns)"


def role_chat(t):
    return t.turns.select(F.col("role").alias("vod_id"), (F.col("vod_id").cast("long") * 100 + F.col("seg_id")).alias("seq"), F.col("start").alias("t"), F.col("text").alias("message"))


@query("ag_pattern_hits", with_("turns", body=f"SELECT vod_id, pattern, count(*) AS hits FROM ({PSQL}) GROUP BY ALL", recursive=MSG))
def _(t):
    return mi.pattern_hits(role_chat(t), PATTERNS)


@query(
    "ag_pattern_samples",
    with_("turns", body=f"""SELECT vod_id, pattern, CAST(rn AS INTEGER) AS ord, round_even(s, 1) AS t, left(message, 100) AS message FROM (
              SELECT *, row_number() OVER (PARTITION BY vod_id, pattern ORDER BY seg_id) AS rn FROM ({PSQL})) WHERE rn <= 10""", recursive=MSG),
)
def _(t):
    return mi.pattern_samples(role_chat(t), PATTERNS).select("vod_id", "pattern", "ord", "t", "message")


@query(
    "ag_top_tokens",
    with_("turns", body=r"""SELECT vod_id, token, n, CAST(rn AS INTEGER) AS rank FROM (SELECT vod_id, lower(tok) AS token, count(*) AS n, row_number() OVER (PARTITION BY vod_id ORDER BY count(*) DESC, lower(tok)) AS rn
              FROM (SELECT vod_id, unnest(regexp_extract_all(message, '[A-Za-z]{4,8}')) AS tok FROM msg WHERE length(message) <= 400) GROUP BY vod_id, lower(tok)) WHERE rn <= 30""", recursive=MSG),
)
def _(t):
    return mi.top_tokens(role_chat(t), pattern="[A-Za-z]{4,8}", max_len=400)


@query("ag_all_tokens", with_("turns", body=r"""SELECT vod_id, token, n, CAST(row_number() OVER (PARTITION BY vod_id ORDER BY n DESC, token) AS INTEGER) AS rank FROM (
              SELECT vod_id, lower(tok) AS token, count(*) AS n FROM (SELECT vod_id, unnest(regexp_extract_all(message, '[A-Za-z]{4,8}')) AS tok FROM msg) GROUP BY vod_id, lower(tok))""", recursive=MSG))
def _(t):
    """Every token of every message."""
    return mi.top_tokens(role_chat(t), pattern="[A-Za-z]{4,8}", max_len=None, n=None)


@query("ag_cue_rows", with_("turns", body="""SELECT vod_id, CAST(rn AS INTEGER) AS ord, round_even(s, 1) AS t, message FROM (
              SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY seg_id) AS rn FROM msg WHERE contains(message, 'the')) WHERE rn <= 20""", recursive=MSG))
def _(t):
    """A report of the first twenty cue messages, whole."""
    return mi.cue_rows(role_chat(t), "the", n=20, width=None)


ALIGN = r"""refs AS (SELECT vod_id, seg_id AS ref_id, text AS rt, e - s AS rd FROM turns WHERE seg_id % 2 = 1),
  bd AS (SELECT vod_id, arg_min(s, seg_id) AS m0, arg_max(e, seg_id) AS m1 FROM turns GROUP BY vod_id),
  ws AS (SELECT * FROM (SELECT r.vod_id, ref_id, rt, m0, m1, greatest(3e0, rd) AS d, unnest(range(CAST(ceil((m1 - m0) / 15) AS BIGINT))) AS i FROM refs r JOIN bd USING (vod_id)) WHERE m0 + i * 15 < m1),
  wx AS (SELECT ws.vod_id, ref_id, i, m0, m1, d, rt, coalesce(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), '' ORDER BY seg_id), '') AS x FROM ws LEFT JOIN turns s ON s.vod_id = ws.vod_id AND s.e > m0 + i * 15 AND s.s < least(m1, m0 + i * 15 + d) GROUP BY ALL),
  nx AS (SELECT *, regexp_replace(lower(x), '\s+', '', 'g') AS a, regexp_replace(lower(rt), '\s+', '', 'g') AS b FROM wx),
  gx AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda k: substr(a, k, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda k: substr(b, k, 2))) AS gb FROM nx),
  sc AS (SELECT *, len(list_intersect(ga, gb)) / greatest(1, len(ga) + len(gb) - len(list_intersect(ga, gb))) AS score FROM gx),
  al AS (SELECT vod_id, ref_id, m0 + i * 15 AS s, least(m1, m0 + i * 15 + d) AS e, score FROM (SELECT *, row_number() OVER (PARTITION BY vod_id, ref_id ORDER BY score DESC, i) AS rn FROM sc) WHERE rn = 1)"""


def aligned(t):
    refs = t.turns.where(F.col("seg_id") % 2 == 1).select("vod_id", F.col("seg_id").alias("ref_id"), F.col("text").alias("ref_text"), (F.col("end") - F.col("start")).alias("ref_dur"))
    return mi.align_reference(t.turns, refs, step=15.0)


@query("iv_align_reference", with_("turns", body='SELECT vod_id, ref_id, s AS start, round(e, 6) AS "end", round(score, 6) AS score FROM al', recursive=ALIGN))
def _(t):
    return aligned(t).select("vod_id", "ref_id", "start", r6("end").alias("end"), r6("score").alias("score"))


@query(
    "jn_nearest_highlight",
    with_(
        "turns",
        body="""SELECT vod_id, ref_id, highlight_id, round(ds, 6) AS delta_start, round(de, 6) AS delta_end, ds <= 20 AND de <= 20 AS pass FROM (
                  SELECT al.vod_id, ref_id, seg_id AS highlight_id, abs(t.s + 7 - al.s) AS ds, abs(t.e + 7 - al.e) AS de, row_number() OVER (PARTITION BY al.vod_id, ref_id ORDER BY round(abs(t.s + 7 - al.s) + abs(t.e + 7 - al.e), 9), seg_id) AS rn
                  FROM al JOIN turns t ON t.vod_id = al.vod_id WHERE seg_id % 2 = 0) WHERE rn = 1""",
        recursive=ALIGN,
    ),
)
def _(t):
    h = t.turns.where(F.col("seg_id") % 2 == 0).select("vod_id", F.col("seg_id").alias("id"), (F.col("start") + 7).alias("start"), (F.col("end") + 7).alias("end"))
    n = mi.nearest_highlight(aligned(t), h, tolerance=20.0)
    return n.select("vod_id", "ref_id", "highlight_id", r6("delta_start").alias("delta_start"), r6("delta_end").alias("delta_end"), "pass")
