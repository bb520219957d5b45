"""The benchmark tables as recordings, and the same derivations as SQL.

One day of `events` is one recording: an event is a chat message at its second of the day and a loudness
frame with its value; `view` events are voice intervals, `click` events transcript segments. A
conversation or a document is a recording whose turns or lines are its transcript.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine.lexicon import TALK
from clipmine.operators import signals as sg
from clipmine.operators.intervals import merge_intervals
from clipmine.plans.candidates import Recordings
from clipmine.session import cut_lineage

# Events are sparse (hundreds a day), so windows are wider than for real chat.
DAY = TALK.with_(
    clip_min_sec=300.0, clip_max_sec=600.0, window_step_sec=180.0, short_window_sec=300.0, seed_dedupe_sec=60.0,
    diversity_min_gap_sec=900.0, story_min_sec=300.0, story_max_sec=1500.0, story_gap_max_sec=120.0, speech_ratio_min=0.05,
    laugh="purchase", confused="error", clip_cue="signup", chat_keywords=("click", "e"), keywords=("u1", "k7"),
    flourish_keywords=("u12", "k77", "u7 k"), intro_keywords=("k12", "u33"), outro_keywords=("k9", "u44"), chat_lag_sec=30.0,
    prefilter_top_n=10,
)
LINE_WORDS = ("the", "and", "ion", "que", "der")


def seconds_of_day(ts: str) -> Column:
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = F.expr(f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")
    return (whole.cast("long") * 1000000 + micros) / 1000000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").select(
            F.to_date("ts").cast("string").alias("vod_id"), F.col("event_id").alias("seq"), seconds_of_day("ts").alias("t"),
            F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("message"), "value", "props",
        )

    @cached_property
    def vods(self) -> DataFrame:
        return self.events.select("vod_id").distinct().withColumn("duration_sec", F.lit(86400.0))

    @cached_property
    def chat(self) -> DataFrame:
        return self.events.select("vod_id", "seq", "t", "author", "message")

    @cached_property
    def frames(self) -> DataFrame:
        return self.events.select("vod_id", F.col("seq").alias("peak_id"), "t", F.col("value").alias("rms"))

    @cached_property
    def loudness(self) -> DataFrame:
        return sg.zscores(self.frames)

    @cached_property
    def emotion(self) -> DataFrame:
        z = self.loudness.where(F.col("zscore") >= 2.5)
        return z.select("vod_id", "peak_id", "t", F.col("zscore").alias("score"), sg.emotion_kind(F.col("zscore")).alias("kind"))

    @cached_property
    def energy(self) -> DataFrame:
        return self.events.where(F.col("message") == "view").select(
            "vod_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / 2.0).alias("end")
        )

    @cached_property
    def speech(self) -> DataFrame:
        return merge_intervals(self.energy, 0.35)

    @cached_property
    def segments(self) -> DataFrame:
        mark = F.when(F.col("seq") % 3 == 0, "!").otherwise(",")
        return self.events.where(F.col("message") == "click").select(
            "vod_id", F.col("seq").alias("seg_id"), F.col("t").alias("start"), (F.col("t") + 5.0 + F.col("value") / 10.0).alias("end"),
            F.concat(F.lit("u"), "author", F.lit(" k"), F.regexp_extract("props", r"(\d+)", 1), mark).alias("text"),
        )

    @cached_property
    def recordings(self) -> Recordings:
        """Derived tables are stored once, as a pipeline would have them."""
        loudness = cut_lineage(self.loudness.select("vod_id", "t", "rms", "zscore"))
        emotion = loudness.where(F.col("zscore") >= 2.5).select(
            "vod_id", "t", F.col("zscore").alias("score"), sg.emotion_kind(F.col("zscore")).alias("kind")
        )
        return Recordings(cut_lineage(self.vods), self.chat, self.segments, loudness, cut_lineage(emotion), cut_lineage(self.speech))

    @cached_property
    def turns(self) -> DataFrame:
        """Conversation turns as transcript segments."""
        return self.read("conversations").select(
            F.col("conv_id").cast("string").alias("vod_id"), F.col("turn").alias("seg_id"), "role",
            (F.col("turn") * 30.0).alias("start"),
            (F.col("turn") * 30.0 + F.least(F.lit(30.0), F.length("text") / 15.0)).alias("end"), "text",
        )

    @cached_property
    def turn_words(self) -> DataFrame:
        """Turns with word times: each blank-separated word lasts its share of the turn."""
        parts = self.turns.withColumn("_p", F.split("text", " ")).withColumn("_step", (F.col("end") - F.col("start")) / F.size("_p"))
        at = lambda i: F.col("start") + i * F.col("_step")
        return parts.withColumn(
            "words",
            F.transform(
                "_p",
                lambda w, i: F.struct(at(i).alias("start"), (at(i) + F.col("_step") * 0.9).alias("end"), w.alias("text")),
            ),
        ).drop("_p", "_step")

    @cached_property
    def lines(self) -> DataFrame:
        """Document lines as transcript segments, one every ten seconds."""
        return self.read("documents").select(
            F.col("doc_id").cast("string").alias("vod_id"), F.posexplode(F.split("text", "\n")).alias("seg_id", "text")
        ).select(
            "vod_id", F.col("seg_id").cast("long").alias("seg_id"), (F.col("seg_id") * 10.0).alias("start"),
            (F.col("seg_id") * 10.0 + F.least(F.lit(10.0), F.length("text") / 15.0)).alias("end"), "text",
        )

    @cached_property
    def line_vods(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").cast("string").alias("vod_id"), (F.size(F.split("text", "\n")) * 10.0).alias("duration_sec")
        )

    @cached_property
    def clips(self) -> DataFrame:
        """Highlights to edit: a span around every purchase or sign-up."""
        return self.events.where(F.col("message").isin("purchase", "signup")).select(
            "vod_id", F.col("seq").alias("clip_id"), F.greatest(F.lit(0.0), F.col("t") - 30.0).alias("start"),
            (F.col("t") + 60.0 + F.col("value")).alias("end"),
        )


# --- the same in SQL ------------------------------------------------------------------------------


def merge_sql(src: str, gap: str, keys: str = "vod_id") -> str:
    """Gaps and islands over `src(keys, s, e)`."""
    return f"""SELECT {keys}, min(s) AS s, max(e) AS e FROM (
        SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > {gap} THEN 1 ELSE 0 END)
               OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
              FROM {src})) GROUP BY {keys}, g"""


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        """SELECT strftime(ts, '%Y-%m-%d') AS vod_id, event_id AS seq,
                  (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 AS t,
                  CAST(user_id AS VARCHAR) AS author, event_type AS message, value, props FROM events""",
    ),
    "vods": (("ev",), "SELECT DISTINCT vod_id, CAST(86400 AS DOUBLE) AS duration_sec FROM ev"),
    "stats": (("ev",), "SELECT vod_id, avg(value) AS m, stddev_pop(value) AS sd FROM ev GROUP BY vod_id"),
    "loud": (
        ("ev", "stats"),
        """SELECT ev.vod_id, seq AS peak_id, t, value AS rms, CASE WHEN sd < 1e-12 THEN 0e0 ELSE (value - m) / sd END AS z
           FROM ev JOIN stats USING (vod_id)""",
    ),
    "emo": (
        ("loud",),
        """SELECT vod_id, peak_id, t, z AS score, CASE WHEN z >= 4 THEN 'scream' WHEN z >= 3 THEN 'laugh' ELSE 'burst' END AS kind
           FROM loud WHERE z >= 2.5""",
    ),
    "energy": (("ev",), "SELECT vod_id, t AS s, t + value / 2e0 AS e FROM ev WHERE message = 'view'"),
    "speech": (("energy",), merge_sql("energy", "0.35e0")),
    "seg": (
        ("ev",),
        r"""SELECT vod_id, seq AS seg_id, t AS s, t + 5e0 + value / 10e0 AS e,
                  'u' || author || ' k' || regexp_extract(props, '(\d+)', 1) || CASE WHEN seq % 3 = 0 THEN '!' ELSE ',' END AS text
           FROM ev WHERE message = 'click'""",
    ),
    "turns": (
        (),
        """SELECT CAST(conv_id AS VARCHAR) AS vod_id, turn AS seg_id, role, turn * 30e0 AS s,
                  turn * 30e0 + least(30e0, length(text) / 15e0) AS e, text FROM conversations""",
    ),
    "doclines": (
        (),
        """SELECT vod_id, seg_id, seg_id * 10e0 AS s, seg_id * 10e0 + least(10e0, length(text) / 15e0) AS e, text FROM (
             SELECT CAST(doc_id AS VARCHAR) AS vod_id, unnest(string_split(text, chr(10))) AS text,
                    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_id FROM documents)""",
    ),
    "clips": (
        ("ev",),
        """SELECT vod_id, seq AS clip_id, greatest(0e0, t - 30e0) AS s, t + 60e0 + value AS e
           FROM ev WHERE message IN ('purchase', 'signup')""",
    ),
    "win": (
        ("vods",),
        """SELECT vod_id, h * 1000 + i AS win_id, h, i, (h * 3600 + i * 180) * 1e0 AS s, (h * 3600 + i * 180 + 600) * 1e0 AS e
           FROM vods, (SELECT unnest(range(24)) AS h), (SELECT unnest(range(17)) AS i)""",
    ),
    "chatf": (
        ("ev", "win"),
        """SELECT vod_id, win_id, h, i, s, e, n / 600e0 AS density, least(2e0, la / 600e0) AS laugh, least(2e0, co / 600e0) AS confused,
                  least(3e0, cu * 1.5e0) AS cue, kw, peak
           FROM (SELECT w.vod_id, win_id, h, i, w.s, w.e, count(seq) AS n, count(*) FILTER (message = 'purchase') AS la,
                        count(*) FILTER (message = 'error') AS co, count(*) FILTER (message = 'signup') AS cu,
                        coalesce(sum(CASE message WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN 1 WHEN 'view' THEN 1 ELSE 0 END), 0) AS kw,
                        max(CASE WHEN message IN ('purchase', 'error', 'signup') THEN t END) AS peak
                 FROM win w LEFT JOIN ev ON ev.vod_id = w.vod_id AND ev.t >= w.s AND ev.t < w.e
                 GROUP BY ALL)""",
    ),
    "slide": (
        ("chatf",),
        """SELECT *, 2e0 * density + 1.6e0 * (laugh + 0.7e0 * confused) + 2.5e0 * cue + 1.2e0 * kw AS score,
                  CAST(h AS INTEGER) AS hour_bucket FROM chatf""",
    ),
    "ranked": (
        ("slide",),
        """SELECT *, score + (score - avg(score) OVER w) / CASE WHEN var_pop(score) OVER w > 1e-12 THEN stddev_pop(score) OVER w ELSE 1 END AS rank_score,
                  row_number() OVER (PARTITION BY vod_id ORDER BY round(score, 9) DESC, win_id) AS candidate_id
           FROM slide WINDOW w AS (PARTITION BY vod_id, hour_bucket)""",
    ),
}


def with_(*names: str, body: str, recursive: str = "") -> str:
    """`WITH` the named derivations (and what they need), then `body`.

    `recursive` holds further common table expressions, which may be recursive.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTE[name][0]:
                visit(need)
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order]
    if recursive:
        parts.append(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
