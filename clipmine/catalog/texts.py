"""Registered queries: text, time and span functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.tables import LINE_WORDS, with_
from clipmine.functions import spans as sp
from clipmine.functions import text as tx
from clipmine.functions import timecode as tc

DICT = {"the": "THE", "theon": "X", "ion": "i", "E": "e"}


@query(
    "fn_replace_words",
    """SELECT doc_id, replace(replace(replace(replace(text, 'theon', 'X'), 'the', 'THE'), 'ion', 'i'), 'E', 'e') AS replaced FROM documents""",
)
def _(t):
    return t.read("documents").select("doc_id", tx.replace_words("text", DICT).alias("replaced"))


@query(
    "fn_keyword_hits",
    "SELECT doc_id, CAST("
    + " + ".join(
        f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in LINE_WORDS
    )
    + " AS BIGINT) AS hits FROM documents",
)
def _(t):
    return t.read("documents").select("doc_id", tx.keyword_hits("text", [w.upper() for w in LINE_WORDS]).alias("hits"))


@query(
    "fn_contains_any",
    """SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'elle')) AS intro,
              (contains(lower(text), '晚安') OR contains(lower(text), '拜拜') OR contains(lower(text), 'taat')) AS outro FROM documents""",
)
def _(t):
    return t.read("documents").select(
        "doc_id", tx.contains_any("text", ["License", "elle"]).alias("intro"), tx.contains_any("text", [], ["晚安", "拜拜", "taat"]).alias("outro")
    )


@query(
    "fn_reactions",
    r"""SELECT doc_id, regexp_matches(text, '(?i)(w{2,}|草+|www+|哈哈哈+|哈{2,}|笑死|太扯|幹哈|lol|lmao|777+)') AS laugh,
               regexp_matches(text, '(?i)([?？]{2,}|蛤+|什麼鬼|什麼東西|幹嘛|嚇死|崩潰)') AS confused,
               regexp_matches(text, '(?i)(精華|剪輯師|剪輯|這段要剪|要剪|拜託剪|記得剪|剪進去|shorts?)') AS cue,
               regexp_matches(text, '(?i)th{1}e{1,2}on') AS custom FROM documents""",
)
def _(t):
    from clipmine import lexicon as lx

    hit = lambda p: F.col("text").rlike(p)
    return t.read("documents").select(
        "doc_id", hit(lx.LAUGH).alias("laugh"), hit(lx.CONFUSED).alias("confused"), hit(lx.CLIP_CUE).alias("cue"),
        hit("(?i)th{1}e{1,2}on").alias("custom"),
    )


@query(
    "fn_title_hook_excerpt",
    r"""SELECT doc_id, title, '「當' || title || '…」' AS hook,
               CASE WHEN length(text) > 800 THEN left(text, 799) || '…' ELSE text END AS excerpt
        FROM (SELECT *, left(regexp_replace(text, '\s+', '', 'g'), 20) AS title FROM documents)""",
)
def _(t):
    return t.read("documents").select("doc_id", tx.title("text").alias("title"), tx.hook(tx.title("text")).alias("hook"), tx.excerpt("text").alias("excerpt"))


@query(
    "fn_timecodes",
    with_(
        "ev",
        body="""SELECT seq, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS stamp,
                       printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS srt,
                       printf('%d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) AS centi,
                       round(ms / 1000e0, 3) AS back
                FROM (SELECT seq, CAST(round_even(t * 1000, 0) AS BIGINT) AS ms, CAST(round_even(t * 100, 0) AS BIGINT) AS cs FROM ev)""",
    ),
)
def _(t):
    return t.chat.select(
        "seq", tc.timestamp("t").alias("stamp"), tc.srt_timestamp("t").alias("srt"), tc.centisecond_timestamp("t").alias("centi"),
        F.round(tc.parse_timestamp(tc.timestamp("t")), 3).alias("back"),
    )


@query(
    "fn_clamp_hour",
    with_(
        "clips",
        body="""SELECT clip_id, round(CASE WHEN e - s > 100 THEN s + 100 ELSE e END, 6) AS new_end, CAST(floor(s / 3600) AS INTEGER) AS hour,
                       CAST(greatest(1, ceil(e / 3600)) AS INTEGER) AS hours, round(greatest(0e0, least(e, 12 * 3600e0)), 6) AS capped FROM clips""",
    ),
)
def _(t):
    return t.clips.select(
        "clip_id", F.round(sp.clamp_end("start", "end", 100.0), 6).alias("new_end"), sp.hour_of("start").alias("hour"),
        sp.hour_count("end").alias("hours"), F.round(sp.effective_duration("end", 12.0), 6).alias("capped"),
    )


@query(
    "fn_stream_date",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y/%-m/%-d') WHEN 1 THEN strftime(ts, '%Y/%-m/%-d') ELSE '--/-/--' END AS day FROM events""",
)
def _(t):
    kind = F.col("event_id") % 3
    day = F.to_date("ts").cast("string")
    e = t.read("events").select(
        "event_id", F.when(kind == 0, F.replace(day, F.lit("-"), F.lit(""))).when(kind == 1, "2024").alias("up"),
        F.when(kind == 1, F.concat(day, F.lit("T00:00:00Z"))).alias("created"),
    )
    return e.select("event_id", tc.stream_date("up", "created").alias("day"))


GRAMS = "CASE WHEN length({c}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"
NORM = r"regexp_replace(lower({c}), '\s+', '', 'g')"


@query(
    "fn_bigram_jaccard",
    with_(
        "turns",
        body=f"""SELECT vod_id, seg_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS sim
                 FROM (SELECT x.vod_id, x.seg_id, {GRAMS.format(c='x.n')} AS a, {GRAMS.format(c='y.n')} AS b
                       FROM (SELECT *, {NORM.format(c='text')} AS n FROM turns) x JOIN (SELECT *, {NORM.format(c='text')} AS n FROM turns) y
                         ON x.vod_id = y.vod_id AND y.seg_id = x.seg_id + 1)""",
    ),
)
def _(t):
    a = t.turns.select("vod_id", "seg_id", tx.alignment_bigrams("text").alias("a"))
    b = t.turns.select("vod_id", (F.col("seg_id") - 1).alias("seg_id"), tx.alignment_bigrams("text").alias("b"))
    return a.join(b, ["vod_id", "seg_id"]).select("vod_id", "seg_id", F.round(tx.jaccard("a", "b"), 6).alias("sim"))


@query(
    "fn_bigram_classes",
    r"""SELECT doc_id, CAST(CASE WHEN length(n) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(n)), lambda i: substr(n, i, 2)))) END AS INTEGER) AS pairs
        FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}]', '', 'g') AS n FROM documents)""",
)
def _(t):
    return t.read("documents").select("doc_id", F.size(tx.bigrams("text", char_class=r"\p{L}\p{M}\p{N}")).alias("pairs"))


@query(
    "fn_iou",
    with_(
        "clips",
        body="""SELECT clip_id, round(CASE WHEN least(e, s + 120) - greatest(s, s + 20) <= 0 THEN 0e0
                  ELSE (least(e, s + 120) - greatest(s, s + 20)) / (greatest(e, s + 120) - least(s, s + 20)) END, 6) AS iou FROM clips""",
    ),
)
def _(t):
    s, e = F.col("start"), F.col("end")
    return t.clips.select("clip_id", F.round(sp.iou(s, e, s + 20.0, s + 120.0), 6).alias("iou"))


@query(
    "fn_speech_rate",
    with_(
        "turns",
        body=r"""SELECT vod_id, seg_id, round(length(replace(replace(text, ' ', ''), chr(10), '')) / greatest(0.05e0, e - s), 6) AS cps,
                        length(text) - length(replace(text, ' ', '')) + 1 >= 4 AND fr >= 0.75 AS front
                 FROM (SELECT *, list_sum(list_transform(range(nw), lambda i: CASE WHEN (i + 0.45e0) / nw <= 0.3e0 AND trim(string_split(text, ' ')[i + 1]) <> '' THEN 1e0 ELSE 0e0 END))
                                 / greatest(1, list_sum(list_transform(string_split(text, ' '), lambda w: CASE WHEN trim(w) <> '' THEN 1e0 ELSE 0e0 END))) AS fr
                       FROM (SELECT *, len(string_split(text, ' ')) AS nw FROM turns))""",
    ),
)
def _(t):
    return t.turn_words.select(
        "vod_id", "seg_id", F.round(tx.chars_per_second("text", "start", "end"), 6).alias("cps"), tx.front_loaded("words", "start", "end").alias("front")
    )


@query(
    "fn_noise",
    with_("doclines", body=r"""SELECT vod_id, seg_id, regexp_matches(replace(text, ' ', ''), '^[\s.,!?？！。、；;：:\-~～…·・''"「」『』（）()\[\]【】]*$') AS noise FROM doclines"""),
)
def _(t):
    return t.lines.select("vod_id", "seg_id", tx.is_noise("text").alias("noise"))


STOP = ("the", "and", "of", "le", "la")


@query(
    "fn_content_words",
    with_(
        "turns",
        body=r"""SELECT vod_id, seg_id, CAST(len(list_filter(string_split(text, ' '), lambda w: length(trim(w, ' ' || chr(10))) >= 2
                      AND NOT list_contains(['the', 'and', 'of', 'le', 'la'], trim(w, ' ' || chr(10)))
                      AND NOT regexp_matches(trim(w, ' ' || chr(10)), '^[^\p{L}\p{M}]+$'))) AS INTEGER) AS words FROM turns""",
    ),
)
def _(t):
    words = F.filter(F.split("text", " "), lambda w: tx.is_content_word(w, STOP))
    return t.turns.select("vod_id", "seg_id", F.size(words).alias("words"))


SPAN_WORDS = ("tion", "the", "ement", "ab")


@query(
    "fn_key_span",
    with_(
        "doclines",
        body="""SELECT vod_id, seg_id, frag, CAST(p - 1 AS INTEGER) AS at,
                       CASE WHEN p = 1 AND length(text) > length(frag) THEN 'head' WHEN p > 1 AND p - 1 + length(frag) = length(text) THEN 'tail' ELSE 'mid' END AS kind,
                       CASE WHEN frag IS NULL THEN NULL ELSE 'keyword' END AS why
                FROM (SELECT *, strpos(text, frag) AS p FROM (SELECT *, CASE WHEN contains(text, 'ement') THEN 'ement' WHEN contains(text, 'tion') THEN 'tion'
                        WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'ab') THEN 'ab' END AS frag FROM doclines)) WHERE frag IS NOT NULL""",
    ),
)
def _(t):
    k = t.lines.withColumn("k", tx.key_span("text", SPAN_WORDS)).where(F.col("k").isNotNull())
    return k.select("vod_id", "seg_id", "k.frag", F.col("k.offset").alias("at"), "k.kind", tx.emphasis_reason("text", SPAN_WORDS).alias("why"))


@query(
    "fn_keywords_in",
    """SELECT doc_id, array_to_string(list_filter(['ement', 'tion', 'the', 'ab'], lambda k: contains(text, k))[1:2], '|') AS found FROM documents""",
)
def _(t):
    return t.read("documents").select("doc_id", F.array_join(tx.keywords_in("text", SPAN_WORDS), "|").alias("found"))


@query(
    "fn_mark_keywords",
    with_(
        "doclines",
        body="""SELECT vod_id, seg_id, CAST(length(text) AS INTEGER) AS chars,
                       CAST(len(list_filter(list_zip(string_split(replace(text, 'tion', repeat(chr(1), 4)), ''), string_split(replace(text, 'anan', repeat(chr(1), 4)), '')),
                                            lambda z: z[1] = chr(1) OR z[2] = chr(1))) AS INTEGER) AS marked
                FROM doclines""",
    ),
)
def _(t):
    words = F.transform(tx.characters("text"), lambda ch: F.struct(ch.alias("text"), F.lit(False).alias("is_kw"), F.lit(None).cast("string").alias("color")))
    m = t.lines.withColumn("m", tx.mark_keywords(words, ["tion", "anan"]))
    return m.select("vod_id", "seg_id", F.size("m").alias("chars"), F.size(F.filter("m", lambda w: w["is_kw"])).alias("marked"))


@query(
    "fn_markup",
    with_(
        "doclines",
        body="""SELECT vod_id, seg_id, regexp_replace(replace(text, '*', '+'), '((tion)+)', '**\\1**', 'g') AS marked, CAST((length(text) - length(replace(text, 'tion', ''))) AS INTEGER) AS flagged
                FROM doclines""",
    ),
)
def _(t):
    plain = F.replace("text", F.lit("*"), F.lit("+"))
    m = t.lines.withColumn("m", tx.parse_markup(F.regexp_replace(plain, "((?:tion)+)", "**$1**")))
    return m.select("vod_id", "seg_id", tx.to_markup("m").alias("marked"), F.size(F.filter("m", lambda w: w["is_kw"])).alias("flagged"))


@query(
    "fn_shake_params",
    with_(
        "loud",
        body="""SELECT peak_id, round(greatest(0.55e0, least(1.4e0, 0.5e0 + 0.15e0 * round(z, 3))), 6) AS dur,
                       CAST(greatest(3, least(8, round_even(2 + 0.8e0 * round(z, 3), 0))) AS INTEGER) AS cycles FROM loud""",
    ),
)
def _(t):
    z = t.loudness.withColumn("z", F.round("zscore", 3))
    return z.select("peak_id", F.round(sp.shake_duration("z"), 6).alias("dur"), sp.shake_cycles("z").alias("cycles"))


@query(
    "fn_content_type",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'game' WHEN lang IN ('talk', 'game') THEN lang WHEN doc_id % 3 = 1 THEN 'talk' ELSE 'talk' END AS kind FROM documents""",
)
def _(t):
    d = t.read("documents")
    conf = F.when(F.col("doc_id") % 3 == 0, "game").when(F.col("doc_id") % 3 == 1, "auto")
    return d.select("doc_id", sp.effective_content_type(conf, F.col("lang")).alias("kind"))


@query(
    "fn_tags",
    with_(
        "doclines",
        body=r"""SELECT vod_id, seg_id, text AS plain, '{\a}{b}' AS lead,
                        '{\a}{b}' || CASE WHEN contains(text, 'tion') THEN left(text, strpos(text, 'tion') - 1) || '<b>tion</b>' || substr(text, strpos(text, 'tion') + 4) ELSE text END AS styled
                 FROM (SELECT vod_id, seg_id, replace(text, '{', '(') AS text FROM doclines)""",
    ),
)
def _(t):
    lines = t.lines.withColumn("text", F.replace("text", F.lit("{"), F.lit("(")))
    raw = lines.withColumn("raw", F.concat(F.lit("{\\a}{b}"), "text")).withColumn("at", F.instr("text", "tion") - 1)
    wrapped = tx.wrap_span(tx.without_leading_tags("raw"), "at", F.lit("tion"), "<b>", "</b>")
    return raw.select(
        "vod_id", "seg_id", tx.strip_tags("raw").alias("plain"), tx.leading_tags("raw").alias("lead"),
        F.concat(tx.leading_tags("raw"), F.when(F.col("at") >= 0, wrapped).otherwise(F.col("text"))).alias("styled"),
    )


@query(
    "fn_parse_words",
    with_(
        "turns",
        body="""SELECT vod_id, seg_id, CAST(len(w) AS INTEGER) AS words, array_to_string(w, '|') AS texts
                FROM (SELECT vod_id, seg_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS w FROM turns)""",
    ),
)
def _(t):
    raw = t.turn_words.withColumn(
        "p",
        F.transform("words", lambda w, i: F.struct(F.when(i % 2 == 0, w["text"]).otherwise("").alias("word"), w["text"].alias("text"), w["start"].alias("start"), F.when(i % 3 > 0, w["start"] - 1).alias("end"))),
    ).withColumn("p", tx.parse_words("p"))
    return raw.select("vod_id", "seg_id", F.size("p").alias("words"), F.array_join(F.transform("p", lambda w: w["text"]), "|").alias("texts"))
