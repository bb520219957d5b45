"""A user's edits of old cues on freshly built ones: an exclusive assignment, then columns."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import col, let, overlap_len
from clipmine.operators.cues import fresh_words, shown_text
from clipmine.operators.laid import chosen

# Fixed values, begin: when a cue is the same one, and when its text was edited.
MIN_SHARED_SEC = 0.15
EDIT_CHARS = 4
EDIT_SHARE = 3
# Fixed values, end.


WORDS = "array<struct<text: string, is_kw: boolean, color: string>>"


def shown(words) -> Column:
    """The text of words without line breaks."""
    return F.replace(tx.words_text(words), F.lit("\n"), F.lit(""))


def _size(w: Column) -> Column:
    return F.length(F.coalesce(w["text"], F.lit("")))


def carried_marks(base, old) -> Column:
    """The words `base` with the flags and colours of the words `old`.

    If both have the same text, every character keeps its mark. Otherwise each flagged run of `old` marks the first
    place of `base` that has its text. A word is flagged if one of its characters is, and takes the last colour.
    """

    def placed(v: Column) -> Column:
        """Runs of marks and where they begin in `base`."""
        marks = F.flatten(F.transform(v["old"], lambda w: F.array_repeat(F.struct(w["is_kw"].alias("is_kw"), w["color"].alias("color")), _size(w))))
        mask = F.array_join(F.transform(marks, lambda m: F.when(m["is_kw"], "1").otherwise("0")), "")
        run = F.struct(F.lit(0).alias("at"), marks.alias("marks"))

        def runs(m: Column) -> Column:
            flagged = F.regexp_extract_all(m["mask"], F.lit("1+|0+"), 0)
            # Where each run begins: the sizes of those before.
            begins = F.transform(flagged, lambda r, i: F.aggregate(F.slice(flagged, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
            spans = F.filter(F.arrays_zip(flagged.alias("run"), begins.alias("from")), lambda z: z["run"].startswith("1"))
            found = F.transform(
                spans,
                lambda z: F.struct(
                    (F.position(F.substr(v["before"], z["from"] + 1, F.length(z["run"])), v["now"]) - 1).alias("at"),
                    F.slice(m["marks"], z["from"] + 1, F.length(z["run"])).alias("marks"),
                ),
            )
            return F.filter(found, lambda r: r["at"] >= 0)

        return F.when(v["before"] == v["now"], F.array(run)).otherwise(let(F.struct(mask.alias("mask"), marks.alias("marks")), runs))

    def mark(v: Column) -> Column:
        begins = lambda i: F.aggregate(F.slice(v["base"], F.lit(1), i), F.lit(0), lambda n, w: n + _size(w))

        def word(w: Column, at: Column) -> Column:
            end = at + _size(w)
            mine = lambda r: F.slice(r["marks"], F.greatest(at - r["at"], F.lit(0)) + 1, F.greatest(F.least(end, r["at"] + F.size(r["marks"])) - F.greatest(at, r["at"]), F.lit(0)))
            own = F.flatten(F.transform(v["runs"], mine))
            colour = F.get(F.reverse(F.filter(own, lambda m: m["color"].isNotNull())), F.lit(0))["color"]
            return F.struct(w["text"].alias("text"), (w["is_kw"] | F.exists(own, lambda m: m["is_kw"])).alias("is_kw"), F.coalesce(colour, w["color"]).alias("color"))

        return F.transform(v["base"], lambda w, i: let(begins(i), lambda at: word(w, at)))

    both = F.struct(col(base).alias("base"), F.coalesce(col(old), F.slice(col(base), 1, 0)).alias("old"), tx.words_text(base).alias("now"), tx.words_text(old).alias("before"))
    return let(let(both, lambda v: F.struct(v["base"].alias("base"), placed(v).alias("runs"))), mark)


def _old_arrays(old: DataFrame, keys: Sequence[str], styles: Sequence[str]) -> DataFrame:
    """`old`: a clip's old cues as an array. An old cue without words is read from its text, marks included."""
    words = F.col("words") if "words" in old.columns else F.lit(None).cast(WORDS)
    given = F.coalesce(F.size(words), F.lit(0)) > 0
    kept = [F.when(given, words).alias("words")] if "words" in old.columns else []
    lists = old.groupBy(*keys).agg(F.collect_list(F.struct("cue_id", "start", "end", "vod_start", "vod_end", "text", *kept, *styles)).alias("old"))

    def whole(o: Column) -> Column:
        w = o["words"] if kept else F.lit(None).cast(WORDS)
        marked = F.when(w.isNotNull(), F.exists(w, lambda x: x["is_kw"] | x["color"].isNotNull())).otherwise(F.coalesce(o["text"], F.lit("")).contains("**"))
        plain = F.when(w.isNotNull(), shown(w)).otherwise(shown_text(o["text"]))
        return F.struct(*[o[c].alias(c) for c in ("cue_id", "start", "end", "vod_start", "vod_end", "text")], w.alias("words"), plain.alias("plain"), F.coalesce(marked, F.lit(False)).alias("marked"), *[o[c].alias(c) for c in styles])

    return lists.withColumn("old", F.transform("old", whole))


def _timed(c: Column) -> Column:
    a, b = c["vod_start"], c["vod_end"]
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (b > a), F.lit(False))


def _ordered(c: str) -> Column:
    """An array of cues in order of start and id."""
    order = F.array_sort(F.transform(c, lambda x, i: F.struct(x["start"].alias("at"), x["cue_id"].alias("id"), i.alias("i"))))
    return F.transform(order, lambda x: F.get(c, x["i"]))


def _taken(clips: DataFrame, plain: Callable[[Column], Column]) -> Column:
    """For each of the ordered `fresh` cues the index of the old one that it takes, in Arrow batches."""
    at = lambda c, x: F.transform(c, lambda f: F.when(_timed(f), f[x]))
    texts = lambda c, text: F.transform(c, lambda f: F.when(~_timed(f), text(f)))
    old_text = lambda o: o["plain"]
    return chosen(at("fresh", "vod_start"), at("fresh", "vod_end"), texts("fresh", plain), at("old", "vod_start"), at("old", "vod_end"), texts("old", old_text), F.lit(MIN_SHARED_SEC))


def _taken_by_columns(clips: DataFrame, plain: Callable[[Column], Column]) -> Column:
    """As `_taken`, without Python: a fold in which each cue looks at all old ones of its clip, for clips of few cues."""

    def choose(state: Column, old: Column, f: Column) -> Column:
        text = F.when(~_timed(f), plain(f))

        def wish(o: Column, k: Column) -> Column:
            n = overlap_len(f["vod_start"], f["vod_end"], o["vod_start"], o["vod_end"])
            shares = F.when(_timed(f), _timed(o) & (n >= MIN_SHARED_SEC)).otherwise(~_timed(o) & (text != "") & (o["plain"] == text))
            return F.when(shares, F.struct(F.when(_timed(f), -n).otherwise(0.0).alias("less"), k.alias("k")))

        free = F.filter(F.transform(old, wish), lambda w: w.isNotNull() & ~F.array_contains(state, w["k"]))
        return F.concat(state, F.array(F.coalesce(F.array_min(free)["k"], F.lit(-1))))

    return let(F.struct("fresh", "old"), lambda v: F.aggregate(v["fresh"], F.array().cast("array<int>"), lambda s, f: choose(s, v["old"], f)))


def _pairs(clips: DataFrame, keys: Sequence[str], plain: Callable[[Column], Column], taken: Callable = _taken) -> DataFrame:
    """Clips with the arrays `fresh` and `old` to rows `f, o, known`; a clip without fresh cues gives its old ones.

    In order of start and id a fresh cue takes the free old one that it shares the most recording time with; an old cue serves once.
    Cues without recording times are matched by equal text (`plain` gives a fresh cue's), the k-th with the k-th.
    """
    clips = clips.withColumns({"fresh": _ordered("fresh"), "old": _ordered("old")})
    kinds = clips.schema
    as_is = F.transform("old", lambda o: F.struct(F.lit(None).cast(kinds["fresh"].dataType.elementType).alias("f"), o.alias("o")))
    both = F.transform("fresh", lambda f, j: F.struct(f.alias("f"), F.get("old", F.get("_taken", j)).alias("o")))
    p = F.when(F.coalesce(F.size("fresh"), F.lit(0)) <= 0, as_is).otherwise(both)
    rest = [c for c in clips.columns if c not in (*keys, "fresh", "old")]
    rows = clips.withColumn("_taken", taken(clips, plain)).select(*keys, *rest, (F.size("old") > 0).alias("known"), F.explode_outer(p).alias("p")).where(F.col("p").isNotNull())
    return rows.select(*keys, *rest, F.coalesce("known", F.lit(False)).alias("known"), "p.f", "p.o")


def matches(old: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, cue_id, old_id`: the old cue that each fresh one takes over (see `_pairs`). Cues come together once a clip."""
    new = fresh.withColumn("plain", shown("words")).groupBy(*keys).agg(F.collect_list(F.struct("cue_id", "start", "vod_start", "vod_end", "plain")).alias("fresh"))
    clips = new.join(_old_arrays(old, keys, []), list(keys))
    rows = _pairs(clips, keys, lambda f: f["plain"]).where(F.col("f").isNotNull() & F.col("o").isNotNull())
    return rows.select(*keys, "f.cue_id", F.col("o.cue_id").alias("old_id"))


def _edits(rows: DataFrame, words: Column, plain: Column) -> tuple[Column, Column, Column]:
    """Of rows `f, o`: whether the text was edited, the old cue's words, and the fresh ones with its marks."""
    before, now = F.length("o.plain"), F.length(plain)
    edited = F.col("f").isNotNull() & (before > 0) & (F.col("o.plain") != plain) & (F.abs(before - now) <= F.greatest(F.lit(EDIT_CHARS), F.floor(now / EDIT_SHARE)))
    own = F.coalesce(F.col("o.words"), tx.parse_markup("o.text").cast(WORDS))
    # Bound, as both are made from texts and read several times.
    carried = let(F.struct(words.alias("base"), own.alias("old")), lambda v: carried_marks(v["base"], v["old"]))
    return F.coalesce(edited, F.lit(False)), own, carried


#: Text without marks, breaks or escapes; and such a text with one flagged run.
_BARE = r"[^*\\\r\n]*"
_ONE_RUN = rf"^{_BARE}\*\*[^*\\\r\n]+\*\*{_BARE}\z"


def carried_text(general: Column) -> Column:
    """Of rows `f, o`: the marked-up text of a fresh cue with the old one's marks, `general`. A bare text that meets one flagged run
    isn't taken apart: it is the old text if both read the same, else the run is marked where it first stands."""
    run = F.regexp_extract("o.text", r"\*\*([^*]+)\*\*", 1)
    at = F.position(run, F.col("f.raw"))
    marked = F.concat(F.substr("f.raw", F.lit(1), at - 1), F.lit("**"), run, F.lit("**"), F.substr("f.raw", at + F.length(run)))
    simple = F.col("o.words").isNull() & (F.col("f.text") == F.col("f.raw")) & F.col("f.raw").rlike(rf"^{_BARE}\z") & F.col("o.text").rlike(_ONE_RUN)
    same = F.replace("o.text", F.lit("**"), F.lit("")) == F.col("f.raw")
    short = F.when(same, F.col("o.text")).when(at > 0, marked).otherwise(F.col("f.text"))
    return F.when(F.coalesce(simple, F.lit(False)), short).otherwise(general)


def merge_cue_edits(old: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("vod_id", "clip_id")) -> DataFrame:
    """Fresh cues with the edits of the old cues that they replace: flags and colours, edited texts, and style columns
    that only old cues have. A clip without old cues keeps its fresh ones as they are, one without fresh cues its old ones."""
    styles = [c for c in old.columns if c not in fresh.columns]
    types = dict(fresh.dtypes)
    lone = [c for c in fresh.columns if c not in keys and c not in ("cue_id", "start", "end", "vod_start", "vod_end", "text", "words")]
    cue = F.struct(*[c for c in fresh.columns if c not in keys], shown("words").alias("plain"))
    clips = fresh.groupBy(*keys).agg(F.collect_list(cue).alias("fresh")).join(_old_arrays(old, keys, [*lone, *styles]), list(keys), "full")
    rows = _pairs(clips, keys, lambda f: f["plain"], _taken_by_columns)
    edited, own, carried = _edits(rows, F.col("f.words").cast(WORDS), F.col("f.plain"))
    alone = F.col("f").isNull()
    words = F.when(alone | edited, own).when(F.col("o.marked"), carried).otherwise(F.col("f.words").cast(WORDS))
    out = rows.withColumns({"_words": words, "_edited": edited})
    kept = F.when(F.col("known"), tx.to_markup("_words")).otherwise(F.col("f.text"))
    text = F.when(alone, F.col("o.text")).when(F.col("_edited"), F.coalesce(F.nullif(F.col("o.text"), F.lit("")), "f.text")).otherwise(kept)
    made = {"words": F.col("_words").cast(types["words"]), "text": text}
    pick = lambda c: made.get(c, F.when(alone, F.col("o")[c]).otherwise(F.col("f")[c])).alias(c)
    return out.select(*[c if c in keys else pick(c) for c in fresh.columns], *[F.col("o")[c].alias(c) for c in styles])


def rebuilt_cues(old: DataFrame, clips: DataFrame, keywords: Sequence[str], keys: Sequence[str] = ("vod_id", "clip_id")) -> DataFrame:
    """As `merge_cue_edits` for the clips of `cues.transcript_of_clips`, with their `longest`. Words are made from the text where
    they are needed only, so that what is shuffled and what most rows cost is their text."""
    columns = ["cue_id", "start", "end", "vod_start", "vod_end"]
    styles = [c for c in old.columns if c not in (*keys, *columns, "words", "text")]
    rows = _pairs(clips.drop("_axis").join(_old_arrays(old, keys, styles), list(keys), "left"), keys, lambda f: shown_text(f["raw"]))
    fresh = fresh_words("f.raw", keywords).cast(WORDS)
    edited, own, carried = _edits(rows, fresh, shown_text("f.raw"))
    alone, same = F.col("f").isNull(), ~F.coalesce(F.col("o.marked"), F.lit(False))
    words = F.when(alone | edited, own).when(same, fresh).otherwise(carried)
    text = F.when(alone, F.col("o.text")).when(edited, F.coalesce(F.nullif(F.col("o.text"), F.lit("")), "f.text")).when(same, F.col("f.text")).otherwise(carried_text(tx.to_markup(carried)))
    pick = lambda c: F.when(alone, F.col("o")[c]).otherwise(F.col("f")[c]).alias(c)
    return rows.select(*keys, "longest", *[pick(c) for c in columns], words.alias("words"), text.alias("text"), *[F.col("o")[c].alias(c) for c in styles])
