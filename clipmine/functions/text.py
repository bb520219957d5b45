"""Text column builders: everything here compiles to JVM expressions."""

from __future__ import annotations

import re
from functools import partial, reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmine import lexicon
from clipmine.functions.spans import col, let

DEFAULT_TITLE = "精華片段"


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def strip(c) -> Column:
    """Trim every kind of white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def replace_words(c, dictionary: Mapping[str, str]) -> Column:
    """Literal replacements, longest key first; later keys see earlier output."""
    keys = sorted((k for k in dictionary if k), key=len, reverse=True)
    return reduce(lambda acc, k: F.replace(acc, F.lit(k), F.lit(dictionary[k])), keys, col(c))


def keyword_hits(c, keywords: Sequence[str]) -> Column:
    """Non-overlapping, case-insensitive literal occurrences, summed over the keywords."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    needles = [str(k).lower() for k in keywords if str(k)]
    terms = [
        F.floor((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)) for k in needles
    ]
    return reduce(lambda a, b: a + b, terms, F.lit(0)).cast("long")


def contains_any(c, keywords: Sequence[str], default: Sequence[str] = ()) -> Column:
    """True when the text holds one of the keywords (the default list when none are given)."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    return _any(low.contains(str(k).lower()) for k in (keywords or default))


def title(text, max_chars: int = 20) -> Column:
    bare = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", "")
    return F.when(bare == "", F.lit(DEFAULT_TITLE)).otherwise(F.left(bare, F.lit(max_chars)))


def hook(title_col) -> Column:
    return F.concat(F.lit("「當"), col(title_col), F.lit("…」"))


def excerpt(text, max_chars: int = 800) -> Column:
    c = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(c) > max_chars, F.concat(F.left(c, F.lit(max_chars - 1)), F.lit("…"))).otherwise(c)


def fixed(c, digits: int) -> Column:
    """A number that isn't negative as text, rounded by its exact binary value (a tie to even), as `printf` does.

    `format_string` rounds the shortest decimal instead: 0.015 lies below the tie and is `0.01` here, `0.02` there.
    """
    x = col(c).cast("double")
    unit = F.lit(2**62).cast("decimal(20,0)")
    # The fraction in units of 2^-62: exact, since scaling by a power of two is.
    parts = F.struct(F.floor(x).cast("long").alias("whole"), ((x - F.floor(x)) * float(2**62)).cast("long").alias("part"))

    def text(v: Column) -> Column:
        scaled = v["part"].cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(7,0)")
        down = F.call_function("div", scaled, unit)
        twice = (scaled - down.cast("decimal(20,0)") * unit) * F.lit(2).cast("decimal(1,0)")
        up = (twice > unit) | ((twice == unit) & (down % 2 == 1))
        n = down + up.cast("long")
        carry = n >= 10**digits
        kept = F.when(carry, n - 10**digits).otherwise(n)
        return F.concat((v["whole"] + carry.cast("long")).cast("string"), F.lit("."), F.lpad(kept.cast("string"), digits, "0"))

    # From 2^53 on there is no fraction.
    return F.when(x < float(2**53), let(parts, text)).otherwise(F.format_string(f"%.{digits}f", x))


def reason(
    *, chat_density, chat_react, chat_cue, mean_zscore, keyword_hits, chat_kw_hits, emotion_score, speech_ratio
) -> Column:
    """Why a window scored: the non-zero features, in a fixed order."""
    part = lambda c, name, digits, unit="": F.when(col(c) > 0, F.concat(F.lit(name + " "), fixed(c, digits), F.lit(unit)))
    count = lambda c, name: F.when(col(c) > 0, F.concat(F.lit(name + " "), col(c).cast("string")))
    return F.concat_ws(
        "、",
        part(chat_density, "彈幕密度", 3, "/s"),
        part(chat_react, "彈幕反應", 2),
        part(chat_cue, "剪輯 cue", 1),
        part(mean_zscore, "音量 z", 2),
        count(keyword_hits, "字幕關鍵字"),
        count(chat_kw_hits, "彈幕關鍵字"),
        part(emotion_score, "情緒峰值", 2),
        F.concat(F.lit("語音占比 "), fixed(speech_ratio, 2)),
    )


# --- bigrams -------------------------------------------------------------------------------------


def only_chars(c, char_class: str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), f"(?U)[^{char_class}]", "")


WORD_CHARS = lexicon.CJK + r"\p{IsAlphabetic}\p{N}"


def bigrams(c, *, char_class: str | None = None, keep_single: bool = False) -> Column:
    """Distinct adjacent character pairs; `keep_single` keeps a one-character text as its own element."""
    s = only_chars(c, char_class) if char_class else F.coalesce(col(c), F.lit(""))
    # A look-ahead takes a pair at every character, in one pass of the pattern engine.
    pairs = F.array_distinct(F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1)))
    return F.when(F.length(s) == 1, F.array(s)).otherwise(pairs) if keep_single else pairs


def characters(c) -> Column:
    """The text as an array of its characters."""
    return F.filter(F.split(col(c), ""), lambda ch: ch != "")


def alignment_bigrams(c) -> Column:
    """Bigrams of the lower-cased text without white space."""
    return bigrams(F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", "")), keep_single=True)


def jaccard(a, b) -> Column:
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union
    )


# --- subtitle text -------------------------------------------------------------------------------


def plain_chars(c) -> Column:
    """Characters that are shown: blanks and line breaks do not count."""
    return F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), r" |\n|\\N", ""))


def chars_per_second(text, start, end) -> Column:
    return plain_chars(text) / F.greatest(F.lit(0.05), col(end) - col(start))


def front_loaded(words, start, end, frac: float = 0.30) -> Column:
    """At least four words, and 75 % of their time lies in the first `frac` of the segment."""
    kept = F.filter(F.coalesce(col(words), F.array()), lambda w: strip(w["text"]) != "")
    s = col(start)
    cutoff = s + F.greatest(F.lit(0.05), col(end) - s) * frac
    length = lambda w: F.greatest(w["start"], w["end"]) - w["start"]
    middle = lambda w: (w["start"] + F.greatest(w["start"], w["end"])) * 0.5

    def test(ws):
        total = F.aggregate(ws, F.lit(0.0), lambda a, w: a + length(w))
        front = F.aggregate(ws, F.lit(0.0), lambda a, w: a + F.when(middle(w) <= cutoff, length(w)).otherwise(0.0))
        return (F.size(ws) >= 4) & (total > 1e-6) & (F.try_divide(front, total) >= 0.75)

    return F.coalesce(let(kept, test), F.lit(False))


def is_noise(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\\N| ", "").rlike(lexicon.NOISE_ONLY)


def parse_words(words) -> Column:
    """Word payloads (`word` or `text`, loose times) to `start, end, text`; empty text dropped."""
    fixed = F.transform(
        F.coalesce(col(words), F.array()),
        lambda w: F.struct(
            F.coalesce(w["start"], F.lit(0.0)).alias("start"),
            F.greatest(F.coalesce(w["start"], F.lit(0.0)), F.coalesce(w["end"], w["start"], F.lit(0.0))).alias("end"),
            strip(F.coalesce(F.nullif(w["word"], F.lit("")), w["text"])).alias("text"),
        ),
    )
    return F.filter(fixed, lambda w: w["text"] != "")


# --- content words and emphasis ------------------------------------------------------------------

_NOT_WORD = r"^[\W_0-9]+$"


def is_content_word(c, stop_words: Sequence[str] = lexicon.STOP_WORDS) -> Column:
    s = strip(c)
    return (
        (s != "") & ~s.isin(*stop_words) & (F.length(s) >= 2) & ~s.rlike("(?U)" + _NOT_WORD)
    )


def keep_content_words(words: Iterable[str], stop_words: Sequence[str] = lexicon.STOP_WORDS) -> list[str]:
    """The same predicate for a driver-side keyword list; order kept, duplicates dropped."""
    stop = set(stop_words)
    clean = dict.fromkeys(str(w).strip() for w in words)
    return [w for w in clean if w and w not in stop and len(w) >= 2 and not re.match(_NOT_WORD, w)]


def longest_first(keywords: Iterable[str]) -> list[str]:
    return sorted(keywords, key=len, reverse=True)


def key_span(plain, keywords: Sequence[str], tokens=None, *, max_len: int = 6) -> Column:
    """The span to emphasise: `struct(offset, frag, kind)`; NULL when there is none.

    The longest listed keyword of at most `max_len` characters wins, else the longest content
    token. `tokens` is an array column of the segmenter's tokens; single characters never qualify.
    """
    text = F.coalesce(col(plain), F.lit(""))
    span = lambda offset, frag: F.struct(
        offset.cast("int").alias("offset"),
        frag.alias("frag"),
        F.when((offset == 0) & (F.length(text) > F.length(frag)), "head")
        .when((offset > 0) & (offset + F.length(frag) == F.length(text)), "tail")
        .otherwise("mid")
        .alias("kind"),
    )
    out = None
    for k in longest_first(keep_content_words(keywords)):
        if len(k) > max_len:
            continue
        hit = F.instr(text, k)
        value = span(hit - 1, F.lit(k))
        out = F.when(hit > 0, value) if out is None else out.when(hit > 0, value)
    if tokens is not None:
        fitting = F.filter(col(tokens), lambda t: is_content_word(t) & (F.length(t) <= max_len))
        longest = F.array_max(F.transform(fitting, lambda t: F.length(t)))
        best = F.get(F.filter(fitting, lambda t: F.length(t) == longest), F.lit(0))
        hit = F.position(best, text)
        value = span(hit - 1, best)
        out = F.when(best.isNotNull(), value) if out is None else out.when(best.isNotNull(), value)
    return out if out is not None else F.lit(None)


def emphasis_reason(plain, keywords: Sequence[str], tokens=None) -> Column:
    """`keyword`, `word` or NULL."""
    text = F.coalesce(col(plain), F.lit(""))
    out = F.when(_any(text.contains(k) for k in keep_content_words(keywords)), F.lit("keyword"))
    if tokens is not None:
        out = out.when(F.exists(col(tokens), is_content_word), F.lit("word"))
    return out


def keywords_in(text, keywords: Sequence[str], n: int = 2) -> Column:
    """The first `n` content keywords found in the text, longest first."""
    ordered = longest_first(keep_content_words(keywords))
    hits = F.array(*[F.when(F.coalesce(col(text), F.lit("")).contains(k), F.lit(k)) for k in ordered])
    return F.slice(F.array_compact(hits), 1, n)


# --- markup --------------------------------------------------------------------------------------


def _mark(text, is_kw, color=None) -> Column:
    c = color if color is not None else F.lit(None).cast("string")
    return F.struct(text.alias("text"), is_kw.alias("is_kw"), c.alias("color"))


def parse_markup(text) -> Column:
    """`a**bc**` to one element per character, `bc` flagged; a break is never flagged."""
    raw = F.replace(F.coalesce(col(text), F.lit("")), F.lit("\\n"), F.lit("\n"))
    marked = lambda t: (F.length(t) > 4) & t.startswith("**") & t.endswith("**")

    def with_marks(r):
        tokens = F.regexp_extract_all(r, F.lit(r"(?s)(\*\*[^\n]+?\*\*|.)"), 1)
        return F.flatten(
            F.transform(
                tokens,
                lambda t: F.when(
                    marked(t),
                    F.transform(characters(F.substr(t, F.lit(3), F.length(t) - 4)), lambda ch: _mark(ch, F.lit(True))),
                ).otherwise(F.array(_mark(t, F.lit(False)))),
            )
        )

    def parse(r):
        chars = F.when(r.contains("**"), with_marks(r)).otherwise(F.transform(F.split(r, ""), lambda ch: _mark(ch, F.lit(False))))
        return F.when(r.contains("\r"), F.filter(chars, lambda w: w["text"] != "\r")).when(r == "", F.slice(chars, 1, 0)).otherwise(chars)

    return let(raw, parse)


def to_markup(words) -> Column:
    """Inverse of `parse_markup`: `**` around each run of flagged words."""
    kept = F.filter(F.coalesce(col(words), F.array()), lambda w: F.coalesce(w["text"], F.lit("")) != "")

    shown = lambda w: F.when(w["text"] == "\n", F.lit("\\n")).otherwise(w["text"])

    def render(ws):
        flags = F.transform(ws, lambda w: F.coalesce(w["is_kw"] & (w["text"] != "\n"), F.lit(False)))
        at = lambda fs, i: F.coalesce(F.get(fs, i), F.lit(False))

        def word(fs, w, i):
            return F.when(at(fs, i), F.concat(F.when(at(fs, i - 1), "").otherwise(F.lit("**")), w["text"], F.when(at(fs, i + 1), "").otherwise(F.lit("**")))).otherwise(shown(w))

        marked = let(flags, lambda fs: F.array_join(F.transform(ws, lambda w, i: word(fs, w, i)), ""))
        return F.when(F.exists(ws, lambda w: F.coalesce(w["is_kw"], F.lit(False))), marked).otherwise(F.array_join(F.transform(ws, shown), ""))

    return let(kept, render)


def words_text(words) -> Column:
    return F.array_join(F.transform(F.coalesce(col(words), F.array()), lambda w: F.coalesce(w["text"], F.lit(""))), "")


def mark_keywords(words, keywords: Sequence[str]) -> Column:
    """Flag every word that touches a keyword occurrence (occurrences of one keyword do not overlap)."""
    needles = longest_first(k for k in keywords if k)
    if not needles:
        return col(words)

    def hits(plain):
        """A character per position: U+0001 where any keyword occurrence lies."""
        masks = characters(F.replace(plain, F.lit(needles[0]), F.lit("\u0001" * len(needles[0]))))
        def with_other(m, k):
            other = characters(F.replace(plain, F.lit(k), F.lit("\u0001" * len(k))))
            return F.when(plain.contains(k), F.zip_with(m, other, lambda a, b: F.when(b == "\u0001", b).otherwise(a))).otherwise(m)

        for k in needles[1:]:
            both = partial(with_other, k=k)
            masks = let(masks, lambda m: both(m))
        return masks

    size = lambda w: F.length(F.coalesce(w["text"], F.lit("")))

    def by_slots(ws, found):
        # A word fills its characters and one slot more; its first slot, less the words before, is where it starts.
        slots = F.flatten(F.transform(ws, lambda w, i: F.array_repeat(i, size(w) + 1)))
        starts = let(
            slots,
            lambda o: F.when(F.size(o) > 0, F.transform(
                F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda p: (p == 0) | (F.get(o, p) != F.get(o, p - 1))), lambda p, i: p - i
            )).otherwise(F.array().cast("array<int>")),
        )
        touched = lambda v, w, i: F.exists(F.slice(v["hits"], F.get(v["starts"], i) + 1, size(w)), lambda h: h == "\u0001")
        return let(
            F.struct(found.alias("hits"), starts.alias("starts")),
            lambda v: F.transform(ws, lambda w, i: _mark(w["text"], w["is_kw"] | touched(v, w, i), w["color"])),
        )

    def mark(ws):
        def marked(plain):
            # Words of one character each, as parsed texts have them, stand at their own places.
            single = lambda m: (F.size(m) == F.size(ws)) & ~F.exists(ws, lambda w: size(w) != 1)
            at_place = lambda m: F.zip_with(ws, m, lambda w, h: _mark(w["text"], w["is_kw"] | (h == "\u0001"), w["color"]))
            some = _any(plain.contains(k) for k in [*needles, "\u0001"])
            return F.when(~some, ws).otherwise(let(hits(plain), lambda m: F.when(single(m), at_place(m)).otherwise(by_slots(ws, m))))

        return let(words_text(ws), marked)

    return let(col(words), mark)


def strip_tags(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\{[^}]*\}", "")


def leading_tags(c) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"^((?:\{[^}]*\})*)", 1)


def without_leading_tags(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^(?:\{[^}]*\})+", "")


def wrap_span(payload, offset, frag, open_tag: str, close_tag: str) -> Column:
    """Put tags around the fragment found at `offset` of the text without line breaks.

    Breaks (`\\N` or a newline) stay where they are, also inside the fragment.
    """
    is_break = lambda u: (u == "\\N") | (u == "\n")
    first, last = col(offset), col(offset) + F.length(col(frag)) - 1

    def render(units):
        text = F.filter(F.sequence(F.lit(0), F.size(units) - 1), lambda i: ~is_break(F.get(units, i)))
        part = lambda lo, n: F.array_join(F.slice(units, lo + 1, n), "")
        return let(
            F.struct(F.get(text, first).alias("a"), F.get(text, last).alias("b")),
            lambda at: F.concat(
                part(F.lit(0), at["a"]), F.lit(open_tag), part(at["a"], at["b"] - at["a"] + 1), F.lit(close_tag),
                part(at["b"] + 1, F.greatest(F.lit(0), F.size(units) - at["b"] - 1)),
            ),
        )

    return let(F.regexp_extract_all(col(payload), F.lit(r"(?s)(\\N|.)"), 1), render)


# --- titles, errors, urls ------------------------------------------------------------------------


def stream_type(title_col) -> Column:
    low = F.lower(F.coalesce(col(title_col), F.lit("")))
    return (
        F.when(_any(low.contains(k) for k in lexicon.GAME_TITLE_WORDS), F.lit("game"))
        .when(_any(low.contains(k) for k in lexicon.TALK_TITLE_WORDS), F.lit("talk"))
        .otherwise(F.lit("unknown"))
    )


def chat_error_kind(message) -> Column:
    low = F.lower(F.coalesce(col(message), F.lit("")))
    has = lambda *needles: _any(low.contains(n) for n in needles)
    return (
        F.when(has("timeout", "timed out"), "timeout")
        .when(has("no chat", "chat not found", "disabled"), "no_chat")
        .when(has("members only", "membership"), "members")
        .when(has("age") & has("restrict"), "age_restricted")
        .when(has("parse", "json", "decode", "initial video data"), "parse")
        .when(has("cookie"), "cookies")
        .when(has("http", "403", "401", "429"), "http")
        .otherwise("unknown")
    )


def chat_error_hint(kind, *, had_cookies=None, had_js_runtime=None) -> Column:
    """The error kind, with `;hint=…` when something can be done about it."""
    k = col(kind)
    cookies = col(had_cookies) if had_cookies is not None else F.lit(False)
    runtime = col(had_js_runtime) if had_js_runtime is not None else F.lit(False)
    hints = F.concat_ws(
        "+",
        F.when(
            ~cookies
            & k.isin("http", "members", "age_restricted", "parse", "no_chat", "unknown", "timeout", "cookies"),
            lexicon.CHAT_HINTS["cookies"],
        ),
        F.when((k == "parse") & ~runtime, lexicon.CHAT_HINTS["runtime"]),
        F.when(k.isin("parse", "no_chat", "http", "cookies"), lexicon.CHAT_HINTS["review"]),
    )
    return F.when(hints == "", k).otherwise(F.concat(k, F.lit(";hint="), hints))


def video_id(url) -> Column:
    """The `v` query value, else the last path element, else `unknown`."""
    u = F.coalesce(col(url), F.lit(""))
    v = F.regexp_extract(u, r"[?&]v=([^&#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(v != "", v).when(last != "", last).otherwise(F.lit("unknown"))


def slug(c) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)[^\w\-]+", "_"), r"^_+|_+$", ""))
    return F.when(s == "", F.lit("unknown")).otherwise(s)
