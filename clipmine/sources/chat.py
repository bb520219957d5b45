"""Raw live-chat dumps: whole-file JSON, one object per line, or an object of event lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine.functions.spans import let, py_round
from clipmine.functions.text import strip
from clipmine.sources.artifacts import path_part

# Fixed values, begin: renderer names that carry no chat text.
SKIPPED_RENDERERS = ("liveChatViewerEngagementMessageRenderer", "liveChatPlaceholderItemRenderer")
# Fixed values, end.


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v if isinstance(v, Column) else F.col(v), path, kind)


def _filled(doc: Column, path: str) -> Column:
    """The list at `path`; an empty one counts as missing, so that the next place is tried."""
    found = F.try_variant_get(doc, path, "array<variant>")
    return F.when(F.size(found) > 0, found)


def read_dump(spark: SparkSession, path: str, *, depth: int = 2, pattern: str = "*live*chat*") -> DataFrame:
    """Chat events of every dump below `path`: `vod_id, file, pos, item` (VARIANT).

    Files are read line by line, large ones split by byte ranges. Most dumps are one object per line and stay so.
    """
    opts = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.options(**opts).text(path)
    return parse_lines(lines.select(path_part(depth).alias("vod_id"), F.col("_metadata.file_path").alias("file"), place.alias("pos"), "value"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines of dumps (`vod_id, file, pos, value`; `pos` orders a file's lines) to one row per chat event: `vod_id, file, pos, item`.

    A file whose first line is a whole JSON value, and that has more lines, is read line by line; lines that are no JSON
    are skipped. Only the other files, documents, are put together. One that doesn't parse is read by lines after all.
    """
    filled = lines.where(F.trim("value") != "")
    files = filled.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "pos").alias("first"))
    by_line = (F.col("n") > 1) & F.try_parse_json(F.trim("first")).isNotNull()
    kinds = files.select(F.col("file").alias("_file"), by_line.alias("by_line"))
    marked = filled.join(kinds, F.col("file") == F.col("_file")).drop("_file")
    lined = marked.where("by_line").select("vod_id", "file", F.col("pos").alias("at"), F.lit(0).alias("pos"), F.try_parse_json(F.trim("value")).alias("item"))
    whole = marked.where("not by_line").groupBy("vod_id", "file").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    texts = whole.select("vod_id", "file", F.col("x")[0]["pos"].alias("at"), F.array_join("x.value", "\n").alias("value"))
    documents = texts.select("vod_id", "file", "at", F.posexplode(_items(F.col("value"), F.lit(False))).alias("pos", "item"))
    return lined.unionByName(documents).where(F.col("item").isNotNull()).select("vod_id", "file", F.struct("at", "pos").alias("pos"), "item")


def parse_dumps(files: DataFrame) -> DataFrame:
    """As `parse_lines`, for whole texts (`vod_id, file, value`)."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda ln: F.trim(ln) != "")
    # The parser stops after the first value: a whole value in the first of several lines means lines.
    first = F.try_parse_json(F.trim(F.get(lines, F.lit(0))))
    by_line = (F.size(lines) > 1) & first.isNotNull()
    return files.select("vod_id", "file", F.posexplode(_items(F.col("value"), by_line)).alias("pos", "item")).where(F.col("item").isNotNull())


def _items(value: Column, by_line: Column) -> Column:
    """The events of a whole text: of its lines if it says so or is no document; else of the list that it is or holds."""
    lines = F.filter(F.split(value, r"\r?\n"), lambda ln: F.trim(ln) != "")
    parsed = F.transform(lines, lambda ln: F.try_parse_json(F.trim(ln)))
    none = F.array().cast("array<variant>")

    def of(doc: Column) -> Column:
        lists = F.array(F.coalesce(_filled(doc, "$.events"), _filled(doc, "$.replayChatEvents"), none), F.coalesce(F.try_variant_get(doc, "$.segments", "array<variant>"), none))
        return F.when(doc.isNull(), parsed).otherwise(F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.flatten(lists)))

    return F.when(by_line, parsed).otherwise(let(F.try_parse_json(value), of))


def _runs_text(v: Column) -> Column:
    """Text of a list of runs: plain strings, or objects with `text` or `emoji`."""
    runs = F.try_variant_get(v, "$", "array<variant>")
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.coalesce(_get(r, "$.text"), _get(r, "$.emoji"), F.when(F.schema_of_variant(r) == "STRING", _get(r, "$")), F.lit("")),
        ),
        "",
    )


def _flat_text(item: Column) -> Column:
    value = F.coalesce(_get(item, "$.message", "variant"), F.coalesce(_get(item, "$.message_text", "variant"), _get(item, "$.text", "variant")))
    is_list = F.try_variant_get(value, "$", "array<variant>").isNotNull()
    is_obj = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(value.isNull(), "").when(is_list, _runs_text(value)).when(is_obj, F.coalesce(_get(value, "$.text"), F.lit(""))).otherwise(
        F.coalesce(_get(value, "$"), F.lit(""))
    )


def _flat_author(item: Column) -> Column:
    value = F.coalesce(_get(item, "$.author", "variant"), _get(item, "$.author_name", "variant"))
    is_obj = F.schema_of_variant(value).startswith("OBJECT")
    named = F.coalesce(F.nullif(_get(value, "$.name"), F.lit("")), _get(value, "$.display_name"), F.lit(""))
    return F.when(value.isNull(), "").when(is_obj, named).otherwise(F.coalesce(_get(value, "$"), F.lit("")))


def _flat_time(item: Column) -> Column:
    keys = ("time_in_seconds", "timestamp", "t", "offset")
    return F.coalesce(*[_get(item, f"$.{k}", "double") for k in keys], _get(item, "$.tStartMs", "double") / 1000.0)


def normalise(events: DataFrame) -> DataFrame:
    """Chat events to `vod_id, seq, t, author, message` in one projection; unusable ones are dropped.

    A nested replay action gives its first usable message; its time is the action's offset unless the
    renderer has its own.
    """
    usable = lambda m: m["t"].isNotNull() & (m["message"] != "")
    kind = "struct<t: double, author: string, message: string>"
    said = lambda t, author, message: F.struct(t.alias("t"), author.alias("author"), strip(message).alias("message")).cast(kind)

    def rendered(action: Column) -> Column:
        t0 = _get(action, "$.videoOffsetTimeMsec", "double") / 1000.0
        items = F.transform(
            F.coalesce(F.try_variant_get(action, "$.actions", "array<variant>"), F.array().cast("array<variant>")),
            lambda act: F.coalesce(F.map_entries(F.try_variant_get(act, "$.addChatItemAction.item", "map<string,variant>")), F.array().cast("array<struct<key: string, value: variant>>")),
        )
        shown = F.filter(F.flatten(items), lambda e: e["key"].endswith("Renderer") & ~e["key"].isin(*SKIPPED_RENDERERS))

        def message(e: Column) -> Column:
            body = e["value"]
            runs = F.coalesce(F.nullif(_runs_text(_get(body, "$.message.runs", "variant")), F.lit("")), _runs_text(_get(body, "$.headerSubtext.runs", "variant")))
            return said(F.coalesce(_get(body, "$.videoOffsetTimeMsec", "double") / 1000.0, t0), F.coalesce(_get(body, "$.authorName.simpleText"), F.lit("")), runs)

        return F.get(F.filter(F.transform(shown, message), usable), F.lit(0))

    def read(item: Column) -> Column:
        action = _get(item, "$.replayChatItemAction", "variant")
        return F.when(action.isNotNull(), rendered(action)).otherwise(said(_flat_time(item), _flat_author(item), _flat_text(item)))

    rows = events.select("vod_id", F.struct("file", "pos").alias("seq"), let(F.col("item"), read).alias("m"))
    return rows.where(usable(F.col("m"))).select("vod_id", "seq", "m.t", "m.author", "m.message")


def deduplicate(chat: DataFrame) -> DataFrame:
    """One row per (time to 0.01 s, author, message): the first by `seq`.

    A plain aggregate: copies are combined before the shuffle, so a flood of equal messages stays cheap.
    Order by `t, seq` where order matters.
    """
    key = ["vod_id", "author", "message", py_round("t", 2).alias("_t2")]
    return (
        chat.groupBy(*key)
        .agg(F.min("seq").alias("seq"), F.min_by("t", "seq").alias("t"))
        .select("vod_id", "seq", "t", "author", "message")
    )
