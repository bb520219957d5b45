"""Weights, dictionaries and channel settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.functions.text import slug
from clipmine.lexicon import PROFILES, Profile, load_profile


def load_dictionary(path: str | Path) -> dict[str, str]:
    file = Path(path)
    if not file.is_file():
        return {}
    data = json.loads(file.read_text("utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"dictionary must be a mapping: {file}")
    return {str(k): str(v) for k, v in data.items()}


def profiles(folder: str | Path | None = None) -> dict[str, Profile]:
    """Profiles per content type; `weights_<type>.yaml` files in `folder` replace the built-in ones."""
    out = dict(PROFILES)
    for kind in out:
        file = Path(folder or "") / f"weights_{kind}.yaml"
        if folder and file.is_file():
            out[kind] = load_profile(file, kind)
    return out


def channel_overrides(vods: DataFrame, channels: DataFrame) -> DataFrame:
    """Settings of each recording's channel: by id, its slug, name, its slug, else `default`.

    `channels` has one row per settings file: `name` and any settings columns.
    """
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    tries = vods.select(
        "vod_id",
        F.posexplode(
            F.array(named("channel_id"), slug(named("channel_id")), named("channel"), slug(named("channel")), F.lit("default"))
        ).alias("prio", "name"),
    ).where(F.col("name").isNotNull())
    settings = [c for c in channels.columns if c != "name"]
    best = (
        tries.join(channels, "name").groupBy("vod_id").agg(F.min_by(F.struct("name", *settings), "prio").alias("_c"))
    )
    return vods.join(best, "vod_id", "left").select(
        "vod_id", F.col("_c.name").alias("channel_config"), *[F.col("_c")[s].alias(s) for s in settings]
    )


def alias_of(urls: DataFrame, aliases: DataFrame, *, url: str = "url") -> DataFrame:
    """Add `alias`: the first known video id contained in the URL (`aliases`: `ord, video_id, alias`).

    Ids are looked up by equality after cutting the URL into its id-like pieces, not by testing every
    id against every URL. Each id keeps its first alias before that, so an id listed many times meets a URL once.
    """
    first = aliases.groupBy("video_id").agg(F.min("ord").alias("ord"), F.min_by("alias", "ord").alias("alias"))
    pieces = urls.select(url, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(url), F.lit("")), F.lit(r"[A-Za-z0-9_-]{6,}"), 0))).alias("video_id"))
    hit = pieces.distinct().join(first, "video_id").groupBy(url).agg(F.min_by("alias", "ord").alias("alias"))
    return urls.join(hit, url, "left")
