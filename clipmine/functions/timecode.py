"""Seconds to text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipmine.functions.spans import col


def _pad(c: Column, width: int) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def timestamp(seconds, *, millis: bool = True, separator: str = ".") -> Column:
    """`HH:MM:SS.mmm`; negative times count as zero."""
    ms = F.rint(F.greatest(F.lit(0.0), col(seconds)) * 1000.0).cast("long")
    parts = [
        _pad(F.floor(ms / 3600000), 2), F.lit(":"),
        _pad(F.floor(ms % 3600000 / 60000), 2), F.lit(":"),
        _pad(F.floor(ms % 60000 / 1000), 2),
    ]
    if millis:
        parts += [F.lit(separator), _pad(ms % 1000, 3)]
    return F.concat(*parts)


def srt_timestamp(seconds) -> Column:
    return timestamp(seconds, separator=",")


def centisecond_timestamp(seconds) -> Column:
    """`H:MM:SS.cc`."""
    cs = F.rint(F.greatest(F.lit(0.0), col(seconds)) * 100.0).cast("long")
    return F.concat(
        F.floor(cs / 360000).cast("string"), F.lit(":"),
        _pad(F.floor(cs % 360000 / 6000), 2), F.lit(":"),
        _pad(F.floor(cs % 6000 / 100), 2), F.lit("."),
        _pad(cs % 100, 2),
    )


def parse_timestamp(text, *, strict: bool = False) -> Column:
    """`[HH:]MM:SS[.mmm]` to seconds; other input is NULL, or an error when `strict`."""
    parts = F.split(F.trim(col(text)), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    value = F.when(F.size(parts) == 2, number(0) * 60.0 + number(1)).when(
        F.size(parts) == 3, number(0) * 3600.0 + number(1) * 60.0 + number(2)
    )
    if strict:
        return F.coalesce(value, F.raise_error(F.concat(F.lit("invalid timestamp: "), col(text))).cast("double"))
    return value


def stream_date(upload_date, created_at=None) -> Column:
    """`YYYYMMDD` (else the ISO day) as `Y/M/D` without zero padding."""
    out = F.when(col(upload_date).rlike(r"^\d{8}"), _slashed(col(upload_date), r"^(\d{4})(\d{2})(\d{2})"))
    if created_at is not None:
        out = out.when(col(created_at).rlike(r"^\d{4}-\d{2}-\d{2}"), _slashed(col(created_at), r"^(\d{4})-(\d{2})-(\d{2})"))
    return out.otherwise(F.lit("--/-/--"))


def _slashed(c: Column, pattern: str) -> Column:
    return F.concat_ws("/", *[F.regexp_extract(c, pattern, i).cast("int").cast("string") for i in (1, 2, 3)])
