"""Column arithmetic on (start, end) spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` (a lambda would repeat it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_round(c: Column | str, digits: int) -> Column:
    """Half-even rounding, as the source data was rounded."""
    return F.bround(col(c), digits)


def overlap_len(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def overlaps(a0, a1, b0, b1) -> Column:
    """Open overlap: touching spans do not overlap."""
    return (col(a0) < col(b1)) & (col(b0) < col(a1))


def iou(a0, a1, b0, b1) -> Column:
    """Intersection over the hull of both spans; 0 when they do not intersect."""
    inter = overlap_len(a0, a1, b0, b1)
    hull = F.greatest(col(a1), col(b1)) - F.least(col(a0), col(b0))
    return F.when((inter <= 0) | (hull <= 0), F.lit(0.0)).otherwise(inter / hull)


def clamp(c, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, col(c)))


def clamp_end(start, end, max_sec) -> Column:
    """New end of a span that may not be longer than `max_sec` (nor negative)."""
    e = F.greatest(col(start), col(end))
    limit = max_sec if isinstance(max_sec, Column) else F.lit(float(max_sec))
    return F.when(e - col(start) > limit, col(start) + limit).otherwise(e)


def hour_of(t) -> Column:
    return F.floor(col(t) / 3600.0).cast("int")


def hour_count(duration) -> Column:
    d = col(duration)
    return F.when(d <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(d / 3600.0).cast("int")))


def effective_duration(duration, max_hours=None) -> Column:
    d = col(duration).cast("double")
    if max_hours is not None:
        h = max_hours if isinstance(max_hours, Column) else F.lit(float(max_hours))
        d = F.least(d, h * 3600.0)  # `least` skips NULL: no cap set
    return F.greatest(F.lit(0.0), d)


def effective_content_type(configured, stream_type) -> Column:
    c, s = col(configured), col(stream_type)
    return (
        F.when(c.isNotNull() & (c != "") & (c != "auto"), c)
        .when(s.isin("talk", "game"), s)
        .otherwise(F.lit("talk"))
    )


def shake_duration(score) -> Column:
    return clamp(0.5 + 0.15 * col(score), 0.55, 1.40)


def shake_cycles(score) -> Column:
    return clamp(F.rint(2 + 0.8 * col(score)), 3.0, 8.0).cast("int")
