"""Equi-joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it holds more than a quarter of a mean partition's rows, so there are at most `PER_PARTITION` hot
keys for each shuffle partition: the hot list grows with the parallelism, not with the data, and may be broadcast.
Rows of a hot key are spread over as many splits as its share asks for, by a hash of the row
(so a recomputed task sends every row to the same place again); the other side is repeated per split.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_PARTITION = 4
MIN_HOT_ROWS = 200_000
SALT = "_split"


def hot_keys(
    df: DataFrame, keys: Sequence[str], *, share: float | None = None, min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Keys above the share (by default a quarter of a partition), with `_splits`: how many pieces bring each below it."""
    if share is None:
        share = 1 / (PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # partial counts before the shuffle
    limit = F.greatest(F.lit(float(min_rows)), F.lit(share) * df.agg(F.count(F.lit(1))).scalar())
    return counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_splits"))


def balanced_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[str],
    share: float | None = None,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Inner join on `keys`; `spread` names columns of `big` whose hash spreads a hot key's rows."""
    hot = hot_keys(big.select(*keys), keys, share=share, min_rows=min_rows)
    split = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_splits"), F.lit(1)))
    left = big.join(F.broadcast(hot), list(keys), "left").withColumn(SALT, split.cast("int")).drop("_splits")
    right = (
        small.join(F.broadcast(hot), list(keys), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
        .drop("_splits")
    )
    return left.join(right.hint("merge"), [*keys, SALT]).drop(SALT)
