"""Reproducible shards by a Feistel permutation over global row numbers.

Rows get the numbers 0 .. n-1 in an order that depends on their key alone. A Feistel network over the smallest
even number of bits that holds n, applied again while its result is not below n (cycle walking), permutes them:
position p lies in shard p mod shards at slot p div shards. Both are computable from a row number, and the
inverse gives the row number of any shard and slot, without a table.

Defined cases: null keys are numbered as a value of their own; rows equal in every column get neighbouring
numbers; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.llm.words import mix

#: Buckets of the numbering: fixed, so that numbers don't depend on the cluster. Their counts are a small table.
BUCKETS = 16_384
ROUNDS = 6
#: Rows that are equal in every column are written out by at most so many at a time.
RUN = 65_536


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, seed: int, rounds) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for r in rounds[0]:
        if rounds[1]:
            left, right = right ^ (mix(left, seed * ROUNDS + r) & mask), left
        else:
            left, right = right, left ^ (mix(right, seed * ROUNDS + r) & mask)
    return (left << np.uint64(bits)) | right


def permute(x: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The place of each number of `x` (all below n) in the permutation of 0 .. n-1, or the way back."""
    out = np.asarray(x).astype(np.uint64)
    rounds = (range(ROUNDS)[::-1], True) if inverse else (range(ROUNDS), False)
    out = _network(out, _half_bits(n), seed, rounds)
    while len(at := np.flatnonzero(out >= np.uint64(n))):
        out[at] = _network(out[at], _half_bits(n), seed, rounds)
    return out.astype(np.int64)


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `number`, 0 .. n-1, and `total`, n. The order is that of a hash of all columns, then the columns."""
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    sizes = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    offsets = sizes.select(
        "_bucket",
        (F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    first = counted.withColumn("_first", F.sum("_copies").over(inside) - F.col("_copies")).join(F.broadcast(offsets), "_bucket")
    run = first.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN).cast("long"))))
    each = run.withColumn("_copy", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN - 1, F.col("_copies") - 1))))
    return each.select(*names, (F.col("_offset") + F.col("_first") + F.col("_copy")).alias("number"), "total")


def sharded(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """`rows` with `number`, `position`, `shard` (0 .. shards-1) and `slot` (gapless from 0 in each shard)."""

    @F.pandas_udf("long")
    def place(number: pd.Series, total: pd.Series) -> pd.Series:
        if not len(number):
            return pd.Series([], dtype="int64")
        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]), seed))

    return (
        numbered(rows)
        .withColumn("position", place("number", "total"))
        .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("position") / shards).cast("long"))
        .drop("total")
    )


def number_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in this shard at this slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def write_shards(rows: DataFrame, path: str, shards: int, columns: list[str]) -> None:
    """Write `rows` (from `sharded`) as one folder per shard, in slot order."""
    placed = rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    placed.select(*reduce(lambda a, c: a if c in a else [*a, c], ["shard", "slot"], list(columns))).write.partitionBy("shard").parquet(path)
