"""Small helpers that the operators share: intermediate tables, joins with a checked size, column checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmine.session import cut_lineage

#: A side of a join is broadcast up to this many bytes; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def stored(df: DataFrame, row: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder; `row` names a column that gets a number of its own for every row.

    The numbers are drawn once, when the table is written, so a later job that loses an executor sees the
    same ones again.
    """
    if row:
        df = df.withColumn(row, F.monotonically_increasing_id())
    return cut_lineage(df)


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` with a broadcast hint where `rows` rows of `row_bytes` fit the bound, else as it is (it gets shuffled)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def parts_for(rows: int, per_part: int, most: int = 4096) -> int:
    """A power of two: how many parts of about `per_part` rows to make, `most` at most."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, rows) / per_part))))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sorted_groups(parts, keys: list[str]):
    """Runs of rows with equal keys in a sorted partition, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
