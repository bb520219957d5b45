"""Chunks: parts of a table that stay the same from scan to scan, so that what a task sent can be answered later.

A chunk is a run of rows of one file, named by the file's path and the rows' numbers in it. Splitting the file
differently doesn't change it, and a task sees a chunk's rows one after the other, so it can combine them before
anything is shuffled. A split of the file may cut through a chunk; what needs the whole chunk groups by `CHUNK`.
Tables that don't come from files are dealt into chunks by a hash of their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024
#: The column of a chunk's number, named so that it meets no column of a table.
CHUNK = "_chunk"


def with_chunk(docs: DataFrame, columns: list[str], rows: int = ROWS) -> DataFrame:
    """`columns` of `docs` and `CHUNK` (long)."""
    try:
        place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))
        return docs.select(place.alias(CHUNK), *columns)
    except AnalysisException:
        n = max(1, -(-docs.count() // rows))
        return docs.select(F.pmod(F.xxhash64(*columns), F.lit(n)).alias(CHUNK), *columns)


def by_chunk(batch: pa.RecordBatch):
    """The chunks of a batch, and the rows of each."""
    keys = batch.column(CHUNK).to_numpy()
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts) if len(keys) else []:
        yield int(keys[part[0]]), batch.take(pa.array(part))


def gathered(batches):
    """Chunks of consecutive batches; one that goes on in the next batch is put together."""
    held: tuple[int, list[pa.RecordBatch]] | None = None
    for batch in batches:
        for key, rows in by_chunk(batch):
            if held and held[0] == key:
                held[1].append(rows)
                continue
            if held:
                yield held[0], pa.Table.from_batches(held[1])
            held = (key, [rows])
    if held:
        yield held[0], pa.Table.from_batches(held[1])


def boxed(rows: DataFrame) -> DataFrame:
    """(`CHUNK`, `box`): the other columns of a chunk's rows, compressed, so that a text is shuffled at a third of its size."""

    def pack(batches):
        for key, table in gathered(batches):
            sink = pa.BufferOutputStream()
            table = table.drop_columns([CHUNK])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], [CHUNK, "box"])

    return rows.mapInArrow(pack, f"{CHUNK} long, box binary")


def unboxed(boxes: list[bytes]) -> pa.Table:
    """The rows of a chunk, whatever order its boxes came in."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in sorted(boxes)])
