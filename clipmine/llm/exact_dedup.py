"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

Texts are equal when their characters other than `[\\x20\\x09-\\x0D]` are. Every sender (a part of the rows)
sorts the fingerprints of its rows and sends each owner of a range of fingerprints the distinct ones of that
range, Golomb-Rice coded. An owner answers with a bitmap per sender: which of its fingerprints another sender
has too. Only rows whose fingerprint is answered, or repeated inside their sender, are suspects; only their texts
are shuffled and compared byte by byte. A fingerprint held by a third of all rows costs each sender one number.

Defined cases: a null text counts as empty; rows that repeat a doc_id count one by one and one of them stays;
an empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.llm import rice
from clipmine.llm.tables import parts_for, sized, stored, text_or_empty
from clipmine.llm.words import release

SPACE = b"\t\n\x0b\x0c\r "
ROWS_PER_SENDER = 65_536


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, `fp` (64 bits), `sha` (SHA-256 of the normalised bytes), `points` (code points)."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            shas = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(None, SPACE)).digest() for t in texts]
            fp = np.frombuffer(b"".join(shas), "<i8").reshape(-1, 4)[:, 0]
            points = [len(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(fp, pa.int64()), pa.array(shas, pa.binary()), pa.array(points, pa.int64())],
                ["doc_id", "fp", "sha", "points"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long, sha binary, points long")


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    return np.unique(fp, return_inverse=True, return_counts=True)


def suspects(rows: DataFrame, bits: int) -> DataFrame:
    """`rows` (`fp`, `sender`, ...) with `suspect`: whether another row has the same fingerprint."""

    def bounds(values: np.ndarray) -> np.ndarray:
        owner = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        return np.searchsorted(owner, np.arange((1 << bits) + 1))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        values = _distinct(table)[0]
        cut = bounds(values)
        full = np.flatnonzero(np.diff(cut))
        out = pa.table(
            {
                "owner": pa.array(full, pa.int32()),
                "sender": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "coded": pa.array([rice.encode(values[cut[o] : cut[o + 1]]) for o in full], pa.binary()),
            }
        )
        del values
        release()
        return out

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        lists = [rice.decode(x) for x in table.column("coded").to_pylist()]
        twice = rice.seen_twice(lists)
        found = pa.array([rice.bitmap(rice.member(x, twice)) for x in lists], pa.binary())
        del lists, twice
        release()
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "answer": found})

    def mark(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        values, inverse, counts = _distinct(table)
        cut, found = bounds(values), counts > 1
        for o, data in zip(answers.column("owner").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            found[cut[o] : cut[o + 1]] |= rice.flags(data, cut[o + 1] - cut[o])
        marks = pa.array(found[inverse], pa.bool_())
        del values, inverse, counts, found
        release()
        return table.append_column("suspect", marks)

    messages = rows.select("sender", "fp").groupBy("sender").applyInArrow(send, "owner int, sender int, coded binary")
    answers = messages.groupBy("owner").applyInArrow(answer, "sender int, owner int, answer binary")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", suspect boolean"
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(mark, schema)


def verified(docs: DataFrame, which: DataFrame, n: int) -> DataFrame:
    """Per `sha` of the texts of `which` (n rows with doc_id): `texts`, how many different normalised texts have it."""
    keys = which.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    bytes_of = F.translate(text_or_empty(), SPACE.decode(), "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text")).join(sized(keys, n, 16), "doc_id", "left_semi")
    same = texts.select(bytes_of.alias("bytes")).groupBy("bytes").agg(F.count(F.lit(1)).alias("rows"))
    return same.groupBy(F.unhex(F.sha2("bytes", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("texts"))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id. Should two
    different texts share a SHA-256, the job fails rather than drop one.
    """
    base = stored(fingerprints(docs), "row")
    n = base.count()
    senders = parts_for(n, ROWS_PER_SENDER)
    rows = base.withColumn("sender", F.pmod(F.xxhash64("row"), F.lit(senders)).cast("int"))
    marked = stored(suspects(rows, senders.bit_length() - 1).drop("sender"))
    hot = marked.where("suspect")
    groups = hot.groupBy("fp", "sha").agg(
        F.max(F.struct("points", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    checked = groups.join(verified(docs, hot, hot.count()), "sha", "left").select(
        "fp",
        "sha",
        (-F.col("best.minus_id")).alias("keep_id"),
        (-F.col("best.minus_row")).alias("keep_row"),
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
    )
    grouped = hot.join(checked, ["fp", "sha"]).select("doc_id", "sha", "keep_id", (F.col("row") == F.col("keep_row")).alias("kept"), "group_size", "row")
    alone = marked.where(~F.col("suspect")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("group_size"), "row")
    return grouped.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat a doc_id and text, one."""
    found = stored(duplicates(docs).select(F.col("doc_id").alias("_exact_id"), F.col("text_sha256").alias("_exact_sha"), "kept"))
    stay = found.where("kept").select(F.col("_exact_id").alias("stay_id"), F.col("_exact_sha").alias("stay_sha"))
    here = F.col("_exact_id").eqNullSafe(F.col("stay_id")) & (F.col("_exact_sha") == F.col("stay_sha"))
    gone = found.where(~F.col("kept")).select("_exact_id", "_exact_sha").distinct()
    out, repeated = stored(gone.join(stay, here, "left_anti")), stored(gone.join(stay, here, "left_semi"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_exact_id")) & (F.sha2(F.translate(text_or_empty(), SPACE.decode(), ""), 256) == F.col("_exact_sha"))
    rows = docs.join(sized(out, out.count(), 96), same, "left_anti")
    if not (n := repeated.count()):
        return rows
    twice = sized(repeated, n, 96)
    one = rows.join(twice, same, "inner").dropDuplicates(["_exact_id", "_exact_sha"]).select(*docs.columns)
    return rows.join(twice, same, "left_anti").unionByName(one)
