"""Result sinks. Everything is written by partitions of the result, never through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipmine.functions.text import strip
from clipmine.functions.timecode import srt_timestamp


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite", buckets: int = 64, files: int = 4) -> None:
    """Folders by a hash of the recording, up to `files` files each, clustered by recording.

    The number of folders and files doesn't depend on the number of recordings or tasks; a recording with a large
    share of the rows is spread over the files of its folder.
    """
    bucket, part = F.pmod(F.xxhash64("vod_id"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(*df.columns), F.lit(files))
    placed = df.withColumn("vod_bucket", bucket).repartition(buckets * files, "vod_bucket", part).sortWithinPartitions("vod_bucket", "vod_id")
    placed.write.mode(mode).partitionBy("vod_bucket").format(fmt).save(path)


def first_candidates(candidates: DataFrame, n: int = 200) -> DataFrame:
    w = Window.partitionBy("vod_id").orderBy("candidate_id")
    return candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def srt_blocks(segments: DataFrame) -> DataFrame:
    """One subtitle block per segment: `vod_id, seg_id, block`."""
    return segments.select(
        "vod_id", "seg_id",
        F.concat(
            F.col("seg_id").cast("string"), F.lit("\n"), srt_timestamp("start"), F.lit(" --> "), srt_timestamp("end"),
            F.lit("\n"), strip("text"), F.lit("\n"),
        ).alias("block"),
    )


def write_srt(segments: DataFrame, path: str, *, buckets: int = 64) -> None:
    """SRT text in folders by a hash of the recording, `vod_id` and blocks as JSON lines in order; the number of folders
    doesn't depend on the number of recordings. `read_srt` gives a recording's blocks in order.

    Blocks are range-partitioned by recording and number, so a huge recording spreads over tasks.
    """
    bucket = F.pmod(F.xxhash64("vod_id"), F.lit(buckets)).cast("int").alias("vod_bucket")
    blocks = srt_blocks(segments).select(bucket, "vod_id", "seg_id", "block")
    blocks.repartitionByRange("vod_bucket", "vod_id", "seg_id").sortWithinPartitions("vod_bucket", "vod_id", "seg_id").write.mode("overwrite").partitionBy("vod_bucket").json(path)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """`vod_id, seg_id, block` of what `write_srt` wrote."""
    return spark.read.schema("vod_id string, seg_id long, block string, vod_bucket int").json(path).drop("vod_bucket")


def append_history(runs: DataFrame, path: str, run_id: str) -> None:
    """Add run records as JSON lines under the run's own folder. A run that is written again replaces itself."""
    runs.write.mode("overwrite").json(f"{path}/run_id={run_id}")
