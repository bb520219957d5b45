"""Live job progress: step events folded into the latest status per step, percent per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.operators.reports import step_percent


def latest_steps(events: DataFrame) -> DataFrame:
    """Latest status per (job, step) from `job_id, step, status, error, ts`."""
    return events.groupBy("job_id", "step").agg(
        F.max_by(F.struct("status", "error"), "ts").alias("s"), F.max("ts").alias("ts")
    ).select("job_id", "step", "s.status", "s.error", "ts")


def upsert_progress(path: str, *, digits: int = 1):
    """A `foreachBatch` function that keeps step states and job percents under `path`.

    Each batch writes a new version folder next to the last one and then its number: a batch run again
    after a failure rewrites the same version, so the result does not depend on retries.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("job_id", "step", "status", "error", "ts")
        if batch_id > 0:
            fresh = fresh.unionByName(spark.read.parquet(f"{path}/steps/v{batch_id - 1}"))
        latest_steps(fresh).write.mode("overwrite").parquet(f"{path}/steps/v{batch_id}")
        steps = spark.read.parquet(f"{path}/steps/v{batch_id}")
        step_percent(steps, digits=digits).write.mode("overwrite").parquet(f"{path}/jobs/v{batch_id}")

    return write
