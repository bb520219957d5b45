"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: each is applied only while the session still holds Spark's own default,
# so a cluster's configuration always wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that a Python worker gets at once: texts are long, and a worker's memory never shrinks again.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Switch on adaptive execution with skew handling wherever the session has not decided."""
    for key, value in _DEFAULTS.items():
        if not _is_explicit(spark, key):
            spark.conf.set(key, value)
    _ship_package(spark)
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/clipmine", "zip", root, "clipmine")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def _is_explicit(spark: SparkSession, key: str) -> bool:
    return any(k == key for k, _ in spark.sparkContext.getConf().getAll())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); where it is unset, a new local one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes that a task gathers before it writes them to an intermediate table; the default holds 128 MB in every task.
ROW_GROUP_BYTES = 8 << 20


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Losing an executor then costs one stage, the plan above starts small, and the optimizer knows the
    table's real size (so a join broadcasts it only when it is small).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
