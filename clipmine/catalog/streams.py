"""Registered queries: streaming operators replayed over the events table.

Each reads `events` as a stream, runs until the data is used up, and returns what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.catalog import query
from clipmine.catalog.reports import STATES, STEP_CASE, WEIGHT, review_events
from clipmine.catalog.tables import DAY, with_
from clipmine.session import shared_dir
from clipmine.streaming import chat as sc
from clipmine.streaming import progress, stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


def source(t, name: str = "events") -> DataFrame:
    """The table as a stream, be it one file or a folder of files: a pattern that matches either, since a plain path of a
    stream has to be a folder."""
    return t.spark.readStream.schema(t.read(name).schema).parquet(f"{t.dir}/{name}.parque[t]")


def chat_stream(t, *, ends: bool = True) -> DataFrame:
    """The events as a chat stream. `ends`: a last row far in the future closes every window and session of the others."""
    rows = source(t)
    if ends:
        path = f"{shared_dir(t.spark)}/end-{uuid.uuid4().hex}"
        last = {"ts": F.lit("2200-01-01").cast("timestamp"), "event_type": F.lit("purchase"), "user_id": F.lit(-1), "event_id": F.lit(-1)}
        names = [F.col(n).cast(k) for n, k in t.read("events").dtypes]
        blank = t.spark.range(1).select(*[last.get(n, F.lit(None)).cast(k).alias(n) for n, k in t.read("events").dtypes])
        blank.write.parquet(path)
        rows = rows.unionByName(t.spark.readStream.schema(blank.schema).parquet(path).select(*names))
    return rows.select(
        F.to_date("ts").cast("string").alias("vod_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("message"),
    )


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream to its end into files of the shared folder and read them back."""
    base = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = (
        df.writeStream.outputMode(mode).format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/cp")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(base + "/out")


def seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {c})")


@query(
    "st_chat_bins",
    """SELECT strftime(b, '%Y-%m-%d') AS vod_id, CAST(epoch(b) AS BIGINT) AS start, n, round(react, 6) AS react FROM (
          SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS b, count(*) AS n, sum(CASE event_type WHEN 'purchase' THEN 1e0 WHEN 'error' THEN 0.8e0 WHEN 'signup' THEN 2.5e0 ELSE 0e0 END) AS react FROM events GROUP BY ALL)""",
)
def _(t):
    out = drain(sc.bins(sc.mark(chat_stream(t), DAY), width="5 minutes"))
    return out.select("vod_id", seconds("start").alias("start"), "n", F.round("react", 6).alias("react"))


@query(
    "st_sliding_features",
    """SELECT vod_id, CAST(epoch(b) AS BIGINT) AS start, round(n / 600e0, 6) AS chat_density, round(least(3e0, cu * 1.5e0), 6) AS chat_cue FROM (
          SELECT strftime(ts, '%Y-%m-%d') AS vod_id, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS b, count(*) AS n, count(*) FILTER (event_type = 'signup') AS cu FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL)""",
)
def _(t):
    out = drain(sc.sliding_features(sc.mark(chat_stream(t), DAY), width_sec=600, step_sec=300))
    return out.select("vod_id", seconds("start").alias("start"), F.round("chat_density", 6).alias("chat_density"), F.round("chat_cue", 6).alias("chat_cue"))


@query(
    "st_reaction_sessions",
    """SELECT vod_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms, count(*) AS n FROM (
          SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY vod_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
            SELECT strftime(ts, '%Y-%m-%d') AS vod_id, ts, lag(ts) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS p FROM events WHERE event_type IN ('purchase', 'error', 'signup')))
        GROUP BY vod_id, g""",
)
def _(t):
    out = drain(sc.reaction_sessions(sc.mark(chat_stream(t), DAY), gap="5 minutes"))
    return out.select("vod_id", F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, start)").alias("start_ms"), "n")


@query("st_deduplicate", with_("ev", body="SELECT vod_id, seq FROM ev"))
def _(t):
    c = chat_stream(t, ends=False)
    twice = c.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return drain(sc.deduplicated(twice)).select("vod_id", "seq")


def _rocks(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


@query(
    "st_burst_seeds",
    """WITH RECURSIVE bins AS (SELECT strftime(b, '%Y-%m-%d') AS vod_id, (epoch(b) % 86400) * 1e0 AS t, sum(w) AS react FROM (
           SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS b, CASE event_type WHEN 'purchase' THEN 1e0 WHEN 'error' THEN 0.8e0 WHEN 'signup' THEN 2.5e0 ELSE 0e0 END AS w FROM events) GROUP BY b HAVING sum(w) > 0),
         nb AS (SELECT *, row_number() OVER o AS k, sum(react) OVER o AS total, round(greatest(0e0, t + 2.5e0 - 30), 1) AS seed FROM bins WINDOW o AS (PARTITION BY vod_id ORDER BY t)),
         sd AS (SELECT vod_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS last, false AS took FROM nb GROUP BY vod_id
           UNION ALL SELECT vod_id, k, CASE WHEN ok THEN seed ELSE last END, ok FROM (SELECT nb.*, last, react >= greatest(1.5e0, 1.2e0 * total / nb.k) AND (last IS NULL OR seed - last >= 600) AS ok FROM sd JOIN nb ON nb.vod_id = sd.vod_id AND nb.k = sd.k + 1))
       SELECT vod_id, seed AS t, round(react, 6) AS react FROM sd JOIN nb USING (vod_id, k) WHERE took""",
)
def _(t):
    _rocks(t)
    bins = sc.mark(chat_stream(t), DAY).withWatermark("ts", "10 minutes").groupBy("vod_id", F.window("ts", "5 minutes").alias("w")).agg(
        F.sum(sc._strength()).alias("react")
    )
    rows = bins.select("vod_id", F.window_time("w").alias("ts"), (seconds("w.start") % 86400).cast("double").alias("t"), "react").where(F.col("react") > 0)
    return drain(stateful.burst_seeds(rows, lag=30.0, gap=600.0)).withColumn("react", F.round("react", 6))


@query("st_review_states", STATES)
def _(t):
    """The change log of clip states, reduced to the last state per clip."""
    _rocks(t)

    class Stream:
        def read(self, name):
            return source(t, name)

    from clipmine.operators.review import total_score

    e = review_events(Stream()).select("reviewer", "seq", "kind", "job_id", "n", total_score().alias("total"))
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        # Rows arrive in change order within a reviewer's partition.
        batch.withColumn("change", F.monotonically_increasing_id()).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    changes = stateful.review_states(e)
    # An empty table starts no batch; the log is there all the same.
    t.spark.createDataFrame([], changes.schema).withColumn("change", F.lit(0).cast("long")).withColumn("batch", F.lit(0)).write.parquet(f"{base}/out/b=-1")
    q = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    log = t.spark.read.parquet(base + "/out")
    last = log.groupBy("reviewer", "job_id", "n").agg(F.max_by(F.struct("total", "status", "submitted"), F.struct("batch", "change")).alias("s"))
    return last.select("reviewer", "job_id", "n", "s.total", "s.status", "s.submitted")


@query(
    "st_job_progress",
    f"""SELECT job_id, round(100 * sum(CASE status WHEN 'done' THEN {WEIGHT} * 1e0 ELSE {WEIGHT} * 0.35e0 END) / 100, 6) AS pct FROM (
          SELECT 'j' || user_id AS job_id, CASE event_id % 8 {STEP_CASE} END AS step, arg_max(CASE event_type WHEN 'purchase' THEN 'done' ELSE 'running' END, event_id) AS status FROM events GROUP BY ALL) GROUP BY job_id""",
)
def _(t):
    from clipmine.operators.reports import STEPS

    name = F.get(F.array(*[F.lit(s) for s in STEPS]), (F.col("event_id") % 8).cast("int"))
    e = source(t).select(
        F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), name.alias("step"),
        F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"), F.lit(None).cast("string").alias("error"), F.col("event_id").alias("ts"),
    )
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    q = e.writeStream.foreachBatch(progress.upsert_progress(base, digits=6)).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return t.spark.read.parquet(f"{base}/jobs/v{last}")
