"""JSON documents of recording jobs, all jobs in one scan.

One document per file with arrays inside; the recording id is a directory name in the path. Transcripts of very many
recordings may also be one document a line, with the id in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine import schemas as S
from clipmine.functions import text as tx


def path_part(depth: int) -> Column:
    """The directory `depth` levels above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.url_decode(F.element_at(parts, F.lit(-1 - depth)))


def _documents(spark: SparkSession, path: str, schema, depth: int | None) -> DataFrame:
    if depth is None:  # a document a line, many in a file
        return spark.read.schema("vod_id STRING, " + schema).json(path)
    # The folders are ids, not partitions: a folder named `vod_id=…` must not add a column.
    return spark.read.schema(schema).options(multiLine=True, recursiveFileLookup=True).json(path).select(path_part(depth).alias("vod_id"), "*")


def read_chat(spark: SparkSession, path: str, *, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(chat rows, chat availability per recording) from chat documents."""
    docs = _documents(spark, path, S.CHATLOG_DOC, depth)
    chat = docs.select("vod_id", F.posexplode("messages").alias("pos", "m")).select(
        "vod_id", F.col("pos").cast("long").alias("seq"), "m.t", "m.author", "m.message"
    )
    return chat, docs.select("vod_id", F.coalesce("available", F.lit(True)).alias("available"), F.col("error_reason").alias("chat_error"))


def read_segments(spark: SparkSession, path: str, *, depth: int | None = 2) -> DataFrame:
    """Segments of transcript documents. `depth` None: documents are lines and hold their `vod_id`."""
    docs = _documents(spark, path, S.TRANSCRIPT_DOC, depth)
    return docs.select("vod_id", F.posexplode("segments").alias("pos", "s")).select(
        "vod_id", F.col("pos").cast("long").alias("seg_id"), "s.start", "s.end", "s.text",
        F.coalesce("s.words", F.array().cast("array<struct<start:double,end:double,text:string>>")).alias("words"),
    )


def read_loudness(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    return _documents(spark, path, S.LOUDNESS_DOC, depth).select("vod_id", F.inline("peaks"))


def read_emotion(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    return _documents(spark, path, S.EMOTION_DOC, depth).select("vod_id", F.inline("peaks"))


def read_speech(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    return _documents(spark, path, S.SPEECH_DOC, depth).select("vod_id", F.inline("intervals"))


def read_decisions(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    docs = _documents(spark, path, S.DECISIONS_DOC, depth)
    return docs.select("vod_id", F.posexplode("decisions").alias("ord", "d")).select("vod_id", "ord", "d.*")


def read_metadata(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    return normalise_metadata(_documents(spark, path, S.METADATA_DOC, depth))


def normalise_metadata(info: DataFrame) -> DataFrame:
    """Downloader fields to the `vods` columns: first non-empty alternative; dates of eight characters only."""
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    date = F.trim(filled("upload_date", "release_date"))
    url = F.col("url") if "url" in info.columns else F.lit(None).cast("string")
    return info.select(
        "vod_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(filled("channel", "uploader"), F.lit("")).alias("channel"),
        F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration_sec"),
        url.alias("url"),
        tx.stream_type("title").alias("stream_type"),
        filled("channel_id", "uploader_id").alias("channel_id"),
        F.when(F.length(date) == 8, date).alias("upload_date"),
    )


def read_log_lines(spark: SparkSession, path: str, *, depth: int = 2) -> DataFrame:
    return spark.read.text(path).select(path_part(depth).alias("job_id"), "value")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time and size of files, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def transcribe(files: DataFrame, fn) -> DataFrame:
    """Run a user's recogniser over audio files: `fn(path, content) -> rows of (start, end, text, words)`.

    Only the result schema is fixed here; the model is the user's.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = [(path, i, *r) for i, r in enumerate(fn(path, content))]
                yield pd.DataFrame(rows, columns=["vod_id", "seg_id", "start", "end", "text", "words"])

    return files.select("path", "content").mapInPandas(run, S.SEGMENTS)
