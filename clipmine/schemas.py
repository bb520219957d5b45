"""Table schemas as DDL. Every table carries `vod_id`; times are seconds as DOUBLE."""

from __future__ import annotations

VODS = (
    "vod_id STRING, title STRING, channel STRING, duration_sec DOUBLE, url STRING, "
    "stream_type STRING, chat_error STRING, channel_id STRING, upload_date STRING"
)
CHAT = ("vod_id STRING, seq BIGINT, t DOUBLE, author STRING, message STRING")
SEGMENTS = (
    "vod_id STRING, seg_id BIGINT, start DOUBLE, end DOUBLE, text STRING, "
    "words ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>"
)
LOUDNESS = ("vod_id STRING, t DOUBLE, rms DOUBLE, zscore DOUBLE")
EMOTION = ("vod_id STRING, t DOUBLE, score DOUBLE, kind STRING")
SPEECH = ("vod_id STRING, start DOUBLE, end DOUBLE")
CHAPTERS = ("vod_id STRING, id INT, start DOUBLE, end DOUBLE, title STRING")
DECISIONS = (
    "vod_id STRING, candidate_id INT, action STRING, start DOUBLE, end DOUBLE, title STRING, hook STRING"
)
HIGHLIGHTS = (
    "vod_id STRING, id INT, start DOUBLE, end DOUBLE, title STRING, reason STRING, "
    "suggested_hook STRING, score DOUBLE, hour_bucket INT, chapter_id INT, speech_ratio DOUBLE, "
    "start_display STRING, end_display STRING, arc_id INT, merged_from ARRAY<INT>"
)
CUTS = ("vod_id STRING, clip_id BIGINT, ord INT, start DOUBLE, end DOUBLE")
KEEP_AXIS = (
    "vod_id STRING, clip_id BIGINT, ord INT, vod_start DOUBLE, vod_end DOUBLE, "
    "short_start DOUBLE, short_end DOUBLE"
)
CUE_WORD = "STRUCT<text: STRING, is_kw: BOOLEAN, color: STRING>"
CUES = (
    "vod_id STRING, clip_id BIGINT, cue_id STRING, start DOUBLE, end DOUBLE, vod_start DOUBLE, "
    f"vod_end DOUBLE, text STRING, words ARRAY<{CUE_WORD}>"
)
EVENTS = ("vod_id STRING, clip_id BIGINT, ord INT, start DOUBLE, end DOUBLE, text STRING")
REVIEW_EVENTS = (
    "reviewer STRING, seq BIGINT, kind STRING, job_id STRING, n INT, like INT, content INT, visual INT"
)
CLIP_STATE = (
    "reviewer STRING, job_id STRING, n INT, total INT, status STRING, submitted BOOLEAN"
)
JOB_STEPS = ("job_id STRING, step STRING, status STRING, error STRING")

# JSON documents as stored by a recording job (one document per file, arrays inside).
CHATLOG_DOC = (
    "available BOOLEAN, error_reason STRING, "
    "messages ARRAY<STRUCT<t: DOUBLE, author: STRING, message: STRING>>"
)
TRANSCRIPT_DOC = (
    "language STRING, segments ARRAY<STRUCT<id: BIGINT, start: DOUBLE, end: DOUBLE, text: STRING, "
    "words: ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>>>"
)
LOUDNESS_DOC = ("window_sec DOUBLE, peaks ARRAY<STRUCT<t: DOUBLE, rms: DOUBLE, zscore: DOUBLE>>")
EMOTION_DOC = ("window_sec DOUBLE, peaks ARRAY<STRUCT<t: DOUBLE, score: DOUBLE, kind: STRING>>")
SPEECH_DOC = ("intervals ARRAY<STRUCT<start: DOUBLE, end: DOUBLE>>")
DECISIONS_DOC = (
    "decisions ARRAY<STRUCT<candidate_id: INT, action: STRING, start: DOUBLE, end: DOUBLE, "
    "title: STRING, hook: STRING>>"
)
METADATA_DOC = (
    "id STRING, title STRING, channel STRING, uploader STRING, duration DOUBLE, "
    "channel_id STRING, uploader_id STRING, upload_date STRING, release_date STRING"
)
