"""Selection goldens, the end-to-end query on a synthetic recording, and streaming against batch."""

import pytest
from pyspark.sql import functions as F

from clipmine.lexicon import TALK
from clipmine.operators import select as sel
from clipmine.plans import queue as qu
from clipmine.plans.candidates import Recordings


def test_top_n(spark):
    df = spark.createDataFrame([("v", i, s, float(i)) for i, s in ((1, 1.0), (2, 9.0), (3, 5.0), (4, 8.0))], "vod_id string, id int, score double, start double")
    assert [r.id for r in sel.top_n(df, 2).orderBy("rank").collect()] == [2, 4]


def test_diverse_top_n(spark):
    rows = [("v", 1, 100.0, 5.0), ("v", 2, 120.0, 4.9), ("v", 3, 400.0, 3.0), ("v", 4, 3700.0, 2.0)]
    df = spark.createDataFrame(rows, "vod_id string, candidate_id int, start double, rank_score double").withColumn("end", F.col("start") + 60)
    assert [r.candidate_id for r in sel.top_n_diverse(df, 3).orderBy("rank").collect()] == [1, 3, 4]


def test_hour_quota(spark):
    rows = [("v", i, i, 100.0 * i, 100.0 * i + 50, float(i)) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "vod_id string, candidate_id int, ord int, start double, end double, score double")
    assert sorted(r.candidate_id for r in sel.apply_quota(df, 2).collect()) == [2, 3]


def synthetic(spark) -> Recordings:
    """2.5 hours; around the middle of each hour speech, loudness and chat peak."""
    seg, speech, loud, chat = [], [], [], []
    for h in range(3):
        mid = h * 3600.0 + 1800.0
        if mid >= 9000:
            mid = 8000.0
        seg.append(("v", h, mid, mid + 5, "笑死草777", None))
        speech.append(("v", mid - 25, mid + 35))
        for i in range(-20, 21):
            loud.append(("v", mid + i, 1.0, 4.0))
            chat.append(("v", len(chat), mid + i, "a", "草"))
    loud += [("v", float(t), 0.1, 0.0) for t in range(0, 9000, 60)]
    make = spark.createDataFrame
    return Recordings(
        make([("v", 9000.0)], "vod_id string, duration_sec double"),
        make(chat, "vod_id string, seq long, t double, author string, message string"),
        make(seg, "vod_id string, seg_id long, start double, end double, text string, words array<struct<start:double,end:double,text:string>>"),
        make(loud, "vod_id string, t double, rms double, zscore double"),
        make([], "vod_id string, t double, score double, kind string"),
        make(speech, "vod_id string, start double, end double"),
    )


def test_end_to_end_arcs(spark):
    rows = qu.highlights(synthetic(spark), TALK, auto_arcs=True).collect()
    assert len(rows) >= 3 and {r.hour_bucket for r in rows} == {0, 1, 2}
    assert all(0 < r.end - r.start <= 120 for r in rows)


def test_chapters_split_on_topic(spark):
    from clipmine.operators.chapters import topic_chapters

    a, b = "貓咪喜歡吃魚貓咪睡覺", "火箭發射太空軌道衛星"
    seg = spark.createDataFrame([("v", i, i * 30.0, i * 30.0 + 25, a if i < 8 else b) for i in range(20)], "vod_id string, seg_id long, start double, end double, text string")
    v = spark.createDataFrame([("v", 600.0)], "vod_id string, duration_sec double")
    got = topic_chapters(seg, v).orderBy("id").collect()
    assert len(got) >= 2 and got[0].start == 0.0 and got[-1].end == 600.0


def test_chat_dump_files(spark, tmp_path):
    from clipmine.sources import chat

    d = tmp_path / "vod7" / "01"
    d.mkdir(parents=True)
    nested = (
        '{"replayChatItemAction": {"videoOffsetTimeMsec": "1500", "actions": [{"addChatItemAction": {"item": '
        '{"liveChatTextMessageRenderer": {"message": {"runs": [{"text": "hi"}]}, "authorName": {"simpleText": "A"}}}}}]}}'
    )
    (d / "x.live_chat.json").write_text(nested + "\nbroken\n" + '{"t": 2, "author": "B", "text": "yo"}\n')
    rows = chat.normalise(chat.read_dump(spark, str(tmp_path), depth=2)).orderBy("t").collect()
    assert [(r.vod_id, r.t, r.author, r.message) for r in rows] == [("vod7", 1.5, "A", "hi"), ("vod7", 2.0, "B", "yo")]


def test_chat_dump_kinds(spark, tmp_path):
    import json

    from clipmine.sources import chat

    event = lambda t, text: {"t": t, "author": "B", "text": text}
    files = {
        "lines": "\n\n".join(json.dumps(event(i, f"l{i}")) for i in range(5)) + "\n[1, 2]\nnull\n",
        "list": json.dumps([event(1, "a"), 7, event(2, "b")]),
        "pretty": json.dumps({"events": [event(3, "c")], "segments": [event(4, "d")]}, indent=2),
        "empty_events": json.dumps({"events": [], "replayChatEvents": [event(5, "e")]}),
        "one_object": json.dumps(event(6, "no list")),
        "garbage_first": "not json\n" + json.dumps(event(7, "f")) + "\n{broken\n",
        "nothing": "\n \n",
        "windows": json.dumps(event(8, "g")) + "\r\n" + json.dumps(event(9, "h")) + "\r\n",
    }
    for name, text in files.items():
        d = tmp_path / name / "01"
        d.mkdir(parents=True)
        (d / "x.live_chat.json").write_bytes(text.encode())
    got = chat.normalise(chat.read_dump(spark, str(tmp_path), depth=2)).orderBy("vod_id", "seq").collect()
    by = {k: [r.message for r in got if r.vod_id == k] for k in files}
    want = {"lines": [f"l{i}" for i in range(5)], "list": ["a", "b"], "pretty": ["c", "d"], "empty_events": ["e"], "garbage_first": ["f"], "windows": ["g", "h"]}
    assert by == want | {"one_object": [], "nothing": []}
    whole = spark.createDataFrame([(k, k, v) for k, v in files.items()], "vod_id string, file string, value string")
    again = chat.normalise(chat.parse_dumps(whole)).collect()
    assert sorted((r.vod_id, r.t, r.message) for r in again) == sorted((r.vod_id, r.t, r.message) for r in got)


def test_large_dump_is_split(spark, tmp_path):
    from clipmine.sources import chat

    d = tmp_path / "big" / "01"
    d.mkdir(parents=True)
    (d / "x.live_chat.json").write_text("".join(f'{{"t": {i}, "author": "a", "text": "m{i}"}}\n' for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        events = chat.read_dump(spark, str(tmp_path), depth=2)
        rows = chat.normalise(events).orderBy("seq").collect()
        assert spark.read.text(str(d)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.message for r in rows] == [f"m{i}" for i in range(60_000)]


def test_json_artifacts_and_sinks(spark, tmp_path):
    import json

    from clipmine.sources import artifacts, sinks

    d = tmp_path / "jobs" / "v1" / "02"
    d.mkdir(parents=True)
    (d / "t.json").write_text(json.dumps({"segments": [{"id": 0, "start": 0, "end": 1.5, "text": "hey"}]}, indent=1))
    seg = artifacts.read_segments(spark, str(tmp_path / "jobs/*/02/t.json"))
    assert [(r.vod_id, r.end, r.text) for r in seg.collect()] == [("v1", 1.5, "hey")]
    sinks.write_srt(seg, str(tmp_path / "srt"))
    (block,) = [r.block for r in sinks.read_srt(spark, str(tmp_path / "srt")).collect()]
    assert "00:00:00,000 --> 00:00:01,500\nhey" in block
    many = spark.range(300).selectExpr("cast(id as string) vod_id", "id seg_id", "0.0D start", "1.0D end", "'x' text")
    sinks.write_srt(many, str(tmp_path / "srt2"), buckets=8)
    assert sum(p.name.startswith("vod_bucket=") for p in (tmp_path / "srt2").iterdir()) <= 8 and sinks.read_srt(spark, str(tmp_path / "srt2")).count() == 300
    for run in ("a", "b", "b"):  # a run that is tried again replaces what it wrote
        sinks.append_history(spark.range(1), str(tmp_path / "hist"), run)
    assert spark.read.json(str(tmp_path / "hist")).count() == 2


def test_review_stream_equals_batch(spark):
    from clipmine.catalog import QUERIES, load_all

    load_all()
    key = lambda rows: sorted((r.reviewer, r.job_id, r.n, r.total, r.status, r.submitted) for r in rows)
    batch = key(QUERIES["flow_clip_states"](spark, "/root/testdata/sf0.001").collect())
    assert key(QUERIES["st_review_states"](spark, "/root/testdata/sf0.001").collect()) == batch
    assert batch


def test_subtitle_quality_of_events(spark):
    from clipmine.operators.reports import subtitle_quality

    e = spark.createDataFrame([("v", 1, 0.0, 0.4, "a"), ("v", 1, 1.0, 2.0, "b\\Nc")], "vod_id string, clip_id int, start double, end double, text string")
    r = subtitle_quality(e).first()
    assert (r.events, r.flashes, r.keeps_break) == (2, 1, 1) and r.max_gap == pytest.approx(0.6)


def test_edits_keep_style_and_cues_without_words(spark):
    from clipmine.operators.cue_edits import merge_cue_edits

    cue = "vod_id string, clip_id long, cue_id string, start double, end double, vod_start double, vod_end double, text string, words array<struct<text string, is_kw boolean, color string>>"
    word = lambda s: [(ch, False, None) for ch in s]
    old = spark.createDataFrame([("v", 1, "a", 0.0, 2.0, 10.0, 12.0, "**ab**c", None, 40)], cue + ", font_size int")
    fresh = spark.createDataFrame([("v", 1, "n1", 0.0, 2.0, 10.0, 12.0, "abc", word("abc")), ("v", 1, "n2", 5.0, 6.0, 30.0, 31.0, "d", word("d"))], cue)
    out = {r["cue_id"]: r for r in merge_cue_edits(old, fresh).collect()}
    assert (out["n1"]["font_size"], out["n2"]["font_size"]) == (40, None)
    assert [w["is_kw"] for w in out["n1"]["words"]] == [True, True, False]
    assert out["n1"]["text"] == "**ab**c"
