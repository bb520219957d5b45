"""Examples written out, one for each assistant turn, and conversations read back from them alone."""

import random

import pytest

import __spark_entry__ as entry
from clipmine.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["", "ok", "\\### Assistant: </turn> ok", "a\r\nb\n", " </turn>\n### user: x", "ü" * 30, "\\\\h<l#:", None]


def turns(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "a:b", None]), rng.choice(HARD)) for c in range(30) for i in range(rng.randint(1, 9))]
    rows += [(100, i, "user", "no reply") for i in range(3)] + [(None, 0, "assistant", "x"), (None, 1, "user", "y")]
    return chat.formatted(spark.createDataFrame(rows, TURNS))


@pytest.mark.parametrize("piece", [3, 1 << 16])
def test_written_examples(spark, piece, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", piece)
    out = turns(spark).cache()
    got = {}
    for r in chat.written(out).collect():
        assert r.part == "target" or len(r.text) <= chat.PIECE
        if r.part != "rest":
            got.setdefault((r.conv_id, r.example), {"context": "", "target": ""})[r.part] += r.text
    whole = {}
    want = {}
    for r in sorted(out.collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.place)):
        text = whole.get(r.conv_id, "")
        if r.example is not None:
            head = r.segment[: r.target_start - r.start]
            want[r.conv_id, r.example] = {"context": text + head, "target": r.segment[len(head) : len(head) + r.target_chars]}
        whole[r.conv_id] = text + r.segment
    assert got == want and len(want) > 20
    assert sorted(chat.read_examples(chat.written(out)).collect(), key=repr) == sorted(chat.read_back(out).collect(), key=repr)


def test_a_changed_context_is_found(spark):
    out = chat.written(chat.formatted(spark.createDataFrame([(1, i, r, f"{i}") for i, r in enumerate(["user", "assistant"] * 2)], TURNS)))
    bad = out.selectExpr("conv_id", "example", "part", "CASE WHEN part = 'context' AND example = 1 THEN replace(text, ': 0', ': 9') ELSE text END AS text")
    with pytest.raises(Exception, match="doesn't begin with"):
        bad.transform(chat.read_examples).collect()


def test_the_query_writes_its_examples(spark, monkeypatch):
    monkeypatch.setattr(chat, "written", lambda output: (_ for _ in ()).throw(RuntimeError("written")))
    with pytest.raises(RuntimeError, match="written"):
        entry.queries()["op10_prefix_target_chat"](spark, "/root/testdata/sf0.001")
