"""Story arcs: growing, reach, choice."""

import random

import pytest

from clipmine.operators import arcs as ar

CANDIDATE = (
    "vod_id string, hour_bucket int, candidate_id int, start double, end double, score double, speech_ratio double, title string, reason string, "
    "transcript_excerpt string, keyword_hits int, chapter_id int, is_intro boolean, is_outro boolean, transcript_bigrams array<string>"
)
ARC = dict(speech_min=0.45, story_min=45.0, story_max=120.0, gap_max=25.0, per_hour=4, continuity_min=0.5)


def pairs_of(text):
    return sorted({a + b for a, b in zip(text, text[1:])})


def candidate(i, start, text="同題材同題材", **kw):
    c = dict(
        vod_id="v", hour_bucket=0, candidate_id=i, start=start, end=start + 50.0, score=10.0 - i, speech_ratio=0.6, title=text, reason="", transcript_excerpt=text,
        keyword_hits=2, chapter_id=1, is_intro=False, is_outro=False, transcript_bigrams=pairs_of(text),
    )
    return c | kw


@pytest.fixture(scope="module")
def arcs(spark):
    def run(rows, **kw):
        out = ar.story_arcs(spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE), **{**ARC, **kw})
        return out.orderBy("vod_id", "start").collect()

    return run


def test_far_candidates_make_arcs_of_their_own(arcs):
    assert len(arcs([candidate(i, 500.0 * i, f"話題{i}") for i in range(6)])) == 4
    assert len(arcs([candidate(i, 500.0 * i, f"話題{i}") for i in range(6)], seeds=3)) == 3


def test_near_candidates_merge(arcs):
    (arc,) = arcs([candidate(1, 0.0), candidate(2, 60.0)])
    assert (arc.start, arc.end, arc.merged_from, arc.score) == (0.0, 110.0, [1, 2], 9.0) and "2" in arc.reason
    # not over the longest story, nor to a chapter further off
    assert len(arcs([candidate(1, 0.0), candidate(2, 75.0)])) == 2
    assert len(arcs([candidate(1, 0.0), candidate(2, 60.0, chapter_id=3)])) == 2


def test_whole_texts_are_compared(arcs):
    whole = "後段同題材" * 3
    pair = [candidate(i, 60.0 * i, c * 20, title=c, transcript_bigrams=[c * 2, *pairs_of(whole)]) for i, c in enumerate("甲乙")]
    (arc,) = arcs(pair, per_hour=1, story_min=60.0)
    assert arc.merged_from == [0, 1]


def test_a_chain_grows_pass_by_pass(arcs):
    # each is linked with its neighbour only, the last ones by score join first
    rows = [candidate(i, 20.0 * i, f"{'甲乙丙丁戊己'[i]}{'乙丙丁戊己庚'[i]}" * 3, score=[9.0, 1.0, 2.0, 3.0][i], end=20.0 * i + 15) for i in range(4)]
    for r in rows:
        i = r["candidate_id"]
        r["transcript_bigrams"] = [f"p{i}", f"p{i + 1}"]
        r["title"] = ""
    (arc,) = arcs(rows, story_min=10.0, continuity_min=0.6)
    assert arc.merged_from == [0, 1, 2, 3] and (arc.start, arc.end) == (0.0, 75.0)


def test_pool_of_an_hour(spark):
    rows = [candidate(1, 0.0, is_intro=True), candidate(2, 100.0, speech_ratio=0.1), candidate(3, 200.0), candidate(4, 0.0, vod_id="w", is_outro=True, speech_ratio=0.2), candidate(5, 9.0, vod_id="x", speech_ratio=0.1), candidate(6, 9.0, vod_id="x", speech_ratio=0.3)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE)
    ids = lambda n: sorted(r.candidate_id for r in ar.arc_pool(df, 0.45, n).collect())
    assert ids(None) == [3, 4, 5, 6] and ids(1) == [3, 4, 6]


def grown(seed, pool, links):
    """The arc of a seed by plain passes, all links between members given."""
    start, end, members, grew = seed["start"], seed["end"], [seed["candidate_id"]], True
    while grew:
        grew = False
        for r in sorted(pool, key=lambda r: (-r["score"], r["candidate_id"])):
            if r["candidate_id"] in members or max(end, r["end"]) - min(start, r["start"]) > 120 or max(0, r["start"] - end, start - r["end"]) > 25:
                continue
            if any((m, r["candidate_id"]) in links for m in members):
                start, end, grew = min(start, r["start"]), max(end, r["end"]), True
                members.append(r["candidate_id"])
    return start, end, sorted(members)


def test_growth_is_a_fixpoint(spark, arcs):
    rng = random.Random(4)
    for _ in range(4):
        rows = []
        for i in range(14):
            at = round(rng.uniform(0, 300), 1)
            # without titles and chapters an arc links by topic, keywords and closeness only as its members do
            rows.append(candidate(i, at, end=at + rng.choice([10.0, 20.0]), title="", score=rng.choice([1.0, 2.0, 3.0]), chapter_id=None, transcript_bigrams=rng.sample(["aa", "bb", "cc", "dd"], 2)))
        df = spark.createDataFrame([tuple(r.values()) for r in rows], CANDIDATE)
        found = ar.continuity(df, gap_max=25.0).collect()
        assert {(r.seed_id, r.other_id): r.continuity for r in found} == {(r.other_id, r.seed_id): r.continuity for r in found}
        links = {(r.seed_id, r.other_id) for r in found if r.continuity >= 0.25}
        for arc in arcs(rows, story_min=1.0, per_hour=1, continuity_min=0.25):
            seed = min(rows, key=lambda r: (-r["score"], r["candidate_id"]))
            want = grown(seed, rows, links)
            # the arc itself may be closer to a candidate than its members were
            assert set(want[2]) <= set(arc.merged_from) and arc.start <= want[0] and arc.end >= want[1]


def test_no_python(spark):
    out = ar.story_arcs(spark.createDataFrame([], CANDIDATE), **ARC)
    assert "Python" not in out._jdf.queryExecution().toString() and out.count() == 0


def test_arc_highlights_run_in_small_steps(spark, monkeypatch):
    """no step's plan holds all range joins, the chapters are made once, nothing is made for nobody."""
    from clipmine.catalog.tables import DAY, Tables
    from clipmine.operators import features as ft
    from clipmine.plans import candidates as cd
    from clipmine.plans import queue as qu
    from clipmine.session import cut_lineage

    exchanges = []

    def cut(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut_lineage(df)

    for module in (ft, cd, qu, ar):
        monkeypatch.setattr(module, "cut_lineage", cut)
    monkeypatch.setattr(qu, "review_queue", None)
    out = qu.highlights(Tables(spark, "/root/testdata/sf0.001").recordings, DAY, auto_arcs=True)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert max(*exchanges, plan.count("Exchange hashpartitioning")) <= 24 and "block" not in plan
