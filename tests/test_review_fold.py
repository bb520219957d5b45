"""The fold of a reviewing session."""

from clipmine.operators.review import Session


def test_review_session():
    s, states = Session(), {}
    for n in range(4):
        s.apply("score", ("j", n), 9, states)
    assert states[("j", 0)]["status"] == "purged" and len(s.recent) == 3
    s.apply("score", ("j", 1), 12, states)
    assert states[("j", 1)]["status"] == "kept"
    assert s.apply("score", ("j", 0), 30, states) == []
