"""Conversation repair against a search that compares whole edit strings."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clipmine.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
MARK = re.compile(r"[^\x20\x09-\x0D]")


def strings(rows):
    """The cheapest edits as (cost, string, repaired rows), by comparing tuples of every node (rows read, last role)."""
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        for last in ("", "s", "a", "u", "a"):  # rows may be inserted; the assistant twice, before and after a user
            here = best.get((i, last))
            if here:
                for role in ("user", "assistant"):
                    grow(best, (i, role[0]), last, here, 2, "I", (role, ""))
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for last in ("", "s", "u", "a"):
            here = best.get((i, last))
            if not here:
                continue
            offer(best, (i + 1, last), (here[0] + 3, here[1] + "D", here[2]))
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            grow(best, (i + 1, role[:1]), last, here, more, "K", (role, text))
            for new in ("user", "assistant"):
                grow(best, (i + 1, new[0]), last, here, 2 + more, "R", (new, text))
    return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)


def grow(best, node, last, here, cost, letter, row):
    if (last, node[1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
        offer(best, node, (here[0] + cost, here[1] + letter, (*here[2], row)))


def offer(best, node, path):
    if node not in best or path < best[node]:
        best[node] = path


def exhaustive(rows, most=2):
    """As `strings`, by trying every sequence of edits with at most `most` inserts in a place."""
    found = []
    places = [["", *("I" * k for k in range(1, most + 1))] for _ in range(len(rows) + 1)]
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "U", "A"] for _, _, f in rows]):
        for ins in itertools.product(*places):
            for roles in itertools.product("ua", repeat=sum(map(len, ins))):
                it, out, cost, audit = iter(roles), "", 0, ""
                for k in range(len(rows) + 1):
                    for _ in ins[k]:
                        out, cost, audit = out + next(it), cost + 2, audit + "I"
                    if k < len(rows):
                        role, _, f = rows[k]
                        e = edits[k]
                        audit += e if e in "DK" else "R"
                        cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and f == "truncated")
                        out += "" if e == "D" else role[:1] or "?" if e == "K" else e.lower()
                if LEGAL.fullmatch(out):
                    found.append((cost, audit))
    return min(found)


def expected(rows):
    """The report of a table, in plain Python."""
    held, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        held[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, part in held.items():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in part:
            marks = MARK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = {t for t, *_ in part if t is not None}
        cost, audit, fixed = strings([(r, t, f) for (_, r, t), f in zip(part, faults, strict=True)])
        initials = [r[:1] for _, r, _ in part]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("x"), st.sampled_from(["", "", "blank", "duplicate", "truncated"]))
FAULT = {"": 0, "blank": repair.BLANK, "duplicate": repair.REPEATED, "truncated": repair.TRUNCATED}


@settings(max_examples=300)
@given(st.lists(ROW, max_size=30), st.integers(1, 7))
def test_integers_choose_the_least_string(rows, size):
    cost, audit, _ = strings(rows)
    plain = [(r[:1], FAULT[f]) for r, _, f in rows]
    assert repair.audit(plain) == (cost, audit)
    # folded from blocks
    fold = repair._Fold(1)
    out = []
    for k in range(0, len(rows), size):
        part = plain[k : k + size]
        found = [(s, t, p) for s in range(4) for t, p in enumerate(repair.solve(part, s)) if p]
        out += fold.add(
            dict(blank=0, repeated=0, truncated=0, illegal=0, turns=0, opening_turn=None, closing_turn=None, first="", last="", turn=k, role="", said=b"", block=k)
            | dict(source=[s for s, _, _ in found], target=[t for _, t, _ in found], cost=[p[0] for *_, p in found], path=[repair.letters(p) for *_, p in found])
        )
    out += fold.finish()
    assert "".join(r[5] for r in out) == audit and out[-1][11] == cost
    assert [r[1] for r in out[:-1]] == list(range(0, len(rows), size))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_nothing_cheaper_exists(rows):
    assert repair.audit([(r[:1], FAULT[f]) for r, _, f in rows]) == exhaustive(rows)


@pytest.mark.parametrize("size", [3, repair.BLOCK])
def test_report_of_a_table(spark, size):
    rows = []
    for conv in range(60):
        for turn in range(conv % 12):
            role = ["system", "user", "assistant", "assistant", "tool", None][(conv * 7 + turn * turn) % 6]
            text = ["Yes.", "no", None, "Ends.  \n", "", "?", f"{turn}!"][(conv + turn * 3) % 7]
            rows.append((conv, turn * (1 + conv % 2), role, text))
    rows += [(100, t, "user" if t % 2 else "assistant", f"Turn {t % 700}." if t % 5 else "cut") for t in range(1500)]  # a hot conversation
    rows += [(101, None, "user", "b."), (101, None, "assistant", "a."), (101, 3, None, "c."), (101, 3, "user", "b.")]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "x" * 200_000 + ".")] + [(102, 5, "user", "same.")] * 9
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "All rows dropped."))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit("extra") for n in ("said", "kind", "fault", "block", "edit", "copy", "first")})
    out = repair.with_empty(turns, repair.report(repair.repaired(repair.damaged(turns), size)))
    assert {r["conv_id"]: tuple(r) for r in out.collect()} == expected(rows)


def test_repaired_rows_are_legal(spark):
    rows = [(c, t, ["assistant", "user", "system"][(c + t) % 3], f"{t}.") for c in range(20) for t in range(9)]
    edits = repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    for c in range(20):
        mine = [r for r in edits if r["conv_id"] == c]
        assert LEGAL.fullmatch("".join(r["role"][0] for r in mine if r["role"]))
        assert mine[-1]["edit"] is None and all(r["edit"] for r in mine[:-1])
        assert sum(r["edit"] != "I" for r in mine[:-1]) == 9


def test_empty_table(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert repair.with_empty(turns, repair.report(repair.repaired(repair.damaged(turns)))).count() == 0
