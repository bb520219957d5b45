"""The piece table against a plain rearrangement of lines."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clipmine.llm import fill_middle as fm


def plain(doc_id, text, rate=100, spm=50, seed=7):
    """What a transformed document has to be, by lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return len(lines), "plain", None, None, text
    i, j = sorted((a % (len(lines) + 1), b % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    if d % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@given(st.lists(st.sampled_from(["a", "ü\n", "\n", "🦀", "<", "<P", ">", "S>", "<M>", "\r\n", "x y"]), max_size=12), st.integers(0, 300))
def test_arrangement_and_inverse(parts, doc_id):
    text = "".join(parts)
    raw = memoryview(text.encode())
    n, form, prefix, middle, pieces = fm.arranged(raw, doc_id, 100, 50, 7)
    out = b"".join(fm.streamed(pieces, (raw, fm.SENTINELS)))
    assert (n, form, prefix, middle, out.decode()) == plain(doc_id, text)
    back = fm.restored(memoryview(out), form)
    assert b"".join(fm.streamed(back, (memoryview(out),))).decode() == text
    assert fm.digest(pieces, (raw, fm.SENTINELS)) == hashlib.sha256(out).hexdigest()


@pytest.mark.parametrize("at", range(8))
def test_split_cuts_one_descriptor(at):
    pieces = [(0, 10, 3), (1, 0, 2), (0, 20, 2)]
    left, right = fm.split(pieces, at)
    assert sum(p[2] for p in left) == min(at, 7) and sum(p[2] for p in left + right) == 7
    assert all(p[2] > 0 for p in left + right) and len(left + right) <= 4


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, 7), (30, 0, 1), (0, 50, 7)])
def test_transformed_table(spark, rate, spm, seed):
    long = "".join(f"line {i} ü\n" for i in range(200_000))
    texts = [None, "", "a", "\n", "a\nb", "x <P> y\nz", long, "<\n<S", "tail <S", " \r\n \n", "a\nb"] + [f"{i}\n" * (i % 9) for i in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a\nb"), (None, "no\nnumber\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("extra") for c in ("n", "form", "pieces", "output", "batch")})
    made = fm.transformed(docs, rate, spm, seed)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain(i, t, rate, spm, seed)) for i, t in rows), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    read = fm.read_back(made).select("doc_id", "output_sha256", "restored_sha256").collect()
    assert sorted(map(tuple, read), key=repr) == sorted(((i, sha(plain(i, t, rate, spm, seed)[4]), sha(t)) for i, t in rows), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fm.read_back(fm.transformed(docs)).count() == 0
