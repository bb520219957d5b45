"""Cues of a clip in Arrow batches give what the columns give, and don't grow with the square of a clip's cues."""

import random
import time

from pyspark.sql import functions as F

from clipmine.functions import text as tx
from clipmine.functions.spans import py_round
from clipmine.operators import cue_edits as ce
from clipmine.operators import laid as la
from clipmine.operators.intervals import short_pieces, vod_time


def test_laid_as_by_columns(spark):
    rng = random.Random(5)

    def clip(i):
        axis, at = [], 0.0
        for _ in range(rng.randint(1, 4)):
            a, n = round(rng.uniform(0, 300), 3), round(rng.uniform(0.05, 60), 3)
            axis.append((a, round(a + n, 3), round(at, 3), round(at + n, 3)))
            at += n
        spans = [(a, a + rng.choice([-1.0, 0.05, 7.0005, rng.uniform(0, 90)])) for a in (rng.choice([round(rng.uniform(0, 300), 4), rng.uniform(0, 300)]) for _ in range(rng.randint(0, 30)))]
        return i, axis, spans

    kinds = "i int, axis array<struct<vod_start:double,vod_end:double,short_start:double,short_end:double>>, x array<struct<start:double,end:double>>"
    df = spark.createDataFrame([clip(i) for i in range(150)], kinds).cache()
    ax, x = F.col("axis"), F.col("x")
    fast = df.select("i", F.explode(la.laid(x["start"], x["end"], *[ax[c] for c in ("vod_start", "vod_end", "short_start", "short_end")])).alias("p")).select("i", "p.*")
    each = df.select("i", "axis", F.posexplode("x").alias("k", "x")).select("*", F.posexplode(short_pieces(F.col("x.start"), F.col("x.end"), ax)).alias("j", "p"))
    back = lambda t, other: py_round(F.coalesce(vod_time(F.col(t), ax), F.col(other)), 3)
    slow = each.select("i", "k", "j", py_round("p.a", 2), py_round("p.b", 2), back("p.a", "x.start"), back("p.b", "x.end"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.count() > 300


def test_one_run_is_carried_as_any_other(spark):
    rows = [(raw, tx_, old) for raw, tx_ in [("abcabc", "abcabc"), ("abcabc", "**ab**cabc"), ("xbc", "xbc"), ("a**b", "a**b"), ("", "")] for old in ("abca**bc**", "**bc**", "q**zz**", "**a****b**c", "a**b", "x\\n**bc**", "x**bc**\n")]
    df = spark.createDataFrame(rows, "raw string, text string, old string").cache()
    df = df.select(F.struct("raw", "text").alias("f"), F.struct(F.col("old").alias("text"), F.lit(None).cast(ce.WORDS).alias("words"), F.lit("").alias("plain")).alias("o"))
    general = tx.to_markup(ce.carried_marks(tx.parse_markup("f.text").cast(ce.WORDS), tx.parse_markup("o.text").cast(ce.WORDS)))
    got = df.select(general.alias("a"), ce.carried_text(general).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_a_clip_with_many_cues(spark):
    """Each of 1,500 fresh cues looked at all old ones, and at those taken before, in a fold."""
    n = 1500
    cue = lambda p, i, at: ("v", 1, f"{p}{i}", i * 1.0, i + 3.0, at, at + 3.0, "ab")
    kinds = "vod_id string, clip_id long, cue_id string, start double, end double, vod_start double, vod_end double, text string"
    old = spark.createDataFrame([cue("o", i, i + 0.1) for i in range(n)], kinds)
    fresh = spark.createDataFrame([cue("f", i, i * 1.0) for i in range(n)], kinds).withColumn("words", tx.parse_markup("text"))
    started = time.time()
    got = ce.matches(old, fresh, ["vod_id", "clip_id"]).collect()
    assert time.time() - started < 30
    assert {(r.cue_id, r.old_id) for r in got} == {(f"f{i}", f"o{i}") for i in range(n)}


def test_missing_cues_of_arrays(spark):
    """Clips that have their cues as arrays keep them in their rows: nothing is shuffled, and it is what rows of cues give."""
    from clipmine.operators import cues as cu

    rng = random.Random(3)
    cue = "array<struct<cue_id:string,vod_start:double,vod_end:double,text:string>>"

    def some(p, n):
        out = []
        for i in range(n):
            a = rng.uniform(0, 60)
            out.append((f"{p}{i}", *((a, a + rng.uniform(-1, 9)) if i % 3 else (None, None)), rng.choice(["a", "b", "**a**", "c", "", "d"])))
        return out

    clips = spark.createDataFrame([("v", i, some("f", rng.randint(0, 12)), some("o", rng.randint(0, 5))) for i in range(60)], f"vod_id string, clip_id long, fresh {cue}, old {cue}")
    got = cu.missing_in_clips(clips, "fresh", "old")
    rows = lambda c: clips.select("vod_id", "clip_id", F.explode(c).alias("c")).select("vod_id", "clip_id", "c.*")
    want = cu.missing_cues(rows("fresh"), rows("old"))
    ids = lambda df: sorted((r.clip_id, r.cue_id) for r in df.collect())
    assert ids(got) == ids(want) and len(ids(got)) > 50
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_cu_missing_shuffles_no_pairs(spark):
    from __spark_entry__ import queries

    plan = queries()["cu_missing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "clip_id" not in "".join(line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Aggregate"))
