"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipmine.llm import chat, exact_dedup, language, lattice, near_dedup, nearest, packing, pieces, rice, sharding, substring_dedup, token_counts, words

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    parts = "an er in th on re st at en or la de el os qu ment tion le".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows, equal lengths."""
    rng = random.Random(5)
    shared = prose(rng, 35)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [f"{prose(rng, 12)} {shared} {prose(rng, 9)}" for _ in range(9)]
    long = prose(rng, 9000)
    base = prose(rng, 200)
    edited = base.split()
    edited[100] = "changed"
    texts += [long, long + "\n", f" {long}", base, " ".join(edited), base.upper(), None, "", "  \t\n", "...", "ü", "🦀 🦀 ok", "a", "a", "x" * 700]
    texts += [f"{base}\t{shared}  {shared}", "<|endoftext|> in a text", "tab\there  two", " lead", "trail "]
    out = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], (4, texts[4] + " other", "en", None, 0), (None, "no number", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/d"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    names = "row fp sha sender suspect chunk owner box piece start length bins block island number total shard slot a b h w sig bands d1 d2 word ids".split()
    return docs.withColumns({n: F.lit("extra") for n in names})


# words and codes


def test_runs_name_word_sequences():
    texts = ["a b c d e", "x a b c d e", "", "a\tb c d", "ß ß ß"]
    _, start, end, h, doc = words.split(texts)
    assert doc.tolist() == [k for k, t in enumerate(texts) for _ in re.findall(r"[^\x20\x09-\x0D]+", t)]
    run, whole = words.runs(h, doc, 3)
    named = defaultdict(set)
    for r, i in zip(run, np.flatnonzero(whole)):
        raw = words.split(texts)[0]
        named[int(r)].add(tuple(raw[start[j] : end[j]] for j in range(i, i + 3)))
    assert all(len(v) == 1 for v in named.values()) and len(named) == 3 + 1 + 1 + 1


def test_golomb_coding_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2**63), (2, 2), (1000, 2**64 - 1), (200_000, 2**48)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (rice.decode(rice.encode(v)) == v).all()
    v = np.unique(rng.integers(0, 2**48, 100_000, dtype=np.uint64))
    assert len(rice.encode(v)) * 8 / len(v) < 48 - math.log2(len(v)) + 3
    assert rice.flags(rice.bitmap(np.array([True, False, True])), 3).tolist() == [True, False, True]


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(p) == list(range(n)) and (sharding.permute(p, n, seed=3, inverse=True) == np.arange(n)).all()


def test_shards_are_even_gapless_and_repeatable(docs, empty):
    keyed = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    out = sharding.sharded(keyed, 7).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.sharded(keyed.repartition(5), 7).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    r = out[5]
    assert sharding.number_at(r["shard"], r["slot"], len(out), 7) == r["number"]
    assert sharding.sharded(empty.select("doc_id"), 7).count() == 0


# exact copies


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((len(t or ""), i))
    return groups


def test_exact_dedup(docs, rows, clashing, empty):
    groups = brute_exact(rows)
    expected = Counter()
    for norm, members in groups.items():
        best = max(members, key=lambda m: (m[0], -(m[1] if m[1] is not None else 10**9)))
        for _, i in members:
            expected[i, best[1], len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    out = exact_dedup.duplicates(clashing).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == expected
    assert sum(r["kept"] for r in out) == len(groups)
    assert exact_dedup.duplicates(empty).count() == 0
    stay = exact_dedup.kept(clashing)
    assert stay.columns == clashing.columns and stay.count() == len(groups)
    assert exact_dedup.kept(empty).count() == 0


def test_bitmaps_find_every_repeated_fingerprint(spark):
    rng = random.Random(2)
    fps = [rng.choice([rng.randint(-(2**63), 2**63 - 1), 7, -9]) for _ in range(400)]
    rows = spark.createDataFrame([(f, i % 8, i) for i, f in enumerate(fps)], "fp long, sender int, row long")
    out = exact_dedup.suspects(rows, 3).collect()
    count = Counter(fps)
    assert len(out) == 400 and all(r["suspect"] == (count[r["fp"]] > 1) for r in out)


# near copies


def brute_near(rows):
    split = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] for _, t, *_ in rows]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in split]
    df, n = Counter(k for s in sets for k in s), sum(map(bool, sets))
    idf = {k: max(0.05, math.log(n / c) / math.log(50)) if c / n > 0.02 else 1.0 for k, c in df.items()}
    links = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = sum(min(sets[i][k], sets[j][k]) * idf[k] for k in sets[i].keys() & sets[j].keys())
        every = sum(c * idf[k] for s in (sets[i], sets[j]) for k, c in s.items()) - both
        if split[i] == split[j] or (every and both / every >= 0.8):
            links.add((i, j))
    return links


def test_near_dedup_classes(docs, rows, clashing, empty):
    named = [r for r in rows if r[0] is not None and not (r[0] == 4 and r[1].endswith("other"))]
    root = list(range(len(named)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_near(named):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    expected = Counter((named[i][0], min(named[k][0] for k in range(len(named)) if find(k) == find(i))) for i in range(len(named)))
    usual = clashing.where("doc_id is not null and not (doc_id = 4 and text like '%other')")
    out = near_dedup.classes(usual).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == expected
    assert sum(r["kept"] for r in out) == len({c for _, c in expected})
    assert near_dedup.classes(docs).count() == len(rows)
    assert near_dedup.classes(empty).count() == 0
    assert near_dedup.kept(clashing).columns == clashing.columns


def test_near_copies_in_a_family_of_a_third_of_all_rows(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(100)]
    texts = [" ".join(base)]
    for k in range(300):
        copy = list(base)
        for at in [rng.randrange(5, 45), rng.randrange(50, 95)][: 1 + k % 2]:
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(60)) + f" {' '.join(base[:20])}" for _ in range(600)]
    out = near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: 0 if i <= 300 else i for i in range(len(texts))}
    assert sum(r["kept"] for r in out) == 601


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(4)
    agree = []
    for k in range(60):
        h = rng.integers(0, 2**48, 240).astype(np.uint64)
        w = rng.choice([0.3, 1.0, 2.0], 240).astype(np.float32)
        at = [np.arange(200), np.arange(40, 240)]
        sig, _ = near_dedup.signatures(2, np.repeat([0, 1], 200), np.concatenate([h[i] for i in at]), np.concatenate([w[i] for i in at]))
        true = w[40:200].sum() / w.sum()
        agree.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(agree)) < 0.02


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    out = {r["row"]: r["root"] for r in near_dedup.components(links).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# passages


def brute_passages(rows):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (run := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(run)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept))
    return out


def test_passages(docs, rows, clashing, empty, spark):
    once = rows[:-3]  # doc_id is a key here
    expected = {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_passages(once)}
    usual = spark.createDataFrame(once, DOCS)
    assert set(map(tuple, substring_dedup.report(usual).collect())) == expected
    assert sum(e[2] for e in expected) > 9000
    assert substring_dedup.report(clashing).count() == len(rows)
    assert substring_dedup.report(empty).count() == 0
    texts = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.deduplicated(usual).collect()}
    for i, _, k, kept in brute_passages(once):
        assert texts[i] == (kept if k else once[i][1], k)


def test_passages_do_not_depend_on_chunks(spark, docs, tmp_path):
    once = docs.join(docs.groupBy("doc_id").count().where("count = 1"), "doc_id").select(*docs.columns)
    found = []
    for k, files in enumerate((1, 7)):
        once.repartition(files).write.parquet(f"file://{tmp_path}/{k}")
        found.append(sorted(map(tuple, substring_dedup.report(spark.read.parquet(f"file://{tmp_path}/{k}")).collect())))
    found.append(sorted(map(tuple, substring_dedup.report(once).collect())))  # not from files
    assert found[0] == found[1] == found[2] and any(r[2] for r in found[0])


def test_groups_of_many_short_texts():
    groups = list(words.batches([("ok",)] * 70_000, 1 << 20))
    assert [len(g) for g in groups] == [65_536, 4_464]
    doc, *_ = near_dedup.shingles(["ok"] * 65_536)
    assert len(doc) == 65_536 and doc[-1] == 65_535


def test_long_texts_are_read_in_parts():
    rng = random.Random(4)
    text = prose(rng, 120_000)
    parts = language.pieces(text)
    assert len(parts) > 1 and "".join(parts) == text and all(len(p) <= 2 * language.PIECE for p in parts)
    assert language.pieces("x" * (3 * language.PIECE))[0] == "x" * language.PIECE
    weights = np.zeros((language.WIDTH + 1, 2), np.float32)
    weights[: language.WIDTH] = np.random.default_rng(1).normal(size=(language.WIDTH, 2))
    short = [prose(rng, n) for n in (1, 7, 90)]
    by_vector = np.stack([language.vector(t) @ weights[: language.WIDTH] for t in [*short, text]])
    assert np.allclose(language.means([*short, text], weights), by_vector, atol=1e-4)


def test_equal_scores_at_the_cut_go_to_smaller_ids():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 4, (50, 40)).astype(float), rng.permutation(40)
    for n in (1, 7, 39, 40, 50):
        for row, top in zip(score, nearest.largest(score, ids, n), strict=True):
            assert set(top) == set(np.lexsort((ids, -row))[:n])


# language


def test_language_by_family_and_pairs(spark, empty, clashing):
    rng = random.Random(3)
    syllables = {"en": "th er on an ing ed", "de": "ein ch sch und keit er", "fr": "eau oi ai les que tion", "es": "os ci ado la ero ño"}
    rows, i = [], 0
    for lang, s in syllables.items():
        for _ in range(80):
            rows.append((i, " ".join("".join(rng.choices(s.split(), k=3)) for _ in range(40)), lang))
            i += 1
    docs = spark.createDataFrame([*rows, (i, None, "en"), (i + 1, "12 ...", "en"), (i + 2, "", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    assert sorted(model.families) == ["germanic", "romance"]
    out = language.predicted(docs, model, ["doc_id", "lang"]).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    test = [r for r in out if r["out"] and r["doc_id"] < i]
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.97 * len(test) > 40
    assert {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] >= i} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in out)
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.predicted(clashing, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language.predicted(docs.where("doc_id < 100"), one).collect()} == {"en"}
    assert language.predicted(empty, model).count() == 0


# neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 900)] + 0.6 * rng.standard_normal((900, 24))
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 24), (1020, [float("nan")] + [1.0] * 23), (1040, [None] + [1.0] * 23), (1060, []), (None, [1.0] * 24), (1080, [1.0, 2.0])]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def test_neighbours_against_all(vectors, spark):
    x, df = vectors
    out = nearest.nearest(df, F.col("id") % 20 == 0, 10).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:10]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 10 and all(abs(s[i] - v) < 1e-9 for i, v in found)
    assert hits >= 0.9 * 10 * len(got)
    small = nearest.nearest(df.where("vec_id < 5"), F.col("id") % 20 == 0, 10).collect()
    assert len(small) == 4
    assert nearest.nearest(df.where("vec_id < 0"), F.col("id") % 20 == 0, 10).count() == 0


def recall(x, out, k):
    got = defaultdict(set)
    for r in out:
        got[r["query_id"]].add(r["vec_id"])
    best = {q: set(np.argsort(np.where(np.arange(len(x)) == q, -np.inf, x @ x[q]))[-k:].tolist()) for q in got}
    return np.mean([len(got[q] & best[q]) / k for q in got])


def test_neighbours_of_mixed_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 64))[rng.integers(0, 200, 40_000)] + 0.6 * rng.standard_normal((40_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.random(len(x)) < 0.03] *= 0.9
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    assert recall(x, nearest.nearest(df, F.col("id") % 400 == 0, 10).collect(), 10) >= 0.9


def test_probes_grow_until_recall_holds():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shape = nearest.Shape(len(x), 1.0, True, 10_000)

    def neighbours(q):
        score = x[q] @ x.T
        score[np.arange(len(q)), q] = -1
        return x[np.argpartition(-score, 20, 1)[:, :20].ravel()], np.repeat(np.arange(len(q)), 20)

    def found(q, count):
        best, of = neighbours(q)
        visits, own = nearest.probes(x[q], shape.rows, count), nearest.codes(best, shape.rows)
        return np.mean([(visits[i] == c[:, None]).any() for i, c in zip(of, own)])

    asked, others = np.arange(0, 100), np.arange(100, 200)
    count = nearest.probes_for(x[asked], *neighbours(asked), shape)
    assert found(others, nearest.PROBES) < 0.9 <= found(others, count)


def test_bucket_work_does_not_grow():
    for rows in (10, 10_000, 10**6, 10**9):
        buckets = math.prod(2 * a for a in nearest.axes_for(rows, 64))
        assert rows / buckets <= 64
    y = np.random.default_rng(0).standard_normal((4, 16))
    assert np.allclose(np.linalg.norm(nearest.hadamard(y), axis=1), np.linalg.norm(y, axis=1))


# tokens


def unigram_library():
    """The library's unigram encoder over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(pieces.model_file(), "rb") as f:
        m.ParseFromString(f.read())
    least = min(p.score for p in m.pieces if p.type == 1 and p.score > pieces.FLOOR)
    for p in m.pieces:
        p.score = least - 1 if p.type == 1 and p.score < pieces.FLOOR else p.score
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_lattice_equals_the_library_and_reads_back(docs, rows, clashing, empty):
    library = unigram_library()
    out = lattice.encoded(clashing, pieces.model_file())
    found = out.collect()
    text_of = defaultdict(set)
    for i, t, *_ in rows:
        text_of[i].add(t or "")
    by_ids = defaultdict(set)
    for r in found:
        assert r["round_trip"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["n_pieces"] == len(r["ids"])
        by_ids[r["doc_id"]].add(tuple(r["ids"]))
    for i, texts in text_of.items():
        if all(len(t) < 500 for t in texts):  # the library's sums are 32-bit floats, exact for short texts only
            assert by_ids[i] == {tuple(library.encode(t)) for t in texts}
    assert len(found) == len(rows)
    back = {(r["doc_id"], r["text"]) for r in lattice.decoded(out, pieces.model_file()).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows}
    assert lattice.encoded(empty, pieces.model_file()).count() == 0


def test_trie_counts_equal_the_lattice(docs, rows, clashing, empty, monkeypatch):
    ids = Counter((r["doc_id"], r["n_pieces"]) for r in lattice.encoded(docs, pieces.model_file(), keep_ids=False).collect())
    counts = token_counts.token_counts(clashing, pieces.model_file()).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counts) == ids and len(counts) == len(rows)
    assert token_counts.token_counts(empty, pieces.model_file()).count() == 0
    table = pieces.load(pieces.model_file())
    small, large = token_counts.Trie(table), token_counts.Trie(table)
    some = [w for _, t, *_ in rows for w in pieces.words(t or "")]
    expected = [large.counts[w] for w in some]
    monkeypatch.setattr(token_counts, "NODES", 50)
    monkeypatch.setattr(token_counts, "WORDS", 20)
    assert [small.counts[w] for w in some] == expected == [len(pieces.viterbi(w, table)) for w in some]


# packing


def test_encoder_equals_the_tokenizer_file(rows):
    from tokenizers import Tokenizer

    paths = packing.tokenizer_files()
    encode, file = packing.Encoder(*paths), Tokenizer.from_file(paths[0])
    for _, t, *_ in rows:
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == file.encode(t or "", add_special_tokens=False).ids


def test_packing(docs, rows, clashing, empty):
    capacity = 64
    out = packing.placements(clashing, capacity).collect()
    encode = packing.Encoder(*packing.tokenizer_files())
    expected = Counter()
    for i, t, *_ in rows:
        ids = np.append(np.frombuffer(encode(t or ""), "<u4"), np.uint32(2)).astype("<u4")
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            expected[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in out)
    assert len(bins) <= math.ceil(total / capacity) * 1.05 + 1
    assert packing.placements(empty).count() == 0
    made = packing.sequences(docs.where("doc_id < 20"), capacity).collect()
    assert all(len(r["ids"]) <= 4 * capacity for r in made)


def test_genetic_search_improves_on_best_fit():
    rng = np.random.default_rng(8)
    gains = []
    for k in range(6):
        lengths = rng.integers(20, 70, 300)
        start = packing.evolve(lengths, [], 100, k, generations=0)
        after = packing.evolve(lengths, start, 100, k, generations=12)
        for p in (*start, *after):
            assert np.bincount(p, lengths).max() <= 100
        a, b = (packing.Packing(p[0], lengths, 100).score for p in (start, after))
        assert b >= a
        gains.append(b > a)
    assert any(gains)


# chat


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be # <kind>"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "x\ny\\h"), (2, 0, "user", "only"), (3, None, None, "odd"), (3, 0, "role: #1", ""), (None, 0, "assistant", "🦀"), (4, 0, "assistant", ""), (4, 0, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("extra"))
    output = chat.formatted(turns)
    got = {r["conv_id"]: r for r in chat.read_back(output).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(mine), len(said))
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = defaultdict(str)
    for r in sorted(output.collect(), key=lambda r: (r["conv_id"] or 0, r["place"])):
        assert len(whole[r["conv_id"]]) == r["start"] and r["segment"].count("### ") == r["segment"].count("</turn>") == 1
        whole[r["conv_id"]] += r["segment"]
    made = chat.examples(output).collect()
    assert len(made) == 5
    for e in made:
        assert (whole[e["conv_id"]] + " ").startswith(e["context"] + e["reply"])
    assert {chat.unescape(e["reply"]) for e in made} == {hard, "x\ny\\h", "🦀", "", "tie"}
    assert chat.read_back(chat.formatted(turns.where("conv_id = 99"))).count() == 0
