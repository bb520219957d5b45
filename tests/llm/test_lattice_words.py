"""Long words and long texts through the relational lattice, against a plain Viterbi in double precision."""

import random

from clipmine.llm import lattice, pieces


def test_words_of_any_length(spark):
    table = pieces.load(pieces.model_file())
    rng = random.Random(7)
    parts = ["an", "the", "tion", "ü", "🦀", "x", "ing", "er", "9", "schau", "日本"]
    long = ["".join(rng.choices(parts, k=n)) for n in (1, 15, 30, 33, 60, 200, 900)] + ["y" * 64, "y" * 65, "z" * 17, "q"]
    words = spark.createDataFrame([(0, w) for w in long], "owner int, word string")
    got = {r.word: r.ids for r in lattice.encoded_words(words, table, 2).collect()}
    assert got == {w: pieces.viterbi(w, table) for w in long}


def test_texts_over_many_chunks(spark, monkeypatch):
    table = pieces.load(pieces.model_file())
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("the an er tion st ü".split(), k=rng.randint(1, 4))) for _ in range(n))
    texts = [prose(rng.randint(0, 40)) for _ in range(60)] + [prose(3000), "w" * (lattice.LONG + 10) + " end", "\n\n a  b \n", "▁ ▁x", None, ""]
    monkeypatch.setattr(lattice, "CHUNK_CHARS", 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lattice.encoded(docs, pieces.model_file()).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        ids = [x for w in pieces.words(text) for x in pieces.viterbi(w, table)]
        assert got[i].ids == ids and got[i].n_pieces == len(ids) and got[i].decoded_chars == len(text) and got[i].round_trip
