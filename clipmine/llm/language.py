"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family.

Features of a text are the relative frequencies of its letters' n-grams (one to three characters, lower case, every
other character a gap), hashed into `WIDTH` columns. A linear score of frequencies is the mean of the weights of a
text's n-grams, so the prediction reads each text once and builds no vectors. A family is found by
one-versus-rest linear SVMs, a language by the votes of the SVMs of all pairs in the family. Which languages belong
together is given by `FAMILIES`, public knowledge; a language not named there is a family of its own.

Fitting takes at most `PER_LANGUAGE` labelled rows of each language (those with the smallest hash of doc_id): a fixed
bound, so the models don't grow with the table. The models are fitted in parallel, each on its own task.

Defined cases: a text that is null or has no letter gets `und` and score 0; so does every text when no row is
labelled; with one language every text gets it with score 1; the label may be any non-null string; rows may repeat;
a text of more than twice `PIECE` characters is read in parts, as if each were a text, and their sums are added; extra
columns are ignored. A model is fitted in one task on at most `PER_LANGUAGE` rows of each of its languages.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.llm.tables import sized, stored
from clipmine.llm.words import batches, mix, release

UNDETERMINED = "und"
WIDTH = 1 << 14
PER_LANGUAGE = 600
#: Characters of a text that are read at once.
PIECE = 1 << 18
_SPACE = re.compile(r"\s+")
#: Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz tk ky".split(),
    "indic": "hi mr ne bn gu pa ur".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of all n-grams of all texts, and how many each text has."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    counts = np.array([len(c) for c in codes])
    x = np.concatenate(codes).astype(np.uint64)
    x[_gap(x)] = 32
    again = (x[1:] == 32) & (x[:-1] == 32)
    again[np.cumsum(counts)[:-1] - 1] = False  # a text begins with a gap, whatever text stands before it
    x[1:][again] = 0  # of several gaps one counts
    one = mix(x, 1)
    two = mix(one[:-1] * np.uint64(3) + one[1:], 2)
    three = mix(one[:-2] * np.uint64(9) + one[1:-1] * np.uint64(3) + one[2:], 3)
    out = np.full((3, len(x)), -1, np.int32)
    for row, h in zip(out, (one, two, three), strict=True):
        row[: len(h)] = (h & np.uint64(WIDTH - 1)).astype(np.int32)
    last = np.cumsum(counts) - 1  # n-grams don't reach into the next text
    out[1, last] = -1
    out[2, last] = -1
    out[2, last - 1] = -1
    zero = x == 0
    out[:, zero] = -1
    out[1, :-1][zero[1:]] = -1
    out[2, :-1][zero[1:]] = -1
    out[2, :-2][zero[2:]] = -1
    return out, counts


def _gap(x: np.ndarray) -> np.ndarray:
    """What can't be part of a word: controls, ASCII and Latin-1 signs and digits, general punctuation, private use."""
    letter = ((x >= 97) & (x <= 122)) | ((x >= 192) & (x != 215) & (x != 247) & ~((x >= 0x2000) & (x < 0x2C00)) & ~((x >= 0x3000) & (x < 0x3005)) & ~((x >= 0xE000) & (x < 0xF900)))
    return ~letter


def pieces(text: str) -> list[str]:
    """A very long text in parts of `PIECE` characters or a little more, cut at white space where there is any."""
    out = []
    while len(text) > 2 * PIECE:
        gap = _SPACE.search(text, PIECE, 2 * PIECE)
        end = gap.end() if gap else PIECE
        out.append(text[:end])
        text = text[end:]
    return [*out, text]


def means(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Per text and model the mean weight of its n-grams; `weights` has a row per column and one of zeros at its end.

    The parts of a very long text are read one after the other, so memory doesn't grow with it.
    """
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for group in batches([(i, part) for i, text in enumerate(texts) for part in pieces(text)], 2 * PIECE):
        at = np.array([i for i, _ in group])
        cols, counts = grams([part for _, part in group])
        starts = np.cumsum(counts) - counts
        for row in cols:
            np.add.at(total, at, np.add.reduceat(weights[row], starts, axis=0))
            np.add.at(n, at, np.add.reduceat((row >= 0).astype(np.int64), starts))
    return total / np.maximum(n, 1)[:, None]


def vector(text: str) -> np.ndarray:
    """Relative frequencies of one text's n-grams."""
    total = np.zeros(WIDTH, np.int64)
    for part in pieces(text):
        cols = grams([part])[0].ravel()
        total += np.bincount(cols[cols >= 0], minlength=WIDTH)
    return (total / max(1, total.sum())).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by accelerated gradient steps; y is +1 or -1, both sides weigh the same. `x` is used up."""
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    z = x
    z *= scale  # in place: the rows are the largest thing in the task
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * float((share * np.einsum("ij,ij->i", z, z)).sum()) + penalty + 1e-12)
    w = v = np.zeros(x.shape[1], np.float32)
    b = c = 0.0
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (z @ v + c)).astype(np.float32) * y * share
        w_new, b_new = v + step * 8 * (z.T @ short) - step * penalty * v, c + step * 8 * float(short.sum())
        m = k / (k + 3)
        v, c = w_new + m * (w_new - w), b_new + m * (b_new - b)
        w, b = w_new, b_new
    return w * scale, b


class Model:
    """The fitted SVMs: one weight column per family, then one per pair of languages of a family."""

    def __init__(self, langs: list[str], columns: dict[str, tuple[np.ndarray, float]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(columns)
        self.weights = np.zeros((WIDTH + 1, len(self.names)), np.float32)
        self.bias = np.zeros(len(self.names))
        for j, name in enumerate(self.names):
            self.weights[:WIDTH, j], self.bias[j] = columns[name]
        self.at = {name: j for j, name in enumerate(self.names)}

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.families:
            return [(UNDETERMINED, 0.0)] * len(texts)
        margins = (means(texts, self.weights) if self.names else np.zeros((len(texts), 0))) + self.bias
        families = sorted(self.families)
        if len(families) > 1:
            f = margins[:, [self.at[f"family {x}"] for x in families]]
            chosen, sure = np.argmax(f, 1), _sigmoid(np.max(f, 1))
        else:
            chosen, sure = np.zeros(len(texts), int), np.ones(len(texts))
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        for k, family in enumerate(families):
            rows = np.flatnonzero(chosen == k)
            langs = self.families[family]
            votes, belief = np.zeros((len(rows), len(langs))), np.ones((len(rows), len(langs)))
            for i, j in itertools.combinations(range(len(langs)), 2):
                m = margins[rows, self.at[f"pair {langs[i]} {langs[j]}"]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                belief[:, i] *= _sigmoid(m)
                belief[:, j] *= _sigmoid(-m)
            best = np.argmax(votes + belief / 2, 1)
            for r, lang, p in zip(rows, best, belief[np.arange(len(rows)), best], strict=True):
                out[r] = (langs[lang], float(min(1.0, max(0.0, p * sure[r]))))
        return out


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows of doc_id, text, lang (all given). The bound on rows is `per_language` a language."""
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    # The cut is found on the hashes alone, so that no task gathers texts of a language.
    ranked = usable.select("lang", "order")
    for part in (["lang", F.pmod("order", F.lit(64))], ["lang"]):  # a language may hold a third of all rows
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("order"))).where(F.col("rank") <= per_language).drop("rank")
    cuts = stored(ranked.groupBy("lang").agg(F.max("order").alias("cut")).select(F.col("lang").alias("of_lang"), "cut"))
    langs = sorted(r[0] for r in cuts.select("of_lang").toLocalIterator())
    first = usable.join(sized(cuts, len(langs), 256), F.col("lang") == F.col("of_lang")).where(F.col("order") <= F.col("cut"))
    by_family: dict[str, list[str]] = {}
    for lang in langs:
        by_family.setdefault(family_of(lang), []).append(lang)
    tasks = [(f"family {f}", lang, 1 if lang in by_family[f] else -1) for f in by_family for lang in langs] if len(by_family) > 1 else []
    for members in by_family.values():
        for a, b in itertools.combinations(members, 2):
            tasks += [(f"pair {a} {b}", a, 1), (f"pair {a} {b}", b, -1)]
    if not tasks:
        return Model(langs, {})

    def features(batches):
        for batch in batches:
            rows = [vector(t) for t in batch.column("text").to_pylist()]
            packed = [(np.flatnonzero(v).astype("<u2").tobytes(), v[v > 0].astype("<f4").tobytes()) for v in rows]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array([a for a, _ in packed], pa.binary()), pa.array([b for _, b in packed], pa.binary())], ["lang", "order", "cols", "freqs"])

    def train(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("side", "ascending")])  # sums then don't depend on the shuffle
        cols = [np.frombuffer(c, "<u2") for c in table.column("cols").to_pylist()]
        used = np.unique(np.concatenate(cols))
        x = np.zeros((len(table), len(used)), np.float32)
        for i, (c, f) in enumerate(zip(cols, table.column("freqs").to_pylist(), strict=True)):
            x[i, np.searchsorted(used, c)] = np.frombuffer(f, "<f4")
        w, b = fit_svm(x, table.column("side").to_numpy().astype(np.float32))
        full = np.zeros(WIDTH, np.float32)
        full[used] = w
        del x, cols
        release()
        return pa.table({"name": [key[0].as_py()], "w": pa.array([full.tobytes()], pa.binary()), "b": [float(b)]})

    spark = labelled.sparkSession
    plan = F.broadcast(spark.createDataFrame(tasks, "name string, task_lang string, side int"))
    vectors = first.select("lang", "order", "text").mapInArrow(features, "lang string, order long, cols binary, freqs binary")
    fitted = vectors.join(plan, F.col("lang") == F.col("task_lang")).select("name", "side", "order", "cols", "freqs").groupBy("name").applyInArrow(train, "name string, w binary, b double")
    return Model(langs, {r["name"]: (np.frombuffer(r["w"], np.float32), r["b"]) for r in fitted.collect()})


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` (the columns `keep`, by default doc_id) with the language and its score, called `names`, from the text alone."""
    keep = keep or ["doc_id"]
    own = "text" if "text" in keep else "_text"
    rows = docs.select(*keep, *([] if own in keep else [F.col("text").cast("string").alias(own)]), has_letter(F.col("text")).alias("_letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(parts):
        for batch in parts:
            letters, texts = batch.column("_letters").to_pylist(), batch.column(own).to_pylist()
            found: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
            for group in batches([(i, t) for i, t in enumerate(texts) if letters[i]], 1 << 19):
                for (i, _), hit in zip(group, shared.value.predict([t for _, t in group]), strict=True):
                    found[i] = hit
            out = batch.select(keep)
            yield out.append_column(names[0], pa.array([a for a, _ in found], pa.string())).append_column(names[1], pa.array([b for _, b in found], pa.float64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes) + f", `{names[0]}` string, `{names[1]}` double"
    return rows.mapInArrow(scan, schema)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model sees: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))
