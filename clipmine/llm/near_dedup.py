"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A shingle is five consecutive words (lower case; a text of fewer words is one shingle), named by 48 bits of its hash.
Its weight in a text is tf * idf, idf = ln(1 / max(df / n, RARE)) / ln(1 / RARE) and at least `LEAST`: shingles that
fewer than the share `RARE` of the texts hold weigh 1, boilerplate weighs less. df comes from a count-min sketch of
fixed size over all texts. Its error is a share of n that doesn't depend on n (about e * shingles per text / WIDTH),
so weights behave alike at every size; they are a function of the shingle, so the similarity is the exact weighted
Jaccard similarity for them. A large family of near copies makes its own shingles common, and only the edits of its
copies would keep their weight; so a pair is also similar if its Jaccard similarity with all idf at 1 reaches the
threshold. A text that holds a common shingle has a second, plain signature for that; for all others both are the same.

Sampling: a shingle belongs to one of `SAMPLES` bins by its hash; in each bin the shingle with the smallest ICWS value
(r and c gamma, beta uniform, all from its hash) and its quantum t are the sample; an empty bin borrows from another,
tried in an order that only its number decides. So a shingle is drawn for once rather than for every sample. Bands of
`ROWS` samples are the keys under which texts meet.

Texts with the same words are one representative. Texts that meet are compared by their whole signatures, in blocks;
those that can be similar are connected to groups. In its group each such pair is verified, unless links found before
connect it: the larger of the weighted and the plain Jaccard similarity of the whole shingle vectors decides. Both steps give spanning forests of
what they find, so the rows grow with the texts and not with their pairs. Links are merged to classes by label
propagation with pointer jumping.

Defined cases: a null text has no words; texts without words are one class; rows may repeat; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.llm.tables import sized, sorted_groups, stored
from clipmine.llm.words import batches, mix, release, runs, split

SHINGLE, THRESHOLD = 5, 0.8
RARE, LEAST = 0.02, 0.05
DEPTH, WIDTH, SLICES = 3, 1 << 18, 16
SAMPLES, ROWS = 128, 5
#: A pair is verified if its signatures agree in at least this much less than the threshold (4 standard deviations).
MARGIN = 0.15
#: Members of a bucket, and of a group of candidates, that are compared with each other or as many others at once.
BLOCK, GROUP = 1024, 2048
_HALF = np.uint64(0xFFFFFFFF)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: text index, hash (48 bits) and tf of each distinct shingle, sorted; and a digest per text (2 x 64 bits)."""
    _, _, _, h, doc = split([t.lower() for t in texts])
    n = np.bincount(doc, minlength=len(texts))
    run, whole = runs(h, doc, SHINGLE)
    key, at = [run], [doc[whole]]
    first = np.cumsum(n) - n
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        if len(short):
            value = np.zeros(len(short), np.uint64)
            for j in range(k):
                value = mix(value + h[first[short] + j], j)
            key.append(value)
            at.append(short)
    order = np.arange(len(h), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64)
    digest = np.stack([np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(order, s), s))]) for s in (11, 12)])
    last = np.cumsum(n)
    digest = digest[:, last] - digest[:, first]
    coded = np.sort((np.concatenate(at).astype(np.uint64) << np.uint64(48)) | (np.concatenate(key) >> np.uint64(16)))
    new = np.flatnonzero(np.diff(coded, prepend=coded[:1] + np.uint64(1)))
    tf = np.diff(np.append(new, len(coded)))
    coded = coded[new]
    return (coded >> np.uint64(48)).astype(np.int64), coded & np.uint64((1 << 48) - 1), tf, digest


def _cells(h: np.ndarray, depth: int) -> np.ndarray:
    return (mix(h, 100 + depth) & np.uint64(WIDTH - 1)).astype(np.int64)


class Counts:
    """The count-min sketch of document frequencies, and the number of texts with words."""

    def __init__(self, n: int, cells: np.ndarray):
        self.n, self.cells = n, cells

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        df = np.minimum.reduce([self.cells[d][_cells(h, d)] for d in range(DEPTH)])
        share = df / max(1, self.n)
        out = tf.astype(np.float32)
        common = np.flatnonzero(share > RARE)
        out[common] *= np.maximum(LEAST, np.log(1 / np.minimum(share[common], 1)) / np.log(1 / RARE)).astype(np.float32)
        return out


def count_shingles(docs: DataFrame) -> Counts:
    """Sketch of all texts. Every task counts on its own; slices of the counts are added up; their size is fixed."""
    size = DEPTH * WIDTH // SLICES

    def scan(parts):
        cells, n = np.zeros((DEPTH, WIDTH), np.uint32), 0
        for batch in parts:
            for group in batches(zip(batch.column(0).to_pylist())):
                doc, h, _, _ = shingles([t or "" for (t,) in group])
                n += len(np.unique(doc))
                for d in range(DEPTH):
                    cells[d] += np.bincount(_cells(h, d), minlength=WIDTH).astype(np.uint32)
        slices = [zlib.compress(x.tobytes(), 1) for x in cells.reshape(SLICES, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(slices, pa.binary())], ["slice", "n", "cells"])

    def add(key: tuple, parts):
        total, n = np.zeros(size, np.uint64), 0
        for batch in parts:
            n += sum(batch.column("n").to_pylist())
            for x in batch.column("cells").to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "n", "cells"])

    from collections.abc import Iterator

    add.__annotations__ = {"key": tuple, "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "slice int, n long, cells binary"
    rows = docs.select(F.col("text").cast("string")).mapInArrow(scan, schema).groupBy("slice").applyInArrow(add, schema).collect()
    cells = np.zeros((SLICES, size), np.uint64)
    for r in rows:
        cells[r["slice"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint64)
    return Counts(rows[0]["n"] if rows else 0, cells.reshape(DEPTH, WIDTH))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) + 0.5) / 2.0**32


def icws(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of the improved consistent weighted sample of each weighted shingle."""
    a, b, c = (mix(h, s) for s in (21, 22, 23))
    r = -np.log(_unit(a & _HALF) * _unit(a >> np.uint64(32)))
    ln_c = np.log(-np.log(_unit(b & _HALF) * _unit(b >> np.uint64(32))))
    beta = _unit(c & _HALF)
    t = np.floor(np.log(w) / r + beta)
    return ln_c - r * (t - beta) - r, t.astype(np.int64)


def _borrowed(full: np.ndarray) -> np.ndarray:
    """For each bin of each text the bin to read: itself if full, else the first full one of its own sequence."""
    out = np.where(full, np.arange(SAMPLES), -1)
    tried = 0
    while len(at := np.flatnonzero((out < 0) & full.any(1)[:, None])):
        tried += 1
        row, col = np.divmod(at, SAMPLES)
        pick = (mix(np.arange(SAMPLES, dtype=np.uint64), 1000 + tried) % np.uint64(SAMPLES)).astype(np.int64)[col]
        ok = full[row, pick]
        out[row[ok], col[ok]] = pick[ok]
    return out


def signatures(n: int, doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of each of n texts (64 bits each), and which texts have any."""
    ln_a, t = icws(h, w)
    bins = (mix(h, 31) % np.uint64(SAMPLES)).astype(np.int64)
    key = doc * SAMPLES + bins
    order = np.lexsort((h, ln_a, key))
    first = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
    sig, full = np.zeros(n * SAMPLES, np.uint64), np.zeros(n * SAMPLES, bool)
    sig[key[first]] = mix(h[first] ^ mix(t[first].astype(np.uint64), 41), 42)
    full[key[first]] = True
    sig, full = sig.reshape(n, SAMPLES), full.reshape(n, SAMPLES)
    return np.take_along_axis(sig, np.maximum(_borrowed(full), 0), 1), full.any(1)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    count = SAMPLES // ROWS
    key = np.zeros((len(sig), count), np.uint64)
    for j in range(ROWS):
        key = mix(key ^ sig[:, j : count * ROWS : ROWS], 50 + j)
    return key


def _signed(sig: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    key = _band_keys(sig)
    low = (sig & np.uint64(255)).astype(np.uint8)
    return [x.tobytes() + k.tobytes() for x, k in zip(low, key, strict=True)], key.view(np.int64)


def _reweighted(doc: np.ndarray, w: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The texts that hold a shingle whose weight isn't its tf."""
    return np.unique(doc[w != tf])


def sketches(docs: DataFrame, counts: Counts) -> DataFrame:
    """Per row: doc_id, d1 and d2 (a digest of its words), sig, bands.

    sig: a byte of each sample, then the band keys; of the weighted signature and, where it differs, of the plain one.
    bands: the number of the band and the key, each once; none without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def scan(parts):
        for batch in parts:
            for group in batches(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1 << 18):
                texts = [t or "" for _, t in group]
                doc, h, tf, digest = shingles(texts)
                w = shared.value.weights(h, tf)
                sig, full = signatures(len(texts), doc, h, w)
                coded, key = _signed(sig)
                numbers = np.arange(key.shape[1])
                bands = [list(zip(numbers.tolist(), k, strict=True)) if f else [] for k, f in zip(key.tolist(), full, strict=True)]
                if len(two := _reweighted(doc, w, tf)):
                    at = np.isin(doc, two)
                    sig, _ = signatures(len(two), np.searchsorted(two, doc[at]), h[at], tf[at].astype(np.float32))
                    for i, more, plain in zip(two.tolist(), *_signed(sig), strict=True):
                        coded[i] += more
                        new = plain != key[i]
                        bands[i] += zip(numbers[new].tolist(), plain[new].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in group], pa.int64()),
                        pa.array(digest[0].view(np.int64), pa.int64()),
                        pa.array(digest[1].view(np.int64), pa.int64()),
                        pa.array(coded, pa.binary()),
                        pa.array([[{"band": j, "key": k} for j, k in b] for b in bands], pa.list_(pa.struct([("band", pa.int32()), ("key", pa.int64())]))),
                    ],
                    ["doc_id", "d1", "d2", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, d1 long, d2 long, sig binary, bands array<struct<band: int, key: bigint>>")


_SIDE = SAMPLES + SAMPLES // ROWS * 8


class _Signatures:
    """The weighted signatures of the members of a group and, if any member has a second one, the plain ones of all."""

    def __init__(self, coded: list[bytes]):
        sides = [b"".join(c[:_SIDE] for c in coded)]
        if any(len(c) > _SIDE for c in coded):
            sides.append(b"".join(c[-_SIDE:] for c in coded))
        wide = [np.frombuffer(x, np.uint8).reshape(len(coded), _SIDE) for x in sides]
        self.sides = [(x[:, :SAMPLES], np.ascontiguousarray(x[:, SAMPLES:]).view(np.int64)) for x in wide]

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that share a band with i and whose signatures can mean a similarity above the threshold."""
        found = []
        for sig, band in self.sides:
            met = others[(band[others] == band[i]).any(1)]
            agree = (sig[met] == sig[i]).mean(1)
            found.append(met[(agree - 1 / 256) / (1 - 1 / 256) >= THRESHOLD - MARGIN])
        return found[0] if len(found) == 1 else np.union1d(*found)


class _Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def joined(self, i: int, j: int) -> bool:
        """Join i and j; whether they were apart."""
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _in_blocks(members: DataFrame, keys: list[str], size: int) -> DataFrame:
    """`members` (with `members` rows for their keys) dealt to pairs of blocks of about `size`: lo, hi, own."""
    blocks = F.ceil(F.col("members") / size).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks.cast("long")).cast("int")
    rest = [c for c in members.columns if c != "members"]
    dealt = members.select(*rest, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select(*rest, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    at = [*keys, "lo", "hi"]
    return dealt.repartition(*at).sortWithinPartitions(*at, "row")


def _sides(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    """Each member of the lower block with the members that it is to be compared with."""
    own = table.column("own").to_numpy()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    return [(int(i), right[right > i] if lo == hi else right) for i in left]


def candidates(reps: DataFrame) -> DataFrame:
    """Links a - b between representatives (`row`) that may be similar: enough of them to connect all that may.

    Members of a bucket are compared by their signatures. A task gives a spanning forest of the pairs that it finds,
    so a bucket of n members makes less than n links.
    """
    postings = reps.select("row", F.explode("bands").alias("b")).select("row", "b.band", "b.key")
    sizes = postings.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = postings.join(sizes, ["band", "key"]).join(reps.select("row", "sig"), "row")

    def compare(parts):
        for table in sorted_groups(parts, ["band", "key", "lo", "hi"]):
            if len(table) < 2:
                continue
            row, forest = table.column("row").to_numpy(), _Forest(len(table))
            signed = _Signatures(table.column("sig").to_pylist())
            found = [(i, int(j)) for i, others in _sides(table) for j in signed.alike(i, others) if forest.joined(i, int(j))]
            if found:
                a, b = row[[i for i, _ in found]], row[[j for _, j in found]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return _in_blocks(met, ["band", "key"], BLOCK).mapInArrow(compare, "a long, b long").distinct()


def _vectors(docs: DataFrame, counts: Counts) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def scan(parts):
        for batch in parts:
            for group in batches(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1 << 18):
                texts = [t or "" for _, t in group]
                doc, h, tf, digest = shingles(texts)
                w = shared.value.weights(h, tf)
                edge = np.searchsorted(doc, np.arange(len(texts) + 1))
                packed = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                both = np.stack([w, tf]).astype("<f4")
                two = set(_reweighted(doc, w, tf).tolist())
                vec = [(packed[a:b].tobytes(), zlib.compress(both[: 1 + (i in two), a:b].tobytes(), 1)) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in group], pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array([a for a, _ in vec], pa.binary()), pa.array([b for _, b in vec], pa.binary())],
                    ["doc_id", "d1", "d2", "h", "w"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, d1 long, d2 long, h binary, w binary")


def _vector(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a text, and their weights and frequencies (one row each)."""
    wide = np.zeros((len(h) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
    both = np.frombuffer(zlib.decompress(w), "<f4").astype(np.float64).reshape(-1, len(wide))
    return wide.view("<u8").ravel(), both[[0, -1]]


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the weighted and the plain Jaccard similarity of two vectors with sorted keys."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][:, i], y[1][:, j]).sum(1)
    return float((both / np.maximum(x[1].sum(1) + y[1].sum(1) - both, 1e-300)).max())


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, counts: Counts) -> DataFrame:
    """Links a - b of similarity above the threshold, enough of them to connect all that are linked.

    `groups` (`row`, `root`; stored) are the candidates that are connected. The vector of each goes to its group once,
    or once for each block of a large group. There every pair that `candidates` stands for is verified, unless
    links found before connect it.
    """
    used = stored(reps.join(groups, "row").select("row", "root", "doc_id", "d1", "d2", "sig"))
    n = used.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(sized(used.select("doc_id").distinct(), n, 16), "doc_id", "left_semi").unionByName(texts.where("doc_id IS NULL"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    ids = used.select("row", F.col("doc_id").alias("i"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    vectors = _vectors(texts, counts).join(sized(ids, n, 40), same).select("row", "h", "w").dropDuplicates(["row"])
    sizes = used.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = used.select("row", "root", "sig").join(sizes, "root").join(vectors, "row")

    def check(parts):
        for table in sorted_groups(parts, ["root", "lo", "hi"]):
            row, forest = table.column("row").to_numpy(), _Forest(len(table))
            signed = _Signatures(table.column("sig").to_pylist())
            h, w = table.column("h").to_pylist(), table.column("w").to_pylist()
            a, b = [], []
            for i, others in _sides(table):
                own = None
                for j in signed.alike(i, others).tolist():
                    if forest.root(i) == forest.root(j):
                        continue
                    own = own or _vector(h[i], w[i])
                    if similarity(own, _vector(h[j], w[j])) >= THRESHOLD:
                        forest.joined(i, j)
                        a.append(row[i])
                        b.append(row[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return _in_blocks(members, ["root"], GROUP).mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(`row`, `root`): the smallest row that each linked row is connected with. `links` must be stored.

    Each round points every row at the smallest of itself and its neighbours, follows the pointers twice and contracts
    the links to links between targets, each once. What is joined shrinks with every round, so a group in which
    most rows are linked with each other is read once in full, not in every round. Rounds are written down.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        to = stored(ends.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        for _ in range(2):
            jump = to.select(F.col("row").alias("via"), F.col("to").alias("further"))
            to = stored(to.join(jump, F.col("to") == F.col("via"), "left").select("row", F.coalesce("further", "to").alias("to")))
        step = to.select(F.col("row").alias("root"), "to")
        labels = to.withColumnRenamed("to", "root") if labels is None else labels.join(step, "root", "left").select("row", F.coalesce("to", "root").alias("root"))
        labels = stored(labels)
        left = edges.join(to.select(F.col("row").alias("a"), F.col("to").alias("x")), "a")
        both = left.join(to.select(F.col("row").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.limit(1).count() == 0:
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the smallest doc_id of its class), class_size, kept (one of each class)."""
    counts = count_shingles(docs)
    sketched = stored(sketches(docs, counts), "row")
    texts = stored(sketched.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("copies")).select("d1", "d2", "m.doc_id", "m.row", "copies"))
    reps = sketched.join(texts.select("row"), "row")
    groups = components(stored(candidates(reps)))
    links = stored(verified(docs, reps, groups, counts))
    linked = texts.join(components(links), "row", "left").withColumn("root", F.coalesce("root", "row"))
    best = linked.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.sum("copies").alias("class_size"))
    of_text = linked.join(best, "root").select("d1", "d2", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("best_row"), "class_size")
    return sketched.select("doc_id", "d1", "d2", "row").join(of_text, ["d1", "d2"]).select("doc_id", "class_id", "class_size", (F.col("row") == F.col("best_row")).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class, with all columns. Rows that share a doc_id stay if one of them does."""
    found = stored(classes(docs).select("doc_id", "kept"))
    stay = found.where("kept").select(F.col("doc_id").alias("_near_stay"))
    gone = found.where(~F.col("kept")).join(stay, F.col("doc_id").eqNullSafe(F.col("_near_stay")), "left_anti").select(F.col("doc_id").alias("_near_gone")).distinct()
    gone = stored(gone)
    return docs.join(sized(gone, gone.count(), 16), F.col("doc_id").eqNullSafe(F.col("_near_gone")), "left_anti")
