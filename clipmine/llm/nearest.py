"""Approximate nearest neighbours by cross-polytope hashing with fast pseudo-rotations and multiprobe.

A vector is scaled to length 1, padded to a power of two and rotated by three rounds of random signs and a fast
Hadamard transform; its hash is the nearest signed axis. For inner products of vectors of different lengths one
more coordinate makes the lengths equal: sqrt(M^2 - |x|^2) for rows, 0 for queries, M the largest length. Whether it is
needed is decided once for all vectors with the same number of components, from their norms. A table's
bucket joins as many hashes as make about `ROWS_PER_BUCKET` rows a bucket (the last hash over fewer axes). Each of
`TABLES` tables is probed in the buckets nearest to the query; candidates are scored exactly and the best of all tables
kept. The same number of probes finds a smaller part of a larger table, so it is measured: about `SAMPLE` queries are
searched exactly, and from `PROBES` on the number is doubled until `RECALL` of their neighbours lie in probed buckets.

Equal vectors are one representative with its `k + 1` smallest ids, which are all that a list of k can need. A bucket
of more than `SPLIT` rows is split and its queries visit every part. A query that finds fewer rows than asked for is
searched exactly, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; only vectors of the same length are compared; ids may repeat only with equal vectors; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmine.llm.tables import sized, sorted_groups, stored

TABLES, PROBES = 28, 8
ROWS_PER_BUCKET, SPLIT = 64, 4096
#: The share of neighbours to find, with a margin over the 0.9 asked for, and the queries it is measured on.
RECALL, SAMPLE = 0.95, 256
#: Ways to combine the hashes of a bucket that are looked at in one step, for all queries of the step.
_WAYS = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, of the same length."""
    rows, n = x.shape
    step = 1
    while step < n:
        y = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


def axes_for(rows: int, width: int) -> list[int]:
    """Over how many axes each hash of a bucket goes: powers of two, at most `width`."""
    bits, most = max(1, math.ceil(math.log2(max(2, rows / ROWS_PER_BUCKET)))), int(math.log2(width)) + 1
    return [2 ** (min(most, bits - i) - 1) for i in range(0, bits, most)]


def _rotated(x: np.ndarray, table: int, part: int, width: int) -> np.ndarray:
    signs = np.random.default_rng([7, table, part, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def codes(x: np.ndarray, rows: int) -> np.ndarray:
    """The bucket of each row in every table; `x`: rows of equal length, padded to a power of two."""
    width = x.shape[1]
    out = np.zeros((len(x), TABLES), np.int64)
    for t in range(TABLES):
        for part, axes in enumerate(axes_for(rows, width)):
            y = _rotated(x, t, part, width)[:, :axes]
            at = np.argmax(np.abs(y), 1)
            out[:, t] = out[:, t] * (2 * axes) + 2 * at + (np.take_along_axis(y, at[:, None], 1)[:, 0] > 0)
    return out


def probes(x: np.ndarray, rows: int, count: int = PROBES) -> np.ndarray:
    """The `count` buckets to visit for each query in every table, nearest first: queries x tables x count (-1: none)."""
    step = max(1, _WAYS // (count * min(count, 2 * x.shape[1])))
    return np.concatenate([_probes(x[i : i + step], rows, count) for i in range(0, max(1, len(x)), step)])


def _probes(x: np.ndarray, rows: int, count: int) -> np.ndarray:
    width = x.shape[1]
    out = np.full((len(x), TABLES, count), -1, np.int64)
    for t in range(TABLES):
        loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for part, axes in enumerate(axes_for(rows, width)):
            y = _rotated(x, t, part, width)[:, :axes]
            signed = np.stack([-y, y], 2).reshape(len(x), 2 * axes)
            own = (signed.max(1, keepdims=True) - signed) ** 2
            near = np.argsort(own, 1, kind="stable")[:, :count]
            loss = (loss[:, :, None] + np.take_along_axis(own, near, 1)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * axes) + near[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, 1, kind="stable")[:, :count]
            loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
        out[:, t, : code.shape[1]] = code
    return out


class Shape(NamedTuple):
    """What all vectors with the same number of components share: how many there are, the largest length, whether all have it."""

    rows: int
    longest: float
    even: bool
    asked: int
    probes: int = PROBES


def _unit(x: np.ndarray, shape: Shape, query: bool) -> np.ndarray:
    """Rows as unit vectors, padded to a power of two, with the coordinate that makes their lengths equal if they differ."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    extra = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, 1 - (norm / shape.longest) ** 2))
    unit = x / norm if query else x / shape.longest
    n = x.shape[1]
    width = 1 << max(0, (n - 1).bit_length())
    out = np.zeros((len(x), width if width > n or shape.even else 2 * width))
    out[:, :n] = unit
    if out.shape[1] > n:
        out[:, n] = extra[:, 0]
    return out


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(`id`, `key`: digest, `dim`, `vec`: little-endian bytes, `norm`) of the usable rows."""
    wide = dict(rows.dtypes)[vector_col] != "array<float>"
    kind = "<f8" if wide else "<f4"
    vector = F.col(vector_col).cast("array<double>" if wide else "array<float>")
    good = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    def scan(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, edge = lists.values.to_numpy(zero_copy_only=False) + 0.0, lists.offsets.to_numpy()
            parts = [flat[a:b].astype(kind) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            data = [p.tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.md5(d).digest() for d in data], pa.binary()),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array(data, pa.binary()),
                    pa.array([float(np.linalg.norm(p.astype(float))) for p in parts], pa.float64()),
                ],
                ["id", "key", "dim", "vec", "norm"],
            )

    return good.mapInArrow(scan, "id long, key binary, dim int, vec binary, norm double")


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    kind = "<f8" if len(data[0]) == 8 * dim else "<f4"
    return np.frombuffer(b"".join(data), kind).reshape(len(data), dim).astype(np.float64)


def shapes_of(reps: DataFrame) -> dict[int, Shape]:
    """The shape of the representatives of each number of components."""
    asked = F.sum(F.coalesce(F.col("asked"), F.lit(False)).cast("long"))
    found = reps.groupBy("dim").agg(F.count(F.lit(1)), F.max("norm"), F.min("norm"), asked).collect()
    return {dim: Shape(n, most, least >= most * (1 - 1e-6), q) for dim, n, most, least, q in found}


def probes_for(x: np.ndarray, best: np.ndarray, of: np.ndarray, shape: Shape) -> int:
    """The probes that find `RECALL` of the neighbours `best` of the queries `x`; `of`: the query of each neighbour."""
    own, query, count = codes(_unit(best, shape, False), shape.rows), _unit(x, shape, True), PROBES
    buckets = math.prod(2 * a for a in axes_for(shape.rows, query.shape[1]))
    while count < buckets:
        visits = probes(query, shape.rows, count)
        hits = [(visits[q] == c[:, None]).any() for q, c in zip(of, own, strict=True)]
        if np.mean(hits) >= RECALL:
            break
        count *= 2
    return count


def measured(reps: DataFrame, shapes: dict[int, Shape], k: int) -> dict[int, Shape]:
    """`shapes` with the probes that find enough of the k nearest of a sample of the queries, which is searched exactly.

    Tables of fewer than PROBES x ROWS_PER_BUCKET rows are left out: the first probes cover them.
    """
    large = {d: s for d, s in shapes.items() if s.asked and s.rows > PROBES * ROWS_PER_BUCKET}
    if not large:
        return shapes
    chosen = F.lit(False)
    for dim, s in large.items():
        chosen = chosen | ((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(s.asked)) < SAMPLE))
    sample: dict[int, list] = {}
    for r in reps.where("asked").where(chosen).select("dim", "rep", "vec").collect():
        sample.setdefault(r["dim"], []).append((r["rep"], bytes(r["vec"])))
    queries = {d: (np.array([i for i, _ in rows]), _matrix([v for _, v in rows], d)) for d, rows in sample.items()}
    shared = reps.sparkSession.sparkContext.broadcast(queries)

    def scan(batches):
        for batch in batches:
            dims, rep = batch.column("dim").to_numpy(), batch.column("rep").to_numpy()
            for dim in set(dims.tolist()) & set(shared.value):
                at, (ids, x) = np.flatnonzero(dims == dim), shared.value[dim]
                score = x @ _matrix(batch.column("vec").take(pa.array(at)).to_pylist(), dim).T
                score[ids[:, None] == rep[at]] = -np.inf
                n = min(k, len(at))
                top = largest(score, rep[at], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([r.tobytes() for r in rep[at][top].astype("<i8")], pa.binary()),
                        pa.array([r.tobytes() for r in np.take_along_axis(score, top, 1).astype("<f8")], pa.binary()),
                    ],
                    ["query", "ids", "scores"],
                )

    exact = merged(reps.select("dim", "rep", "vec").mapInArrow(scan, "query long, ids binary, scores binary"), k)
    near: dict[int, list] = {}
    for r in exact.join(reps.select("rep", "dim", "vec"), "rep").where("query <> rep").select("dim", "query", "vec").collect():
        near.setdefault(r["dim"], []).append((r["query"], bytes(r["vec"])))
    out = dict(shapes)
    for dim, rows in near.items():
        ids, x = queries[dim]
        place = {i: n for n, i in enumerate(ids.tolist())}
        of = np.array([place[q] for q, _ in rows])
        out[dim] = shapes[dim]._replace(probes=probes_for(x, _matrix([v for _, v in rows], dim), of, shapes[dim]))
    return out


def hashed(reps: DataFrame, shapes: dict[int, Shape]) -> DataFrame:
    """`reps` with `codes` and, for those that are asked (`asked`), `visits`: TABLES x the shape's probes."""

    def scan(batches):
        for batch in batches:
            dims, data, asked = (batch.column(c).to_pylist() for c in ("dim", "vec", "asked"))
            own: list = [None] * len(dims)
            visits: list = [None] * len(dims)
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                x, shape = _matrix([data[i] for i in at], dim), shapes[dim]
                for i, c in zip(at, codes(_unit(x, shape, False), shape.rows), strict=True):
                    own[i] = c
                if q := [j for j, i in enumerate(at) if asked[i]]:
                    for j, v in zip(q, probes(_unit(x[q], shape, True), shape.rows, shape.probes), strict=True):
                        visits[at[j]] = v.ravel()
            out = batch.append_column("codes", pa.array(own, pa.list_(pa.int64())))
            yield out.append_column("visits", pa.array(visits, pa.list_(pa.int64())))

    schema = ", ".join(f"{n} {t}" for n, t in reps.dtypes) + ", codes array<long>, visits array<long>"
    return reps.mapInArrow(scan, schema)


_AT = ["dim", "tab", "bucket", "part"]


def scored(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """Per query and bucket part its `keep` best rows there: (`query`, `ids`, `scores`), packed.

    index and queries: dim, tab, bucket, part, rep, vec. The rows of a part come before its queries, which stream by.
    """
    rows = index.select(*_AT, F.lit(0).alias("kind"), "rep", "vec").unionByName(queries.select(*_AT, F.lit(1).alias("kind"), "rep", "vec"))
    keys = [*_AT, "kind"]

    def search(batches):
        at, held, ids = None, None, None
        for table in _pieces(batches, keys):
            first = table.slice(0, 1).to_pylist()[0]
            here, dim = tuple(first[c] for c in _AT), first["dim"]
            rep, x = table.column("rep").to_numpy(), _matrix(table.column("vec").to_pylist(), dim)
            if first["kind"] == 0:
                if here == at:
                    held, ids = np.concatenate([held, x]), np.concatenate([ids, rep])
                else:
                    at, held, ids = here, x, rep
                continue
            if here != at:
                continue
            score = x @ held.T
            n = min(keep, len(ids))
            top = largest(score, ids, n)
            best = np.take_along_axis(score, top, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep, pa.int64()), pa.array([r.tobytes() for r in ids[top].astype("<i8")], pa.binary()), pa.array([r.tobytes() for r in best.astype("<f8")], pa.binary())],
                ["query", "ids", "scores"],
            )

    return rows.repartition(*_AT).sortWithinPartitions(*keys).mapInArrow(search, "query long, ids binary, scores binary")


def largest(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Per row the columns of the n largest scores, in any order; of equal ones at the cut those of the smaller ids."""
    if n >= len(ids):
        return np.tile(np.arange(len(ids)), (len(score), 1))
    top = np.argpartition(-score, n - 1, 1)[:, :n]
    least = np.take_along_axis(score, top, 1).min(1)
    for row in np.flatnonzero((score >= least[:, None]).sum(1) > n):
        top[row] = np.lexsort((ids, -score[row]))[:n]
    return top


def _pieces(batches, keys):
    """Rows with equal keys, at most a batch's worth at a time."""
    for batch in batches:
        yield from sorted_groups([batch], keys)


def merged(found: DataFrame, keep: int) -> DataFrame:
    """The `keep` best different rows of each query: (`query`, `rep`)."""

    def merge(batches):
        for table in sorted_groups(batches, ["query"]):
            ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
            score = np.frombuffer(b"".join(table.column("scores").to_pylist()), "<f8")
            order = np.lexsort((ids, -score))
            ids = ids[order]
            _, first = np.unique(ids, return_index=True)
            best = ids[np.sort(first)][:keep]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("query")[0].as_py()] * len(best), pa.int64()), pa.array(best, pa.int64())], ["query", "rep"])

    return found.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query long, rep long")


def _expanded(pairs: DataFrame, reps: DataFrame, members: DataFrame, keep: int, vector: str) -> DataFrame:
    """(`query`, `id`, `score`, `place`): rows behind the representatives, `keep` for each query, with the exact score."""
    left = reps.select(F.col("rep").alias("query"), F.col(vector).alias("x"))
    right = reps.select("rep", F.col(vector).alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    each = pairs.join(left, "query").join(right, "rep").select("query", "rep", dot.alias("score")).join(members, "rep")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("query", "id", "score", "place")


def nearest(rows: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner product with each row for which `asked` (a condition on `id`) holds.

    query_id, rank (from 1), vec_id, score. A row is no neighbour of its own; ties go to the smaller id.
    """
    base = stored(packed(rows, id_col, vector_col))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    inner, outer = Window.partitionBy("key", salt).orderBy("id"), Window.partitionBy("key").orderBy("id")
    distinct = base.select("key", "id").distinct()
    some = distinct.withColumn("n", F.row_number().over(inner)).where(F.col("n") <= k + 1).drop("n")
    ids = stored(some.withColumn("n", F.row_number().over(outer)).where(F.col("n") <= k + 1).drop("n"))
    first = [F.first(c).alias(c) for c in ("vec", "dim", "norm")]
    one = stored(base.groupBy("key").agg(F.min("id").alias("rep"), *first, F.max(asked).alias("asked")))
    shapes = measured(one, shapes_of(one), k)
    reps_n = sum(s.rows for s in shapes.values())
    reps = stored(hashed(one.drop("norm"), shapes))
    members = ids.join(reps.select("key", "rep"), "key").select("rep", "id")
    index = reps.select("dim", F.posexplode("codes").alias("tab", "bucket"), "rep", "vec")
    visits = reps.where("asked").select("dim", F.size("visits").alias("size"), F.posexplode("visits").alias("n", "bucket"), "rep", "vec")
    visits = visits.where("bucket >= 0").withColumn("tab", F.floor(F.col("n") * TABLES / F.col("size")).cast("int")).drop("n", "size")
    big = stored(index.groupBy("dim", "tab", "bucket").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts")).where("parts > 1"))
    if n := big.count():
        big = sized(big, n, 32)
        own = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1).cast("long")))
        index = index.join(big, ["dim", "tab", "bucket"], "left").withColumn("part", own)
        visits = visits.join(big, ["dim", "tab", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    else:
        index, visits = (x.withColumn("part", F.lit(0).cast("long")) for x in (index, visits))
    vectors = _readable(reps)
    pairs = stored(merged(scored(index, visits, k + 1), k + 1))
    found = stored(_expanded(pairs, vectors, members, k + 1, "vector"))
    of_dim = reps.join(members, "rep", "left").groupBy("dim").agg(F.count("id").alias("there"))
    want = reps.where("asked").select("rep", "dim").join(F.broadcast(of_dim), "dim").select(F.col("rep").alias("query"), F.least(F.lit(k + 1).cast("long"), "there").alias("want"))
    short = stored(want.join(found.groupBy("query").agg(F.count(F.lit(1)).alias("got")), "query", "left").where(F.coalesce("got", F.lit(0)) < F.col("want")).select(F.col("query").alias("rep")))
    if short.limit(1).count():
        blocks = max(1, -(-reps_n // SPLIT))
        at = reps.select("dim", F.lit(0).alias("tab"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("bucket"), F.lit(0).cast("long").alias("part"), "rep", "vec")
        ask = reps.join(short, "rep").select("dim", F.lit(0).alias("tab"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), F.lit(0).cast("long").alias("part"), "rep", "vec")
        exact = _expanded(merged(scored(at, ask, k + 1), k + 1), vectors, members, k + 1, "vector")
        found = found.join(short.withColumnRenamed("rep", "query"), "query", "left_anti").unionByName(exact)
    queries = distinct.where(asked).join(reps.select("key", "rep"), "key").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    answers = queries.join(found, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _readable(reps: DataFrame) -> DataFrame:
    """`reps` with the vector as an array again."""

    def scan(batches):
        for batch in batches:
            kinds = [("<f8" if len(v) == 8 * d else "<f4", v) for v, d in zip(batch.column("vec").to_pylist(), batch.column("dim").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([np.frombuffer(v, k).astype(float) for k, v in kinds], pa.list_(pa.float64()))], ["rep", "vector"])

    return reps.select("rep", "vec", "dim").mapInArrow(scan, "rep long, vector array<double>")
