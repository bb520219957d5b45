"""Best-fit packing of documents into token sequences, improved by a grouping genetic algorithm on islands.

`pieces` turns a text into token ids and cuts what is longer than a sequence; `packed` places the pieces. A piece
that fills a sequence has one to itself. The others are dealt at random into blocks of about `BLOCK` pieces. Each
block is solved by several islands, rows of a DataFrame that hold a small population of packings. A child takes
whole well-filled bins of one parent into the other; the bins there that hold a piece twice are dissolved, and the
pieces set free are placed again by best fit. After every epoch an island's best packing migrates to the next
island of its block. The best packing of all islands is the block's result; a block stops once it is at its lower
bound. Blocks are independent, so the work is linear and no task holds more than one block's population.

Defined cases: a null text is empty (its only id is the end mark); rows that repeat are packed once each; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmine.llm.tables import stored
from clipmine.llm.words import mix, release

END = 2
#: Pieces of a block, islands of a block, packings of an island, epochs, generations of an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2048, 3, 4, 2, 4
#: Chunks of text whose ids a Python worker remembers before it starts over.
REMEMBER = 250_000


class Encoder:
    """Ids of the byte-level BPE, the same as the tokenizer file gives, as little-endian 32-bit bytes.

    A single space between two non-space characters always starts a new pre-token, so a text is split there and
    the ids of a chunk are remembered. Texts with other runs of white space are encoded whole by the same merge
    ranks, and a text with the special token's string by the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import re

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, "rb") as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.json_path = json_path
        self.runs = re.compile(r" \s|\s ")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.json_path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.runs.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self.whole(first)]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                if len(known) >= REMEMBER:
                    known.clear()
                ids = known[chunk] = self.whole(f" {chunk}")
            out.append(ids)
        return b"".join(out)


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pieces(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, `ids` (bytes). A longer document's first piece is the short one."""
    paths = paths or tokenizer_files()

    def scan(batches):
        encode = Encoder(*paths)  # let go at the end of the task: workers live on
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    out.append((doc_id, k, a, b - a, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = slice(0, 6 if with_ids else 5)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)][keep], names[keep])
        del encode
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


class Packing:
    """The bin of every item, and how full every bin is."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray, capacity: int):
        _, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, lengths).astype(np.int64)
        self.score = (-len(self.fill), float(np.mean((self.fill / capacity) ** 2)) if len(self.fill) else 0.0)


def best_fit(items: np.ndarray, bins: np.ndarray, fill: list[int], lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Place `items` in the given order: each into the fullest bin that still has room, else into a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for b, f in enumerate(fill):
        by_room[capacity - f].append(b)
        rooms |= 1 << (capacity - f)
    count = len(fill)
    for i in items.tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, count = capacity, count, count + 1
        bins[i] = b
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def _fresh(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    order = np.argsort(-(lengths * (1 + noise * rng.standard_normal(len(lengths)))), kind="stable")
    return Packing(best_fit(order, np.zeros(len(lengths), np.int64), [], lengths, capacity), lengths, capacity)


def crossed(into: Packing, giver: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """A child of `into` that holds some of the fullest bins of `giver` whole."""
    good = np.flatnonzero(giver.fill >= np.quantile(giver.fill, 0.5))
    taken = rng.permutation(good)[: max(1, len(good) // 3)]
    given = np.isin(giver.bins, taken)
    broken = np.zeros(len(into.fill), bool)
    broken[into.bins[given]] = True
    broken[np.argmin(into.fill)] = True  # the emptiest bin is given up too
    free = np.flatnonzero(broken[into.bins] & ~given)
    bins = np.where(given, len(into.fill) + giver.bins, into.bins)
    left = np.ones(len(lengths), bool)
    left[free] = False
    names, dense = np.unique(bins[left], return_inverse=True)
    bins[left] = dense
    fill = np.bincount(dense, lengths[left], minlength=len(names)).astype(int).tolist()
    order = free[np.argsort(-lengths[free], kind="stable")]
    return Packing(best_fit(order, bins, fill, lengths, capacity), lengths, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, size: int = POPULATION, generations: int = GENERATIONS) -> list[np.ndarray]:
    """Some generations of one island; the best packing comes first."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    here = [Packing(p, lengths, capacity) for p in population]
    while len(here) < size and (not here or len(here[0].fill) > least):
        here.append(_fresh(lengths, capacity, rng, 0.0 if not here else 0.02 * len(here)))
        here.sort(key=lambda p: p.score, reverse=True)
    for _ in range(generations):
        if len(here[0].fill) <= least or len(here) < 2:
            break
        for _ in range(size):
            a, b = rng.choice(len(here), 2, replace=False)
            here.append(crossed(here[a], here[b], lengths, capacity, rng))
        here = sorted(here, key=lambda p: p.score, reverse=True)[:size]
    return [p.bins for p in here]


_STATE = "block long, island int, items binary, lengths binary, population array<binary>"


def _step(capacity: int, seed: int):
    def run(batches):
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                known = [np.frombuffer(p, "<i4").astype(np.int64) for p in row["population"]]
                own = int(mix(np.array([row["block"]], np.int64).view(np.uint64), seed * 97 + row["island"])[0])
                done.append([p.astype("<i4").tobytes() for p in evolve(lengths, known, capacity, own)])
            at = batch.schema.get_field_index("population")
            yield batch.set_column(at, "population", pa.array(done, pa.list_(pa.binary())))

    return run


def _blocks(pieces: DataFrame, blocks: int) -> DataFrame:
    """One row per block: the pieces' row numbers and lengths, in an order of their own."""

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        rows, lengths = table.column("row").to_numpy()[order], table.column("length").to_numpy()[order]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "items": pa.array([rows.astype("<i8").tobytes()], pa.binary()), "lengths": pa.array([lengths.astype("<i4").tobytes()], pa.binary())})

    dealt = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(gather, "block long, items binary, lengths binary")


def packed(numbered: DataFrame, capacity: int = 1024) -> DataFrame:
    """Places for pieces (`row`, unique; `length`): row, sequence_id, offset.

    `numbered` must be stored, so that its row numbers stay the same when it is read again.
    """
    whole = numbered.where(F.col("length") >= capacity).select("row", (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // BLOCK))
    islands = (
        _blocks(rest, blocks)
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        .select("block", "island", "items", "lengths", F.array().cast("array<binary>").alias("population"))
    )
    state = stored(islands.repartition("block", "island").mapInArrow(_step(capacity, 0), _STATE))
    for epoch in range(1, EPOCHS):
        migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, 1).alias("migrant"))
        met = state.join(migrants, ["block", "island"]).select("block", "island", "items", "lengths", F.concat("population", "migrant").alias("population"))
        state = stored(met.mapInArrow(_step(capacity, epoch), _STATE))

    def place(batches):
        for batch in batches:
            out = [[], [], []]
            for row in batch.to_pylist():
                items, lengths = np.frombuffer(row["items"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                bins = np.frombuffer(row["best"], "<i4").astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                first = np.searchsorted(bins[order], bins[order], "left")
                for to, values in zip(out, (items[order], 2 * (row["block"] * 4 * BLOCK + bins[order]) + 1, starts - starts[first]), strict=True):
                    to.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["row", "sequence_id", "offset"])

    ranked = state.select("block", "items", "lengths", F.col("population")[0].alias("best"), "island")
    chosen = ranked.mapInArrow(_bin_counts, "block long, items binary, lengths binary, best binary, island int, bins int")
    best = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("bins", "island"))).where("rank = 1")
    return whole.unionByName(best.select("block", "items", "lengths", "best").mapInArrow(place, "row long, sequence_id long, offset long"))


def _bin_counts(batches):
    for batch in batches:
        counts = [int(np.frombuffer(b, "<i4").max()) + 1 if b else 0 for b in batch.column("best").to_pylist()]
        yield batch.append_column("bins", pa.array(counts, pa.int32()))


def sequences(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, `pieces` (doc_id, piece, offset, length) and `ids` (bytes), in place order."""
    numbered = stored(pieces(docs, capacity, paths, with_ids=True), "row")
    placed = numbered.join(packed(numbered.select("row", "length"), capacity), "row")
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"), joined.alias("ids"))


def placements(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    numbered = stored(pieces(docs, capacity, paths), "row")
    placed = packed(numbered.select("row", "length"), capacity)
    return numbered.join(placed, "row").drop("row")
