"""Removal of passages that occurred before, found by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of `BLOCK` words; every rolling run of `BLOCK` words is a
probe. A passage of `WINDOW` = 2 * BLOCK words always holds a whole reference block, wherever it starts, so two
places that share such a passage share a probe that hits a block. Three rounds:

1. Each chunk of documents sends the owners of hash ranges its distinct probes (48 bits, sorted, Golomb-Rice coded)
   and which of them are reference blocks. An owner answers with bitmaps: the probe occurs in another chunk; some
   chunk has it as a block.
2. A probe that hits is extended: every window of 20 words that holds it is a candidate. A chunk sends the owners the
   64-bit hashes of its distinct candidate windows with the first document of each. An owner answers whether the
   window's first place is in this chunk.
3. A window that starts earlier elsewhere is a repeat; the union of consecutive repeats is the maximal repeat, and
   its words go.

A passage held by a third of all documents is one number from each chunk in either round. Texts are shuffled once,
compressed, and all rounds read that shuffle. Windows are told apart by 64-bit hashes of their word sequence.

Words are `[^\\x20\\x09-\\x0D]+`. Earlier means a smaller doc_id, or the same document and an earlier start; of rows
that repeat a doc_id the one in the smaller chunk comes first, a null doc_id comes last. A null text has no words.
Extra columns pass through `deduplicated`; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.llm import rice, words
from clipmine.llm.chunks import CHUNK, boxed, unboxed, with_chunk
from clipmine.llm.tables import parts_for

BLOCK, WINDOW = 10, 20
PROBE_BITS = 48
ROWS_PER_OWNER = 4096
_LAST = np.iinfo(np.int64).max


class Chunk:
    """The words, probes and windows of a chunk's documents, in order of doc_id."""

    def __init__(self, table: pa.Table):
        ids = [_LAST if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or ""))
        self.table = table.take(pa.array(order, pa.int64()))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.raw, self.start, self.end, self.hash, self.doc = words.split([texts[i] or "" for i in order])

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every run of BLOCK words, its first word, and whether it is a reference block."""
        h, whole = words.runs(self.hash, self.doc, BLOCK)
        at = np.flatnonzero(whole)
        first_word = np.searchsorted(self.doc, np.arange(len(self.ids)))
        return h >> np.uint64(64 - PROBE_BITS), at, (at - first_word[self.doc[at]]) % BLOCK == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        h, whole = words.runs(self.hash, self.doc, WINDOW)
        return h, np.flatnonzero(whole)


def _cuts(values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where each owner's range begins in the sorted values of `width` bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _messages(chunk: int, cuts: np.ndarray, coded) -> pa.Table:
    full = np.flatnonzero(np.diff(cuts))
    return pa.table(
        {
            "owner": pa.array(full, pa.int32()),
            "chunk": pa.array([chunk] * len(full), pa.int64()),
            "coded": pa.array([coded(cuts[o], cuts[o + 1]) for o in full], pa.binary()),
        }
    )


def _answers(table: pa.Table, found: list[bytes]) -> pa.Table:
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"), "answer": pa.array(found, pa.binary())})


def _pair(a: bytes, b: bytes) -> bytes:
    return struct.pack("<I", len(a)) + a + b


def _unpair(data: bytes) -> tuple[bytes, bytes]:
    n = 4 + struct.unpack_from("<I", data)[0]
    return data[4:n], data[n:]


MESSAGE, ANSWER = "owner int, chunk long, coded binary", "chunk long, owner int, answer binary"


def _probe_answer(key: tuple, table: pa.Table) -> pa.Table:
    """For every chunk two bitmaps over its probes: another chunk has it; some chunk has it as a block."""
    lists, blocks = [], []
    for data in table.column("coded").to_pylist():
        values, is_block = map(bytes, _unpair(data))
        lists.append(rice.decode(values))
        blocks.append(lists[-1][rice.flags(is_block, len(lists[-1]))])
    twice, any_block = rice.seen_twice(lists), np.unique(np.concatenate(blocks))
    out = _answers(table, [zlib.compress(_pair(rice.bitmap(rice.member(x, twice)), rice.bitmap(rice.member(x, any_block))), 1) for x in lists])
    del lists, blocks, twice, any_block
    words.release()
    return out


def _window_answer(key: tuple, table: pa.Table) -> pa.Table:
    """For every chunk a bitmap over its windows: the window's first place is in this chunk."""
    lists, firsts = [], []
    for data in table.column("coded").to_pylist():
        values, docs = _unpair(data)
        lists.append(rice.decode(values))
        firsts.append(np.frombuffer(zlib.decompress(docs), "<i8"))
    size = [len(x) for x in lists]
    value, first = np.concatenate(lists), np.concatenate(firsts)
    chunk = np.repeat(table.column("chunk").to_numpy(), size)
    order = np.lexsort((chunk, first, value))
    best = np.zeros(len(value), bool)
    best[order] = np.diff(value[order], prepend=value[order[:1]] + np.uint64(1)) != 0
    out = _answers(table, [rice.bitmap(x) for x in np.split(best, np.cumsum(size)[:-1])])
    del lists, firsts, value, first, chunk, order, best
    words.release()
    return out


def _read(answers: pa.Table, cuts: np.ndarray, take) -> np.ndarray:
    out = np.zeros(cuts[-1], bool)
    for o, data in zip(answers.column("owner").to_pylist(), answers.column("answer").to_pylist(), strict=True):
        out[cuts[o] : cuts[o + 1]] = take(data, cuts[o + 1] - cuts[o])
    return out


def _hit(part: Chunk, answers: pa.Table, bits: int) -> np.ndarray:
    """Which words start a candidate window: a mask over the windows of the chunk."""
    h, at, _ = part.probes()
    values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)

    def shared(data: bytes, n: int) -> np.ndarray:
        elsewhere, block = _unpair(zlib.decompress(data))
        return (rice.flags(elsewhere, n) * 2 + rice.flags(block, n)).astype(np.uint8)

    cuts = _cuts(values, PROBE_BITS, bits)
    code = np.zeros(len(values), np.uint8)
    for o, data in zip(answers.column("owner").to_pylist(), answers.column("answer").to_pylist(), strict=True):
        code[cuts[o] : cuts[o + 1]] = shared(data, cuts[o + 1] - cuts[o])
    hit = ((code >= 2) | (counts > 1)) & (code % 2 == 1)
    near = np.zeros(len(part.hash) + 1, np.int64)
    near[at[hit[inverse]] + 1] = 1
    return np.cumsum(near)


def _candidates(part: Chunk, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the windows that hold a probe that hits, in order of document and place."""
    h, at = part.windows()
    if not len(at):
        return h, at
    before = _hit(part, answers, bits)
    held = before[at + WINDOW - BLOCK + 1] > before[at]
    return h[held], at[held]


def removed_words(docs: DataFrame, columns: list[str], emit, schema: str) -> DataFrame:
    """Run the three rounds; `emit(chunk, mask of removed words)` makes the result of a chunk, a table of `schema`."""
    bits = parts_for(docs.count(), ROWS_PER_OWNER, 1 << 22).bit_length() - 1
    rows = with_chunk(docs, columns)

    def send_probes(key: tuple, boxes: pa.Table) -> pa.Table:
        h, _, block = Chunk(unboxed(boxes.column("box").to_pylist())).probes()
        values, inverse = np.unique(h, return_inverse=True)
        is_block = np.zeros(len(values), bool)
        is_block[inverse[block]] = True
        out = _messages(key[0].as_py(), _cuts(values, PROBE_BITS, bits), lambda a, b: _pair(rice.encode(values[a:b]), rice.bitmap(is_block[a:b])))
        del h, values, inverse
        words.release()
        return out

    def send_windows(key: tuple, boxes: pa.Table, answers: pa.Table) -> pa.Table:
        part = Chunk(unboxed(boxes.column("box").to_pylist()))
        h, at = _candidates(part, answers, bits)
        values, first = np.unique(h, return_index=True)  # the first place in the chunk: it is in order
        docs_of = part.ids[part.doc[at[first]]] if len(at) else np.zeros(0, np.int64)
        del part, h, at
        words.release()
        return _messages(key[0].as_py(), _cuts(values, 64, bits), lambda a, b: _pair(rice.encode(values[a:b]), zlib.compress(docs_of[a:b].astype("<i8").tobytes(), 1)))

    def remove(key: tuple, boxes: pa.Table, answers: pa.Table) -> pa.Table:
        probe = answers.filter(pa.compute.equal(answers.column("round"), 1))
        window = answers.filter(pa.compute.equal(answers.column("round"), 2))
        part = Chunk(unboxed(boxes.column("box").to_pylist()))
        h, at = _candidates(part, probe, bits)
        values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        here = _read(window, _cuts(values, 64, bits), rice.flags)
        repeat = np.ones(len(at), bool)
        repeat[first[here]] = False
        edge = np.zeros(len(part.hash) + 1, np.int64)
        np.add.at(edge, at[repeat], 1)
        np.add.at(edge, at[repeat] + WINDOW, -1)
        out = emit(part, np.cumsum(edge)[:-1] > 0)
        del part, h, at, values, first, inverse
        words.release()
        return out

    texts = boxed(rows)
    probes = texts.groupBy(CHUNK).applyInArrow(send_probes, MESSAGE)
    hits = probes.groupBy("owner").applyInArrow(_probe_answer, ANSWER)
    windows = texts.groupBy(CHUNK).cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, MESSAGE)
    firsts = windows.groupBy("owner").applyInArrow(_window_answer, ANSWER)
    both = hits.withColumn("round", F.lit(1)).unionByName(firsts.withColumn("round", F.lit(2)))
    return texts.groupBy(CHUNK).cogroup(both.groupBy("chunk")).applyInArrow(remove, schema)


def _kept_text(part: Chunk, gone: np.ndarray, doc: int, a: int, b: int) -> bytes:
    return b" ".join(part.raw[part.start[i] : part.end[i]] for i in range(a, b) if not gone[i])


def _emit(part: Chunk, gone: np.ndarray):
    """Per document: its number, how many words it has and loses, and the bytes of the kept words."""
    edges = np.searchsorted(part.doc, np.arange(len(part.ids) + 1))
    for d, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        n = int(gone[a:b].sum())
        yield d, b - a, n, _kept_text(part, gone, d, a, b)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def emit(part: Chunk, gone: np.ndarray) -> pa.Table:
        out = [(n, k, hashlib.sha256(text).hexdigest()) for _, n, k, text in _emit(part, gone)]
        n, k, sha = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": part.table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if dict(docs.dtypes)["doc_id"] != "bigint" else docs
    return removed_words(rows, ["doc_id", "text"], emit, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, count_as: str = "n_removed") -> DataFrame:
    """`docs` with the repeated passages taken out of `text`, and how many words each lost as `count_as`.

    A text that loses nothing stays as it is; of another the kept words remain, joined by one space.
    """

    def emit(part: Chunk, gone: np.ndarray) -> pa.Table:
        texts, counts = part.table.column("text").to_pylist(), []
        for d, _, n, text in _emit(part, gone):
            counts.append(n)
            if n:
                texts[d] = text.decode("utf-8", "surrogatepass")
        at = part.table.schema.get_field_index("text")
        return part.table.set_column(at, "text", pa.array(texts, pa.string())).append_column(count_as, pa.array(counts, pa.int64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{count_as}` long"
    return removed_words(docs, docs.columns, emit, schema)
