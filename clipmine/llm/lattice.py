"""SentencePiece encoding and decoding with the lattice as a relation.

1. Chunks of documents number their distinct words. What stays of a text is the sequence of its words' numbers; the words go
   to owners (by a hash), each once a chunk, packed and compressed. 
2. The owners' distinct words are exploded into their substrings of up to the longest piece's length and equi-joined to
   the piece table; the rows that match are the lattice's edges. Edges are grouped by word, where they already are, and
   folded from left to right with `aggregate`: the fold keeps the best score and ids of every position (Viterbi), for a
   long word those of the last positions of a piece's length.
3. An owner decodes its words again and answers each chunk with ids, in the order that the chunk numbers its words in. A
   chunk then puts its documents together by array look-ups. Texts are never shuffled, ids never go to the driver.

The piece table is broadcast: its size is that of the model file. In words longer than `LONG` characters the paths'
ids would be copied over and over; they are segmented by the same recurrence where they occur, exactly.

Decoding joins nothing: ids are mapped to their bytes. Encoding and decoding a text gives it back, but for a literal
`▁`, which reads as a space.

Defined cases: a null or empty text has no ids; rows may repeat; an empty table gives an empty table; extra columns
are ignored; a very long text is a chunk of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine.functions.spans import let
from clipmine.llm import pieces as sp
from clipmine.llm.tables import parts_for
from clipmine.llm.words import release

#: Words up to SHORT keep all positions in the fold, up to LONG those that a piece can reach back to.
SHORT, LONG = 64, 4096
ROWS_PER_OWNER = 4096
#: Characters of the texts of a chunk.
CHUNK_CHARS = 8 << 20
#: A word of its own that every text may hold; its ids are known without asking.
NEW_LINE = "\n"


def piece_table(spark: SparkSession, pieces: sp.Pieces) -> DataFrame:
    rows = [(p, i, pieces.scores[p]) for p, i in pieces.ids.items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def _packed(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)


def _fold(word: Column, codes: Column, pieces: sp.Pieces, scores: Column, window: int | None) -> Column:
    """The ids of the best path. `codes`: sorted edges, each with end, start and piece number + 1 in its bits.

    The state has the best edge into the position `at` so far, and the scores and ids of the positions before it (the last
    `window` of them). The edges of an end come with the earliest start first, and a later one has to be better.
    """
    kind = "struct<at: int, score: double, start: int, piece: int, scores: array<double>, ids: array<array<int>>>"
    table = F.array(*[F.lit(i) for i in pieces.byte_ids])

    def spelled(char: Column) -> Column:
        """The bytes of a character that no piece covers: UTF-8 as hex digits, looked up one by one."""
        digits = F.hex(F.encode(char, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.get(table, F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("int")))

    def state(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, ("at", "score", "start", "piece", "scores", "ids"), strict=True)])

    def index(s: Column, at: Column) -> Column:
        return at if window is None else at - (s["at"] - F.size(s["scores"]))

    def recent(items: Column) -> Column:
        return items if window is None else let(items, lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - window + 1), F.lit(window)))

    def path(s: Column) -> Column:
        own = F.when(s["piece"] > 0, F.array(s["piece"] - 1)).otherwise(spelled(word.substr(s["start"] + 1, F.lit(1))))
        return F.when(s["at"] == 0, F.array().cast("array<int>")).otherwise(F.concat(F.get(s["ids"], index(s, s["start"])), own))

    def step(s: Column, code: Column) -> Column:
        edge = F.struct(F.shiftright(code, 44).cast("int").alias("end"), F.shiftright(code, 24).bitwiseAND(0xFFFFF).cast("int").alias("start"), code.bitwiseAND(0xFFFFFF).cast("int").alias("piece"))

        def opened(e: Column) -> Column:
            """The first edge of a position: the one before is settled."""
            settled = F.struct(s["at"].alias("at"), recent(F.concat(s["scores"], F.array(s["score"]))).alias("scores"), recent(F.concat(s["ids"], F.array(path(s)))).alias("ids"))
            here = lambda x: e["start"] if window is None else e["start"] - (x["at"] + 1 - F.size(x["scores"]))
            return let(settled, lambda x: state(e["end"], F.get(x["scores"], here(x)) + F.get(scores, e["piece"]), e["start"], e["piece"], x["scores"], x["ids"]))

        def improved(e: Column) -> Column:
            total = F.get(s["scores"], index(s, e["start"])) + F.get(scores, e["piece"])
            return let(total, lambda v: F.when(v > s["score"], state(s["at"], v, e["start"], e["piece"], s["scores"], s["ids"])).otherwise(s))

        return let(edge, lambda e: F.when(e["end"] > s["at"], opened(e)).otherwise(improved(e)))

    none = F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), F.array().cast("array<double>"), F.array().cast("array<array<int>>")
    return F.aggregate(codes, state(*none).cast(kind), step, path)


def encoded_words(words: DataFrame, pieces: sp.Pieces, parts: int) -> DataFrame:
    """(`owner`, `word`, `ids`) of distinct words (`owner`, `word`) of up to `LONG` characters, by the relational lattice.

    In `parts` partitions: a word has some twenty edges, and those of a partition are grouped in memory.
    """
    words = words.repartition(parts, "word")  # the edges of a word are then together as they are made
    n = F.length("word")
    spans = (
        words.select("owner", "word", F.explode(F.sequence(F.lit(1), n)).alias("at"))
        .select("owner", "word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("at") + 1))).alias("size"))
        .select("owner", "word", "at", "size", F.col("word").substr(F.col("at"), F.col("size")).alias("piece"))
    )
    edges = spans.join(F.broadcast(piece_table(words.sparkSession, pieces).drop("score")), "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    bits = lambda c, k: F.shiftleft(c.cast("long"), k)
    code = bits(F.col("at") + F.col("size") - 1, 44) + bits(F.col("at") - 1, 24) + F.coalesce(F.col("id") + 1, F.lit(0))
    grouped = edges.select("owner", "word", code.alias("code")).groupBy("owner", "word").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    # By piece number + 1; 0 is a character without a piece.
    by_number = {i + 1: pieces.scores[p] for p, i in pieces.ids.items()} | {0: pieces.unknown}
    listed = ",".join(repr(by_number.get(i, 0.0)) for i in range(max(by_number) + 1))
    scores = F.split(F.lit(listed), ",").cast("array<double>")
    fold = lambda window: _fold(F.col("word"), F.col("codes"), pieces, scores, window)
    return grouped.select("owner", "word", F.when(F.length("word") <= SHORT, fold(None)).otherwise(fold(pieces.longest)).alias("ids"))


def _columns(values: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte by byte: all lowest bytes first."""
    return _packed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


#: Either a chunk's box (`part`, `doc_ids`, `sizes`, `numbers`, `local`) or its request to an owner (`part`, `words`); `key` is
#: where it goes: an owner, or -1 - part.
SENT = "key long, part long, words binary, doc_ids array<bigint>, sizes binary, numbers binary, local array<string>"
_SENT = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("numbers", pa.binary()), ("local", pa.list_(pa.string()))])


class _Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def numbered(docs: DataFrame, owners: int) -> DataFrame:
    """Chunks of documents as numbers, and what they ask the owners of words, dealt to where they go.

    `doc_ids`, how many words each text has (`sizes`), the words' `numbers`, the words that are segmented where the chunk is
    put together (`local`: the first numbers); the others follow by owner, in the order of the requests.
    """

    def sent(part: int, ids: list, texts: list[np.ndarray], at: dict[str, int]) -> pa.RecordBatch:
        local = [NEW_LINE] + [w for w in at if len(w) > LONG]
        rest = sorted(w for w in at if w != NEW_LINE and len(w) <= LONG)
        owner = np.fromiter((zlib.crc32(w.encode()) % owners for w in rest), np.int64, len(rest))
        order = np.argsort(owner, kind="stable")
        rest, owner = [rest[i] for i in order.tolist()], owner[order]
        number = np.zeros(len(at), np.int64)
        for k, w in enumerate(local):
            if w in at:
                number[at[w]] = k
        number[np.fromiter(map(at.__getitem__, rest), np.int64, len(rest))] = len(local) + np.arange(len(rest))
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(rest)] if rest else []
        rows = [{"key": int(owner[a]), "part": part, "words": _packed("\n".join(rest[a:b]).encode())} for a, b in zip(edges, edges[1:], strict=False)]
        rows.append({"key": -1 - part, "part": part, "doc_ids": ids, "sizes": _columns(np.array([len(t) for t in texts])), "numbers": _columns(number[np.concatenate(texts)]), "local": local})
        return pa.RecordBatch.from_pylist(rows, _SENT)

    def scan(batches):
        from pyspark import TaskContext

        ids: list = []
        texts: list[np.ndarray] = []
        at, held, n = _Numbers(), 0, 0
        first = TaskContext.get().partitionId() << 32  # the same again if the task is
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and held + len(text or "") > CHUNK_CHARS:
                    yield sent(first + n, ids, texts, at)
                    ids, texts, at, held, n = [], [], _Numbers(), 0, n + 1
                ids.append(doc_id)
                texts.append(np.array(list(map(at.__getitem__, sp.words(text or ""))), np.uint32))
                held += len(text or "")
        if ids:
            yield sent(first + n, ids, texts, at)
        del ids, texts, at
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SENT).repartition("key")


def encoded(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars, round_trip, and `ids`."""
    pieces = sp.load(model)
    if not sp.splits_cleanly(pieces):
        raise ValueError("a piece reaches over the end of a word")
    owners = parts_for(docs.count(), ROWS_PER_OWNER, 1 << 22)
    sent = numbered(docs, owners)
    # The conditions move below the shuffle: each side numbers the words again, which is cheaper than to store the boxes.
    boxes, requests = sent.where("key < 0"), sent.where("key >= 0")

    def read_back(words: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """How many characters each word decodes to, and whether these are its own."""
        text_of = pieces.text_of()
        back = [b"".join(map(text_of.__getitem__, i)).decode("utf-8", "replace") for i in ids]
        return np.array([len(t) for t in back], "<u4"), np.array([t.replace(sp.SPACE, " ") == w.replace(sp.SPACE, " ") for t, w in zip(back, words, strict=True)], np.uint8)

    def unique(key: tuple, requests: pa.Table) -> pa.Table:
        distinct: set[str] = set()
        for data in requests.column("words").to_pylist():
            distinct.update(_unpacked(data).decode().split("\n"))
        out = pa.table({"owner": pa.array([key[0].as_py()] * len(distinct), pa.int64()), "word": pa.array(sorted(distinct), pa.string())})
        del distinct
        release()
        return out

    def answer(key: tuple, requests: pa.Table, found: pa.Table) -> pa.Table:
        lists, words = found.column("ids").combine_chunks(), found.column("word").to_pylist()
        chars, ok = read_back(words, lists.to_pylist())
        at = {w: i for i, w in enumerate(words)}
        replies = []
        for data in requests.column("words").to_pylist():
            asked = np.fromiter(map(at.__getitem__, _unpacked(data).decode().split("\n")), np.int64)
            taken = lists.take(pa.array(asked))
            sizes = np.diff(taken.offsets.to_numpy()).astype("<u4")
            replies.append(_packed(struct.pack("<Q", len(asked)) + sizes.tobytes() + chars[asked].tobytes() + ok[asked].tobytes() + taken.values.to_numpy().astype("<u4").tobytes()))
        out = pa.table({"to": pa.compute.subtract(-1, requests.column("part")), "owner": requests.column("key"), "ids": pa.array(replies, pa.binary())})
        del lists, words, at, chars, ok
        release()
        return out

    def assemble(key: tuple, box: pa.Table, replies: pa.Table) -> pa.Table:
        row = box.to_pylist()[0]
        local = [sp.viterbi(w, pieces) for w in row["local"]]
        chars, ok = read_back(row["local"], local)
        parts = [(np.array([len(i) for i in local], "<u4"), chars, ok, np.array([x for i in local for x in i], "<u4"))]
        for _, data in sorted(zip(replies.column("owner").to_pylist(), replies.column("ids").to_pylist(), strict=True)):
            raw = _unpacked(data)
            n = struct.unpack_from("<Q", raw)[0]
            cut = [8, 8 + 4 * n, 8 + 8 * n, 8 + 9 * n]
            parts.append((np.frombuffer(raw[cut[0] : cut[1]], "<u4"), np.frombuffer(raw[cut[1] : cut[2]], "<u4"), np.frombuffer(raw[cut[2] : cut[3]], np.uint8), np.frombuffer(raw[cut[3] :], "<u4")))
        size, chars, ok, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        start = np.cumsum(size, dtype=np.int64) - size
        numbers, ends = _numbers(row["numbers"]).astype(np.int64), np.cumsum(_numbers(row["sizes"]).astype(np.int64))
        out, a = [], 0
        for doc_id, b in zip(row["doc_ids"], ends.tolist(), strict=True):
            mine = numbers[a:b]
            n = size[mine].astype(np.int64)
            at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids = flat[at]
            # The space that normalisation puts at the front is taken off again.
            out.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), int(chars[mine].sum()) - (b > a), bool(ok[mine].all()), ids.astype(np.int32) if keep_ids else None))
            a = b
        kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_chars": pa.int64(), "round_trip": pa.bool_(), "ids": pa.list_(pa.int32())}
        made = {n: pa.array(list(c), t) for (n, t), c in zip(kinds.items(), zip(*out, strict=True), strict=True)}
        del parts, size, chars, ok, flat, start, numbers
        release()
        return pa.table(made if keep_ids else {n: c for n, c in made.items() if n != "ids"})

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean" + ", ids array<int>" * keep_ids
    found = encoded_words(requests.groupBy("key").applyInArrow(unique, "owner long, word string"), pieces, 2 * owners)
    replies = requests.groupBy("key").cogroup(found.groupBy("owner")).applyInArrow(answer, "to long, owner long, ids binary")
    return boxes.groupBy("key").cogroup(replies.groupBy("to")).applyInArrow(assemble, schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """`doc_id` and the `text` that each row's `ids` stand for; null ids give an empty text."""
    pieces = sp.load(model)

    def scan(batches):
        text_of = pieces.text_of()
        for batch in batches:
            texts = [sp.decoded(ids or [], text_of) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(scan, "doc_id long, text string")
