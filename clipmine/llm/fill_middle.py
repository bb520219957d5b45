"""Fill-in-middle training texts by a piece table.

A document is never copied while it is rearranged. It is a list of descriptors (buffer, start, length): buffer 0 is the
document's UTF-8 text, buffer 1 the sentinels; both stay as they are. Cutting splits the one descriptor of the text at
two line ends, an arrangement permutes the parts and puts sentinels before them, writing and hashing stream the
described bytes. Reading back finds the sentinels in a written text, describes what lies between them over that text
and permutes the parts by the inverse.

    plain   text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

Where to cut and which form to take come from the first four 32-bit words of the SHA-256 of `seed:doc_id`. No sentinel
may occur in a text that gets one: such a text stays plain. Sentinels cannot arise where parts meet, as each starts
with `<`, which none holds elsewhere, and ends with `>`.

Defined cases: a null text is empty and an empty one plain; a null doc_id counts as the empty string; a text without a
line feed is one line; rows may repeat (each gives its own row, the same as the other); an empty table gives an empty
table; extra columns are ignored, whatever their names; a very long text is read once, in place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TEXT, SENTINEL = 0, 1
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = ((SENTINEL, i, 3) for i in (0, 3, 6))
MARKS = tuple(SENTINELS[s : s + n] for _, s, n in (PREFIX, SUFFIX, MIDDLE))

#: The order in which a form takes the parts prefix (0), middle (1), suffix (2), with the sentinel before each.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

Piece = tuple[int, int, int]

OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer: int, start: long, length: long>>, output string"
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_WRITTEN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", _PIECES), ("output", pa.string())])
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_DIGESTS = pa.schema([*[_WRITTEN.field(i) for i in range(5)], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
#: Bytes of texts that a task hands on at once; a longer text goes alone.
BATCH_BYTES = 4 << 20


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors of the first `at` bytes and those of the rest; at most one descriptor is cut in two."""
    left: list[Piece] = []
    for k, (buffer, start, length) in enumerate(pieces):
        if at < length:
            head = [(buffer, start, at)] if at else []
            return left + head, [(buffer, start + at, length - at), *pieces[k + 1 :]]
        left.append((buffer, start, length))
        at -= length
    return left, []


def streamed(pieces: list[Piece], buffers: tuple):
    """The bytes that the descriptors stand for, one after the other, not copied."""
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: list[Piece], buffers: tuple) -> str:
    out = hashlib.sha256()
    for part in streamed(pieces, buffers):
        out.update(part)
    return out.hexdigest()


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes but the following ones of a character."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text end, in bytes; the last one may have no line feed."""
    ends = np.flatnonzero(data == 10) + 1
    return np.append(ends, len(data)) if len(data) and data[-1] != 10 else ends


def draws(doc_id: int | None, seed: int) -> list[int]:
    words = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(words[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: memoryview, doc_id: int | None, rate: int, spm: int, seed: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, pieces) of one text."""
    data = np.frombuffer(text, np.uint8)
    whole: list[Piece] = [(TEXT, 0, len(data))] if len(data) else []
    ends = line_ends(data)
    n, (a, b, c, d) = len(ends), draws(doc_id, seed)
    if not n or c % 100 >= rate or any(m in _bytes(text) for m in MARKS):
        return n, "plain", None, None, whole
    first, second = sorted((a % (n + 1), b % (n + 1)))
    at = [int(ends[i - 1]) if i else 0 for i in (first, second)]
    prefix, rest = split(whole, at[0])
    middle, suffix = split(rest, at[1] - at[0])
    form, parts = "spm" if d % 100 < spm else "psm", (prefix, middle, suffix)
    pieces = [p for mark, part in FORMS[form] for p in (mark, *parts[part])]
    return n, form, characters(data[: at[0]]), characters(data[at[0] : at[1]]), pieces


def restored(output: memoryview, form: str) -> list[Piece]:
    """Descriptors over a written text that give back the text it was made from."""
    if form == "plain":
        return [(TEXT, 0, len(output))] if len(output) else []
    raw, starts, at = _bytes(output), [], 0
    for (_, mark, size), _part in FORMS[form]:
        at = raw.index(SENTINELS[mark : mark + size], at)
        starts.append((at, at + size))
        at += size
    stops = [s for s, _ in starts[1:]] + [len(raw)]
    spans = {part: (TEXT, begin, stop - begin) for (_, part), (_, begin), stop in zip(FORMS[form], starts, stops, strict=True)}
    return [spans[part] for part in range(3)]


def _bytes(view: memoryview) -> bytes:
    return view.obj if isinstance(view.obj, bytes) and len(view.obj) == len(view) else view.tobytes()


def texts_of(column: pa.Array):
    """The bytes of a string column's values, as they lie in its buffer; empty for a null."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = memoryview(column.buffers()[2] or b"")
    valid = column.is_valid().to_numpy(False)
    for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True):
        yield data[a:b] if ok else memoryview(b"")


def _handed_on(rows, schema: pa.Schema, size):
    """Record batches of rows, each of about `BATCH_BYTES` by `size`."""
    held, total = [], 0
    for row in rows:
        if held and total + size(row) > BATCH_BYTES:
            yield _batch(held, schema)
            held, total = [], 0
        held.append(row)
        total += size(row)
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def transformed(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Per row: doc_id, n (lines), form, prefix_chars, middle_chars, the piece table `pieces` and the text written from it.

    `rate` of 100 documents are transformed, `spm` of 100 of these get the form spm. Nothing is shuffled.
    """

    def write(batches):
        def rows():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for doc_id, text in zip(ids, texts_of(batch.column(1)), strict=True):
                    made = arranged(text, doc_id, rate, spm, seed)
                    pieces = [{"buffer": b, "start": s, "length": n} for b, s, n in made[4]]
                    yield doc_id, *made[:4], pieces, b"".join(streamed(made[4], (text, SENTINELS)))

        yield from _handed_on(rows(), _WRITTEN, lambda row: len(row[6]))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(write, OUTPUT)


def read_back(output: DataFrame) -> DataFrame:
    """Digests of the written texts, and of the texts that are read back from them by their form alone."""

    def read(batches):
        for batch in batches:
            out, back = [], []
            for form, text in zip(batch.column("form").to_pylist(), texts_of(batch.column("output")), strict=True):
                out.append(digest([(TEXT, 0, len(text))], (text,)))
                back.append(digest(restored(text, form), (text,)))
            kept = [batch.column(f.name) for f in list(_DIGESTS)[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string()), pa.array(back, pa.string())], schema=_DIGESTS)

    return output.drop("pieces").mapInArrow(read, DIGESTS)
