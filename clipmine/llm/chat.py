"""Chat formatting with one training example for every assistant turn.

A conversation is written once, turn after turn:

    ### role: text </turn>⏎

Inside role and text the characters of the marks are escaped: `\\` as `\\\\`, `#` as `\\h`, `<` as `\\l`, and in the
role also `:` as `\\c`; no mark can then occur in a text, and the escape is undone exactly. Every assistant turn
becomes an example: all that stands before its text in the conversation is the context, the escaped text the only
trainable part. `formatted` gives examples as positions in the conversation (`context_chars`, `target_start`,
`target_chars`), `written` writes them out, each with its whole context, and `read_examples` rebuilds the conversations from
nothing but the written examples. Contexts of one conversation with n turns take n^2 text, so they are written in pieces of
`PIECE` characters from a file that holds the conversation so far: a task's memory doesn't grow with the conversation, its
time does.

Turns are taken in order of turn, role, text. Defined cases: a null text is empty; a null role is empty; null turns
come first; a conversation without an assistant has no example; a null conv_id is a conversation of its own;
an empty table gives an empty table; extra columns are ignored. A conversation's turns stream through one task in
order (its digest has to), a turn at a time, so memory doesn't grow with the conversation.
"""

from __future__ import annotations

import hashlib
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
TURNS = "conv_id long, place long, segment string, start long, example long, context_chars long, target_start long, target_chars long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"

#: Characters of an example's context in one row, and in one batch of rows.
PIECE, BATCH = 1 << 16, 1 << 21
WRITTEN = "conv_id long, example long, part string, text string"

_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TEXT = str.maketrans({k: v for k, v in _ESCAPES.items() if k != ":"})
_ROLE = str.maketrans(_ESCAPES)


def escape(text: str, role: bool = False) -> str:
    return text.translate(_ROLE if role else _TEXT)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def in_order(turns: DataFrame) -> DataFrame:
    """The turns of a conversation together and in order; its rows are read one after the other."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn: its segment of the conversation's text, where it starts, and the example it is the target of."""

    def write(batches):
        conv, place, start, example = object(), 0, 0, 0
        for batch in batches:
            out = []
            for cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if cid != conv:
                    conv, place, start, example = cid, 0, 0, 0
                head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
                segment = f"{head}{body}{CLOSE}"
                target = role == "assistant"
                at = start + len(head)
                out.append((cid, place, segment, start, example if target else None, at if target else None, at if target else None, len(body) if target else None))
                place, start, example = place + 1, start + len(segment), example + target
            yield _batch(out, write_schema)

    write_schema = _arrow(TURNS)
    return in_order(turns).mapInArrow(write, TURNS)


def written(output: DataFrame) -> DataFrame:
    """The examples of `formatted` (a conversation's rows together and in order) written out, part by part.

    `part` is `context` (all that stands before the target, in rows of at most `PIECE` characters), `target` (the trained
    text, escaped) or, once at the end of each conversation and of no example, `rest`: what follows its last target.
    """

    def write(batches):
        conv, text, done, rows, size = object(), None, 0, [], 0

        def pieces(start: int):
            text.seek(start)
            return iter(lambda: text.read(PIECE), "")

        def parts():
            nonlocal conv, text, done
            for batch in batches:
                names = ("conv_id", "segment", "start", "example", "target_start", "target_chars")
                for cid, segment, start, example, at, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if text is None or cid != conv:
                        if text is not None:
                            yield from rest()
                        conv, done = cid, 0
                        text = tempfile.SpooledTemporaryFile(1 << 20, "w+", encoding="utf-8", newline="")
                    text.seek(0, 2)
                    if example is None:
                        text.write(segment)
                        continue
                    head = segment[: at - start]
                    text.write(head)
                    for piece in pieces(0):
                        yield conv, example, "context", piece
                    yield conv, example, "target", segment[at - start : at - start + n]
                    text.seek(0, 2)
                    text.write(segment[at - start : at - start + n])
                    done = text.tell()
                    text.write(segment[at - start + n :])
            if text is not None:
                yield from rest()

        def rest():
            for piece in pieces(done):
                yield conv, None, "rest", piece
            text.close()

        for row in parts():
            rows.append(row)
            size += len(row[3])
            if size >= BATCH or len(rows) >= 4096:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    schema = _arrow(WRITTEN)
    return output.mapInArrow(write, WRITTEN)


def read_examples(examples_: DataFrame) -> DataFrame:
    """The columns of `read_back`, from examples as `written` leaves them.

    A conversation is put together from what each context adds to the example before it, from targets and the rest; that a
    context begins with the whole example before it is checked by its digest.
    """
    mark = re.compile(rf"{OPEN}([^:]*): (.*){CLOSE}", re.S)

    class Conversation:
        def __init__(self):
            self.turns, self.loss, self.known = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            self.n = self.chars = self.loss_chars = self.examples = self.example_chars = 0
            self.open, self.context = "", None

        def add(self, text: str) -> None:
            """More of the conversation's text; whole turns are parsed and forgotten."""
            self.chars += len(text)
            self.known.update(text.encode())
            *whole, self.open = (self.open + text).split(CLOSE)
            for segment in whole:
                role, said = mark.fullmatch(segment + CLOSE).groups()
                self.n += 1
                self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())

        def take(self, part: str, text: str) -> None:
            if part == "rest":
                return self.add(text)
            if self.context is None:  # an example begins
                self.context = [0, self.chars, hashlib.sha256(), self.known.digest()]
            at, before, seen, want = self.context
            self.context[0] += len(text)
            if part == "context":
                old = text[: max(0, before - at)]
                seen.update(old.encode())
                return self.add(text[len(old) :])
            if seen.digest() != want:
                raise ValueError("an example's context doesn't begin with the example before it")
            self.examples, self.example_chars, self.context = self.examples + 1, self.example_chars + self.context[0], None
            reply = unescape(text)
            self.loss_chars += len(reply)
            self.loss.update(reply.encode())
            self.add(text)

        def row(self, conv) -> tuple:
            return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.examples, self.example_chars)

    def read(batches):
        conv, state = None, None
        for batch in batches:
            out = []
            for cid, part, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text")), strict=True):
                if state is None or cid != conv:
                    if state is not None:
                        out.append(state.row(conv))
                    conv, state = cid, Conversation()
                state.take(part, text)
            if out:
                yield _batch(out, schema)
        if state is not None:
            yield _batch([state.row(conv)], schema)

    schema = _arrow(READ)
    return examples_.mapInArrow(read, READ)


def examples(output: DataFrame) -> DataFrame:
    """Every example written out: conv_id, example, context, reply (texts as formatted)."""
    targets = output.where(F.col("example").isNotNull()).select("conv_id", "example", F.col("place").alias("at"), "target_start", "target_chars", F.col("start").alias("seg_start"), F.col("segment").alias("own"))
    before = output.select(F.col("conv_id").alias("c"), "place", "segment")
    joined = targets.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") < F.col("at")), "left")
    parts = joined.groupBy("conv_id", "example", "own", "seg_start", "target_start", "target_chars").agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("p"))
    head: Column = F.col("target_start") - F.col("seg_start")
    return parts.select(
        "conv_id",
        "example",
        F.concat(F.array_join(F.col("p.segment"), ""), F.substring("own", F.lit(1), head.cast("int"))).alias("context"),
        F.substring("own", (head + 1).cast("int"), F.col("target_chars").cast("int")).alias("reply"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """Per conversation: what its formatted text and its loss spans say.

    `output` has the rows of `formatted`, a conversation's together and in order (as `formatted` leaves them).
    Roles and texts are parsed from the segments, the trained text is cut out at the spans.
    """
    mark = re.compile(rf"{OPEN}([^:]*): (.*){CLOSE}", re.S)

    def read(batches):
        conv, state = object(), None

        def row():
            n, sha, loss, loss_sha, chars, examples, example_chars = state
            return (conv, n, sha.hexdigest(), loss, loss_sha.hexdigest(), chars, examples, example_chars)

        for batch in batches:
            out = []
            names = ("conv_id", "segment", "start", "example", "target_start", "target_chars")
            for cid, segment, start, example, at, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if state is None or cid != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = mark.fullmatch(segment).groups()
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                if example is not None:
                    reply = unescape(segment[at - start : at - start + n])
                    state[2] += len(reply)
                    state[3].update(reply.encode("utf-8", "surrogatepass"))
                    state[5] += 1
                    state[6] += at + n
            if out:
                yield _batch(out, read_schema)
        if state is not None:
            yield _batch([row()], read_schema)

    read_schema = _arrow(READ)
    return output.mapInArrow(read, READ)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
