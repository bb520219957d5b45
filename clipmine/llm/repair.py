"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

The roles of a conversation are legal if their initials read `(s?(ua)+)?`. Rows may be kept (K, 0), given the role user
or assistant (R, 2), deleted (D, 3), and empty user or assistant rows inserted anywhere (I, 2). A blank or repeated row
has to be deleted, a truncated one that stays costs 1 more. Of the cheapest edits the ASCII-least string of letters is
taken.

**One integer decides.** The weight of a path is `cost << 3 * width | letters`: the letters D, I, K, R are the octal
digits 1 to 4, written from the left and padded with zeros to a fixed width. The smallest integer is then the cheapest
path and of equal ones the ASCII-least, so an ordinary shortest-path recurrence over (rows read, last role) does
everything. Two paths to one node never hold one another as a proper prefix at equal cost, because they could only
differ by inserts, which cost; so a minimum taken midway stays right whatever follows.

**Blocks.** The recurrence is a product of small matrices (role before, role after), so a conversation is cut into
blocks of `BLOCK` rows that are solved in any task. Facts of rows (no texts) are sorted by range over all tasks, a hot
conversation over many of them; the blocks' paths are then folded in order, one conversation after the other, letting go
of what all paths have in common. Texts are shuffled once, together with the letters, to write the repaired rows; only
that pass and the digest of a conversation read one conversation in one task, row by row.

Order: by turn (nulls first), then role, then the SHA-256 of role and text. Defined cases: a null role or text is one
space (so blank); a null conv_id is a conversation of its own; equal rows count as often as they occur, all but the
first as repeated; an empty table gives an empty table; extra columns are ignored, whatever their names. A row's role
may be any string: roles that don't begin with s, u or a can only be changed or deleted.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmine.llm.tables import stored

BLOCK = 128
LETTERS = "DIKR"
DELETE, INSERT, KEEP, RENAME = range(1, 5)
COST = {DELETE: 3, INSERT: 2, KEEP: 0, RENAME: 2}

#: Roles so far: none, system, ... user, ... assistant. Legal ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: From which states a role may follow, and where it leads.
USER_FROM, ASSISTANT_FROM = (START, SYSTEM, ASSISTANT), (USER,)
INITIAL = {"s": ((START,), SYSTEM), "u": (USER_FROM, USER), "a": (ASSISTANT_FROM, ASSISTANT)}

BLANK, REPEATED, TRUNCATED = 1, 2, 3
_BLANK = r"[^\x20\x09-\x0D]"

Path = tuple[int, int, int]  # cost, letters as octal digits, number of letters


def lighter(a: Path | None, b: Path | None) -> Path | None:
    """The path of the smaller weight; both weights are written with the same number of digits."""
    if a is None or b is None:
        return a or b
    width = 3 * max(a[2], b[2])
    weight = lambda p: p[0] << width | p[1] << (width - 3 * p[2])
    return a if weight(a) <= weight(b) else b


def solve(rows: list[tuple[str, int]], start: int, closing: bool = False) -> list[Path | None]:
    """The lightest path from `start` over rows (initial, fault) to every state.

    Weights are integers of one fixed width; the k-th letter of a path adds its digit at the k-th place. Rows may be
    inserted before every row, after the last one only if `closing`.
    """
    width = 3 * len(rows) + 2
    unit = [1 << 3 * (width - 1 - k) for k in range(width)]
    cost_of = 1 << 3 * width
    nodes: list[tuple[int, int] | None] = [None] * 4
    nodes[start] = (0, 0)

    def step(node, letter: int, more: int = 0):
        weight, k = node
        return weight + (COST[letter] + more) * cost_of + letter * unit[k], k + 1

    def offer(into, state: int, node) -> None:
        if into[state] is None or node[0] < into[state][0]:
            into[state] = node

    def inserts() -> None:
        for sources, target in ((USER_FROM, USER), (ASSISTANT_FROM, ASSISTANT)):
            for source in sources:
                if nodes[source]:
                    offer(nodes, target, step(nodes[source], INSERT))

    for initial, fault in rows:
        inserts()
        after: list[tuple[int, int] | None] = [step(n, DELETE) if n else None for n in nodes]
        if fault not in (BLANK, REPEATED):
            more = int(fault == TRUNCATED)
            moves = [(KEEP, *INITIAL[initial])] if initial in INITIAL else []
            for letter, sources, target in (*moves, (RENAME, USER_FROM, USER), (RENAME, ASSISTANT_FROM, ASSISTANT)):
                for source in sources:
                    if nodes[source]:
                        offer(after, target, step(nodes[source], letter, more))
        nodes = after
    if closing:
        inserts()
    low = cost_of - 1
    return [(n[0] // cost_of, (n[0] & low) >> 3 * (width - n[1]), n[1]) if n else None for n in nodes]


def letters(path: Path) -> str:
    _, digits, n = path
    return f"{digits:o}".translate(str.maketrans("1234", LETTERS)) if n else ""


def audit(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the best repair of a whole conversation."""
    found = solve(rows, START, closing=True)
    best = lighter(found[START], found[ASSISTANT])
    return best[0], letters(best)


# damage and facts of rows


def damaged(turns: DataFrame) -> DataFrame:
    """Test data: rows of `turns` damaged by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes
    the sentence ends out of it, 3 repeats it, 4 makes it the user's. A null is one space, in the key too."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role"), _or_space("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `said`, a digest of role and text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_space("role"), _or_space("text"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    return rows.withColumn("said", said)


ORDER = ("conv_id", "turn", "role", "said")


def facts(rows: DataFrame) -> DataFrame:
    """Facts of the rows of `keyed` without their texts: `ORDER`, `fault` (blank and truncated) and `again` (said at an earlier turn)."""
    found = F.regexp_extract("text", rf"({_BLANK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(found == "", BLANK).when(~found.rlike("[.!?]"), TRUNCATED).otherwise(0)
    plain = rows.select(*ORDER, fault.alias("fault"))
    first = plain.groupBy(F.col("conv_id").alias("in"), F.col("said").alias("what")).agg(F.min(F.struct("turn")).alias("first"))
    joined = plain.join(first, F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("said") == F.col("what")))
    return joined.select(*ORDER, "fault", (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"))


# blocks


BLOCKS = (
    "conv_id long, turn long, role string, said binary, block long, opening_turn long, closing_turn long, turns long, first string, last string, "
    "blank long, repeated long, truncated long, illegal long, source array<int>, target array<int>, cost array<long>, path array<string>"
)
_LEGAL = {"su", "ua", "au"}


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The facts in order over all tasks, cut into blocks of one conversation, each solved from every state."""
    schema = _schema(BLOCKS)

    def cut(batches):
        held: list[tuple] = []
        before: tuple | None = None
        number, fresh = 0, False  # fresh: the held rows begin a conversation, so no other state leads into them

        def solved() -> tuple:
            nonlocal number
            number += 1
            first = held[0][:4]
            roles = [(r[2][:1], r[4]) for r in held]
            kinds = [k for _, k in roles]
            pairs = [a[0] + b[0] for a, b in zip(roles, roles[1:], strict=False)]
            known = [r[1] for r in held if r[1] is not None]
            starts = (START,) if fresh else range(4)
            found = [(s, t, p) for s in starts for t, p in enumerate(solve(roles, s)) if p]
            counts = [kinds.count(k) for k in (BLANK, REPEATED, TRUNCATED)]
            illegal = sum(p not in _LEGAL for p in pairs)
            span = (known[0], known[-1]) if known else (None, None)
            out = (*first, number, *span, len(set(known)), roles[0][0], roles[-1][0], *counts, illegal)
            return (*out, [s for s, _, _ in found], [t for _, t, _ in found], [p[0] for _, _, p in found], [letters(p) for _, _, p in found])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, fault, again = row[:4], row[4], row[5]
                if fault != BLANK and (again or key == before):
                    fault = REPEATED
                if held and (held[0][0] != key[0] or len(held) == size):
                    out.append(solved())
                    held.clear()
                if not held:
                    fresh = before is not None and before[0] != key[0]
                held.append((*key, fault))
                before = key
            yield from _batches(out, schema)
        if held:
            yield from _batches([solved()], schema)

    ordered = rows.select(*ORDER, "fault", "again").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(cut, BLOCKS)


CHOSEN = (
    "conv_id long, turn long, role string, said binary, block long, letters string, "
    "gaps long, blank long, repeated long, truncated long, illegal long, cost long, n long"
)


def chosen(solved: DataFrame) -> DataFrame:
    """The letters of every block on the best path, in the block's place; and for each conversation a row (its `block` is
    null) with gaps, blank, repeated, truncated, illegal and cost."""
    schema = _schema(CHOSEN)

    def fold(batches):
        conv, state = object(), None

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        out.extend(state.finish())
                    conv, state = row["conv_id"], _Fold(row["conv_id"])
                out.extend(state.add(row))
            yield from _batches(out, schema)
        if state is not None:
            yield from _batches(state.finish(), schema)

    placed = solved.repartition("conv_id").sortWithinPartitions(*ORDER, "block")
    return placed.mapInArrow(fold, CHOSEN)


class _Fold:
    """The lightest paths of a conversation to each state, from block to block.

    A path holds its letters for the blocks that aren't settled yet. A block is settled once all paths agree on it.
    """

    def __init__(self, conv):
        self.conv = conv
        self.paths: list[tuple[Path, tuple[str, ...]] | None] = [((0, 0, 0), ()), None, None, None]
        self.open: list[tuple] = []  # places of blocks that aren't settled
        self.blank = self.repeated = self.truncated = self.illegal = self.turns = 0
        self.last, self.low, self.high = None, None, None

    def add(self, row: dict) -> list[tuple]:
        self.blank += row["blank"]
        self.repeated += row["repeated"]
        self.truncated += row["truncated"]
        self.illegal += row["illegal"] + (self.last is not None and self.last + row["first"] not in _LEGAL)
        self.last = row["last"]
        if row["closing_turn"] is not None:
            # Turns come in order: the only one that this block can share with those before is the last of these.
            self.turns += row["turns"] - (row["opening_turn"] == self.high)
            self.low = row["opening_turn"] if self.low is None else self.low
            self.high = row["closing_turn"]
        after: list[tuple[Path, tuple[str, ...]] | None] = [None] * 4
        for source, target, cost, path in zip(row["source"], row["target"], row["cost"], row["path"], strict=True):
            if self.paths[source]:
                self._offer(after, target, self.paths[source], cost, path)
        self.paths = after
        self.open.append((row["turn"], row["role"], row["said"], row["block"]))
        return self._settled()

    def _offer(self, into: list, target: int, before: tuple, cost: int, path: str) -> None:
        (c, digits, n), parts = before
        octal = path.translate(str.maketrans(LETTERS, "1234"))
        made = (c + cost, digits << 3 * len(path) | int(octal or "0", 8), n + len(path))
        if into[target] is None or lighter(into[target][0], made) is made:
            into[target] = (made, (*parts, path))

    def _settled(self) -> list[tuple]:
        live = [p for p in self.paths if p]
        n = 0
        while n < len(self.open) and len({parts[n] for _, parts in live}) == 1:
            n += 1
        out = [(self.conv, *place, letters) + (None,) * 7 for place, letters in zip(self.open[:n], live[0][1][:n], strict=True)]
        if n:
            done = sum(map(len, live[0][1][:n]))
            keep = lambda p: (p[0], p[1] & ((1 << 3 * (p[2] - done)) - 1), p[2] - done)
            self.paths = [p and (keep(p[0]), p[1][n:]) for p in self.paths]
            self.open = self.open[n:]
        return out

    def finish(self) -> list[tuple]:
        """Rows may still be inserted at the end; they count as a block without rows of its own."""
        end = [None] * 4
        for source in range(4):
            for target, path in enumerate(solve([], source, closing=True)):
                if path and self.paths[source]:
                    self._offer(end, target, self.paths[source], path[0], letters(path))
        best = end[START]
        if best is None or end[ASSISTANT] and lighter(best[0], end[ASSISTANT][0]) is end[ASSISTANT][0]:
            best = end[ASSISTANT]
        out = [(self.conv, *place, letters) + (None,) * 7 for place, letters in zip(self.open, best[1], strict=False)]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [*out, (self.conv, None, None, None, None, best[1][-1], gaps, self.blank, self.repeated, self.truncated, self.illegal, best[0][0], None)]


# repaired rows


EDITS = "conv_id long, edit string, role string, text string, gaps long, blank long, repeated long, truncated long, illegal long, cost long"


def repaired(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """The edits of every conversation, in order: `edit` (D, I, K or R) with the repaired `role` and `text` (null where
    deleted). The last row of a conversation has no edit but its counts and cost.

    A conversation's rows lie together and in order, as this leaves them.
    """
    rows = keyed(turns)
    found = stored(chosen(blocks(stored(facts(rows)), size)))
    schema = _schema(EDITS)

    def write(batches):
        conv, queue, at, state = object(), "", 0, START
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, queue, at, state = row["conv_id"], "", 0, START
                if row["kind"] == 0:
                    queue, at = queue[at:] + row["letters"], 0
                    continue
                counts = (None,) * 6
                if row["kind"] == 2:
                    queue, at = queue[at:] + row["letters"], 0
                    counts = tuple(row[n] for n in ("gaps", "blank", "repeated", "truncated", "illegal", "cost"))
                while at < len(queue):
                    letter = queue[at]
                    at += 1
                    role, text = row["role"], row["text"]
                    if letter == "D":
                        out.append((conv, letter, None, None) + (None,) * 6)
                        break
                    if letter != "K":
                        role = "assistant" if state == USER else "user"
                    state = INITIAL[role[:1]][1]
                    out.append((conv, letter, role, "" if letter == "I" else text) + (None,) * 6)
                    if letter != "I":
                        break
                if row["kind"] == 2:
                    out.append((conv, None, None, None, *counts))
            yield from _batches(out, schema)

    counts = ("gaps", "blank", "repeated", "truncated", "illegal", "cost")
    none = lambda *names: [F.lit(None).cast("string" if n in ("text", "letters") else "long").alias(n) for n in names]
    script = found.select(*ORDER, F.when(F.col("block").isNull(), 2).otherwise(0).alias("kind"), *none("text"), "block", "letters", *counts)
    texts = rows.select(*ORDER, F.lit(1).alias("kind"), "text", *none("block", "letters", *counts))
    last = F.col("kind") == 2
    both = script.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", last, "turn", "role", "said", "kind", "block")
    return both.drop("turn", "said", "block").mapInArrow(write, EDITS)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(edits: DataFrame) -> DataFrame:
    """Per conversation: its counts, the letters of its edits, and the digest of its repaired rows (`role:text`, a line feed between)."""
    schema = _schema(REPORT)

    def read(batches):
        conv, sha, first, done = object(), hashlib.sha256(), True, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, sha, first, done = row["conv_id"], hashlib.sha256(), True, []
                if row["edit"] is None:
                    counts = (row[n] for n in ("gaps", "blank", "repeated", "truncated", "illegal", "cost"))
                    out.append((conv, *counts, "".join(done), sha.hexdigest()))
                    conv = object()
                    continue
                done.append(row["edit"])
                if row["edit"] != "D":
                    sha.update(f"{'' if first else chr(10)}{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
                    first = False
            yield from _batches(out, schema)

    return edits.mapInArrow(read, REPORT)


def with_empty(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The report of every conversation of `turns`; one without rows after the damage has zeros."""
    every = turns.select(F.col("conv_id").cast("long").alias("every")).distinct()
    joined = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    kind = lambda t: pa.list_(_KINDS[t[6:-1]]) if t.startswith("array<") else _KINDS[t]
    return pa.schema([(n, kind(t)) for n, t in re.findall(r"(\w+) ([\w<>]+)", ddl)])


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 1024):
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
