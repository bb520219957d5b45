"""Unigram token counts of texts by dynamic programming in a trie.

The distinct pre-tokens of the texts a task reads are inserted into a trie. A node stands for a prefix and keeps the
best forward score of that prefix and the number of tokens on its best path, computed once from the nodes above it
when it is made; pre-tokens that share a prefix share the work. The count at a pre-token's last node is kept
with the pre-token. A text's count is the sum over its pre-tokens. Nothing is shuffled. A trie of `NODES` nodes is
emptied and begun anew, and so are the counts of `WORDS` pre-tokens, which changes no result: memory is bounded
whatever a task reads.

Defined cases: a null or empty text has no tokens; rows may repeat; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmine.llm.pieces import Pieces, load, words

NODES, WORDS = 400_000, 500_000


class _Counts(dict):
    """Number of tokens by pre-token; one that isn't known yet is inserted into the trie."""

    def __init__(self, trie: "Trie"):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        return self.trie.insert(word)


class Trie:
    """Forward scores and token counts by prefix; `trie.counts[word]` is the word's number of tokens."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        #: How long a piece can be that ends with these two characters.
        self.reach: dict[str, int] = {}
        for p in pieces.scores:
            self.reach[p[-2:]] = max(self.reach.get(p[-2:], 1), len(p))
        self.counts = _Counts(self)
        self.clear()

    def clear(self) -> None:
        """Forget the nodes; the counts of pre-tokens stay."""
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def insert(self, word: str) -> int:
        if len(self.score) > NODES:
            self.clear()
        child, score, tokens = self.child, self.score, self.tokens
        known, reach = self.pieces.scores, self.reach
        node, path = 0, [0]
        for i, ch in enumerate(word):
            key = node << 21 | ord(ch)
            node = child.get(key, -1)
            if node < 0:
                end, best, n = i + 1, float("-inf"), 0
                for start in range(max(0, end - reach.get(word[max(0, i - 1) : end], 1)), end):
                    s = known.get(word[start:end])
                    if s is not None and score[path[start]] + s > best:
                        best, n = score[path[start]] + s, tokens[path[start]] + 1
                if ch not in known and score[path[i]] + self.pieces.unknown > best:
                    best, n = score[path[i]] + self.pieces.unknown, tokens[path[i]] + len(ch.encode("utf-8", "surrogatepass"))
                node = child[key] = len(score)
                score.append(best)
                tokens.append(n)
            path.append(node)
        if len(self.counts) >= WORDS:
            self.counts.clear()
        self.counts[word] = tokens[node]
        return tokens[node]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens."""

    def scan(batches):
        counts = Trie(load(model)).counts  # let go at the end of the task: workers live on
        for batch in batches:
            split = [words(t or "") for t in batch.column(1).to_pylist()]
            totals = [sum(map(counts.__getitem__, w)) for w in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, split), pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, n_pretokens long, n_tokens long")
