"""Hashes of words and of runs of words for many texts at once, with numpy inside a task.

A word is a maximal run of characters other than tab, line feed, vertical tab, form feed, carriage return and
space. Its hash is a polynomial of its UTF-8 bytes taken from prefix sums, then mixed; a run's hash is a
polynomial of word hashes. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = 0xD1342543DE82EF95 | 1
_SEGMENT = 1 << 19


def release() -> None:
    """Give freed memory back to the system. A Python worker lives on after its task, and what it keeps counts."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 with a seed."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or those of the inverse; kept for sizes that are powers of two."""
    size = 1 << max(10, (n - 1).bit_length())
    return _powers(pow(base, -1, 1 << 64) if inverse else base, size)[:n]


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(_BASE, len(data) + 1, True)[start]
    return start, end, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and per word its start and end there, its hash and the index of its text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    first = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1] if parts else np.zeros(0, np.int64)
    raw = b"\n".join(parts)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + _SEGMENT)
        while stop < len(data) and not _SPACE[data[stop]]:  # a segment ends where a word does
            stop += 1
        s, e, h = _segment_words(data[at:stop])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(0, np.uint64), none
    start = np.concatenate(starts)
    return raw, start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(first, start, "right") - 1


def runs(hashes: np.ndarray, doc: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `n` words that lies in one text, and which run starts do (a mask over the words)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(hashes), bool)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    for i in range(0, len(out), _SEGMENT):
        part = hashes[i : i + _SEGMENT + n - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_RUN, len(part)), out=total[1:])
        m = len(part) - n + 1
        out[i : i + m] = (total[n : n + m] - total[:m]) * powers(_RUN, m, True)
    whole = np.zeros(len(hashes), bool)
    whole[: len(out)] = doc[n - 1 :] == doc[: len(out)]
    return mix(out[whole[: len(out)]], seed + n), whole


def batches(rows, size: int = 1 << 19):
    """Groups of up to 65,536 rows (tuples that end with a text or None) of about `size` characters; a longer text is alone."""
    group, held = [], 0
    for row in rows:
        n = len(row[-1] or "")
        if group and (held + n > size or len(group) == 1 << 16):  # a text's number in its group has 16 bits
            yield group
            group, held = [], 0
        group.append(row)
        held += n
    if group:
        yield group
    del group
    release()
