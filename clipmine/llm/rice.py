"""Golomb-Rice coding of sorted distinct 64-bit numbers, and bitmaps, as bytes that travel in a shuffle.

A sorted list of n hashes out of a range of size R has gaps of about R / n. Each gap is split at k bits,
k the logarithm of the mean gap: the high part is written in unary, the low part as k plain bits. That costs
about k + 1.6 bits a hash instead of 64.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBIQ")  # count, k, bytes of the unary part, first number
_SLICE = 1 << 16


def encode(values: np.ndarray) -> bytes:
    """`values`: sorted distinct uint64."""
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values) - np.uint64(1)
    mean = (int(values[-1]) - int(values[0])) // n
    k = max(0, mean.bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    unary[ones] = 1
    head = np.packbits(unary).tobytes()
    low = []
    for i in range(0, len(gaps) if k else 0, _SLICE):  # a multiple of 8 rows, so slices end at whole bytes
        part = gaps[i : i + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        low.append(np.packbits(np.unpackbits(part, axis=1)[:, 64 - k :].ravel()).tobytes())
    return _HEAD.pack(n, k, len(head), int(values[0])) + head + b"".join(low)


def decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, k, size, first = _HEAD.unpack_from(data)
    at = _HEAD.size + size
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, _HEAD.size)))[: n - 1]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.frombuffer(data, np.uint8, -1, at)
        for i in range(0, n - 1, _SLICE):
            m = min(_SLICE, n - 1 - i)
            bits = np.unpackbits(low[i * k // 8 : i * k // 8 + (m * k + 7) // 8])[: m * k].reshape(m, k)
            wide = np.zeros((m, 64), np.uint8)
            wide[:, 64 - k :] = bits
            gaps[i : i + m] |= np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        np.cumsum(gaps + np.uint64(1), out=out[1:])
        out[1:] += np.uint64(first)
    return out


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def seen_twice(lists: list[np.ndarray]) -> np.ndarray:
    """The numbers, sorted, that occur in two of the lists or more (each list holds a number once)."""
    every = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    again = every[1:][every[1:] == every[:-1]]
    return np.unique(again)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of `values` are in the sorted `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values
