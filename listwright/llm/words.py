"""Vectorised word access for batches of texts.

All functions work on UTF-8 bytes of many texts at once, so that a task touches
each byte a handful of times inside numpy instead of once per word in Python.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles at most (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: Base of the rolling polynomial and its inverse modulo 2**64 (any odd number will do).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def noise(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_BASE))


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes separate words, what each byte becomes) for tokenize()."""
    sep = np.zeros(256, bool)
    sep[np.frombuffer(separators, np.uint8)] = True
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    return sep, to


#: White space of the word-based operators: space and the bytes 9 to 13.
SPACES = bytes([32, *range(9, 14)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INVERSE)):
                row = np.full(size, b, np.uint64)
                row[0] = 1
                _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


_BYTES = noise(256, 7)


@dataclass
class Words:
    """The words of a step: text i owns words first[i] to first[i + 1]."""

    data: np.ndarray  # bytes, after mapping
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        up, down = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=total[1:])
            return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def tokenize(texts: list[bytes], sep: np.ndarray, to: np.ndarray) -> Words:
    """Maximal runs of bytes that are not separators, for each text."""
    data = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    data = to[data]
    inside = ~sep[data]
    inside[ends - 1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return Words(data, start, end, np.concatenate([[0], np.searchsorted(start, ends)]))


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes together."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column; null: empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
