"""Recompression of word sequences into globally consistent symbols.

A text is a sequence of symbols, at first one for each word.  First runs of one
word get names; every round then names pairs whose left symbol is of the round's left class and
whose right symbol is of its right class.  Names and classes are functions of the
symbols alone, so that any two places with equal words get equal symbols wherever
the parse depends on nothing outside those words: names are global without an
exchange of tables between tasks.

Each symbol carries its context: the range of words that decides its parse.
Symbols whose context lies inside a window are functions of that window's words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from listwright.llm.words import mix

_FAR = np.int64(1) << 40
_A, _B, _RUN = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass
class Level:
    """Symbols of one level, in order of place; context is [low, high) in words."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray


def word_level(words: np.ndarray) -> Level:
    at = np.arange(len(words), dtype=np.int64)
    return Level(words, at, at + 1)


def named_runs(x: Level, edge: np.ndarray) -> tuple[Level, np.ndarray]:
    """Maximal runs of one symbol in a text become a symbol.

    Whether a symbol ends a run is decided by its neighbours, also where it stays
    single, so that every context takes in both.
    """
    n = len(x.name)
    if not n:
        return x, edge
    head = np.flatnonzero(np.concatenate([[True], (x.name[1:] != x.name[:-1]) | edge[1:]]))
    tail = np.concatenate([head[1:], [n]]) - 1
    count = tail - head + 1
    name = x.name[head]
    many = np.flatnonzero(count > 1)
    with np.errstate(over="ignore"):
        name[many] = mix(name[many] * _RUN + count[many].astype(np.uint64))
    after = np.minimum(tail + 1, n - 1)
    low = np.where(edge[head], -_FAR, x.low[np.maximum(head - 1, 0)])
    high = np.where((tail + 1 == n) | edge[after], _FAR, x.high[after])
    return Level(name, low, high), edge[head]


def next_level(x: Level, number: int, edge: np.ndarray) -> tuple[Level, np.ndarray]:
    """One round.  edge: whether a text begins at each symbol; returned for the new level."""
    n = len(x.name)
    bit = (mix(x.name + np.uint64(number + 1)) >> np.uint64(40)) & np.uint64(1)
    left, right = bit == 0, bit == 1
    inner = ~edge[1:]  # whether symbols i and i + 1 belong to one text
    merged = left[:-1] & right[1:] & inner
    # A symbol that stays depends on the neighbour with which it might have merged.
    low, high = x.low.copy(), x.high.copy()
    for stays, near in ((np.flatnonzero(right), -1), (np.flatnonzero(left), 1)):
        other = np.clip(stays + near, 0, n - 1)
        outside = (stays + near < 0) | (stays + near >= n) | (edge[stays] if near < 0 else edge[other])
        low[stays] = np.where(outside, -_FAR, np.minimum(x.low[stays], x.low[other]))
        high[stays] = np.where(outside, _FAR, np.maximum(x.high[stays], x.high[other]))
    pair = np.flatnonzero(merged)
    low[pair], high[pair] = np.minimum(x.low[pair], x.low[pair + 1]), np.maximum(x.high[pair], x.high[pair + 1])
    name = x.name.copy()
    with np.errstate(over="ignore"):
        name[pair] = mix(x.name[pair] * _A + mix(x.name[pair + 1] ^ _B))
    keep = np.ones(n, bool)
    keep[pair + 1] = False
    return Level(name[keep], low[keep], high[keep]), edge[keep]
