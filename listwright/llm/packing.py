"""Packing of token sequences into windows by the sum-of-squares rule.

Documents arrive one after another in each partition.  Whole windows are cut off a
long document; each remainder goes, uncut, to the fill level that makes the sum of the
squared numbers of partially filled windows, by level, smallest.  A level array holds
those numbers.  At the end of a partition its partially filled windows are poured, cut
freely, into as few windows as hold them, so that one window of a partition at most is
padded.  Windows never cross partitions: partitions are packed at once and again after a
loss with equal results, as a scan deals rows out alike each time.

A null text is empty and holds the end token alone.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents

WINDOW, END = 2048, 1
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a task remembers; then it starts anew.
REMEMBERED = 600_000
#: Bytes of a word that is merged here at most.
LONGEST = 64


class Merges:
    """The vocabulary's merges, applied to many words at once: in each round, every word merges its pair of lowest rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        # Byte-level vocabularies write a byte as its own character where it is printable, else as one from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden_ = [b for b in range(256) if b not in set(shown)]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden_)}
        suffix = model.get("end_of_word_suffix") or ""
        self.byte, self.last = (np.array([vocab[chars[b] + x] for b in range(256)], np.int64) for x in ("", suffix))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number for each word)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.byte[data]
        lengths = np.array([len(w) for w in words], np.int64)
        ends = (np.cumsum(lengths) - 1)[lengths > 0]
        ids[ends] = self.last[data[ends]]
        own, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(ids))
        none = len(self.key)
        done = []
        while len(ids):
            wanted = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.key, wanted), none - 1)
            rank = np.append(np.where((self.key[at] == wanted) & (own[1:] == own[:-1]), self.rank[at], none), none)
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(ids))))
            hit = np.flatnonzero((rank == best) & (best < none))
            first = hit[np.concatenate([[True], own[hit][1:] != own[hit][:-1]])] if len(hit) else hit
            ids[first] = self.into[at[first]]
            over, stay = best == none, np.ones(len(ids), bool)
            stay[first + 1] = False
            done.append((place[over], ids[over], own[over]))
            stay &= ~over
            ids, own, place = ids[stay], own[stay], place[stay]
        place, ids, own = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 3
        order = np.argsort(place)
        return ids[order], np.bincount(own, minlength=len(words))


class Encoder:
    """Token ids of texts.

    White space separates words before all else in this vocabulary, and A-Z are lower-cased, so each
    distinct word is encoded once.  Words of letters, with stops or commas after them, are merged here, many
    at a time; all others go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes] | None:
        """(letters, stops) of a plain word as the vocabulary's normaliser leaves them; null for all other words."""
        letters = word.rstrip(b".,;:!?")
        if not letters.isalpha():  # not ASCII letters alone
            text = letters.decode()
            if not text.isalpha() or "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
                return None
            letters = text.lower().encode()
        if len(word) > LONGEST:
            return None
        return letters, word[len(word.rstrip(b".,;:!?")) :]

    def _learn(self, words: list[bytes]) -> None:
        plain, odd, parts = [], [], []
        for w in words:
            if (p := self._parts(w)) is None:
                odd.append(w)
            else:
                plain.append(w)
                parts += p
        ids, count = self.merges(parts)
        count = count.reshape(-1, 2).sum(1)
        more = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]
        count = np.concatenate([count, [len(x) for x in more]]).astype(np.int64)
        first = len(self.begin)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32), *more])
        self.known.update(zip(plain + odd, range(first, first + len(words))))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        known, split = self.known, [t.encode().lower().replace(b"\n", b" ").split(b" ") for t in texts]
        if new := list({w for words in split for w in words if w not in known}):
            self._learn(new)
        at = np.fromiter((known[w] for words in split for w in words), np.int64)
        count = self.count[at]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat(self.begin[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [np.append(flat[a:b], np.uint32(END)) for a, b in zip(cut[:-1], cut[1:])]


class SumOfSquares:
    """Windows of a partition.  Pieces are (document number, start, length)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # of partial windows by level; level 0: new, level window: full
        self.open: list[list[list[tuple[int, int, int]]]] = [[] for _ in range(window + 1)]

    def place(self, doc: int, start: int, length: int) -> list[tuple[int, int, int]] | None:
        """Puts a piece shorter than a window; returns the window if that fills it."""
        # Moving a window from level h to h + length changes the sum of squares by
        # 2 (N[h + length] - N[h] + 1); a new one by 2 N[length] + 1, a filled one by 1 - 2 N[h].
        top = self.window - length
        gain = 2 * (self.count[length : self.window + 1] - self.count[: top + 1]) + 2
        gain[0] = 2 * self.count[length] + 1
        gain[top] = 1 - 2 * self.count[top]
        gain[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = int(gain.argmin())
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append((doc, start, length))
        if level + length == self.window:
            return pieces
        self.count[level + length] += 1
        self.open[level + length].append(pieces)
        return None

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """The partial windows, poured together."""
        held, room = [], self.window
        for windows in reversed(self.open):
            for pieces in windows:
                for doc, start, length in pieces:
                    while length:
                        take = min(length, room)
                        held.append((doc, start, take))
                        start, length, room = start + take, length - take, room - take
                        if not room:
                            yield held
                            held, room = [], self.window
        if held:
            yield held


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack_batches(window: int, path: str, columns: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(path), SumOfSquares(window)
        tokens: dict[int, tuple[int | None, np.ndarray, int]] = {}  # id, tokens from `cut` on and cut, of documents in open windows
        sequence = TaskContext.get().partitionId() << 36
        number = 0

        def rows_of(pieces: list[tuple[int, int, int]], out: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, length in pieces:
                name, ids, cut = tokens[doc]
                out.append((name, start, length, ids[start - cut : start - cut + length].tobytes(), len(ids) + cut, sequence, offset))
                offset += length
                if start + length == cut + len(ids):
                    del tokens[doc]
            sequence += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(),) * 3 + (pa.binary(),) + (pa.int64(),) * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            names, texts = batch[columns[0]].to_pylist(), batch[columns[1]].to_pylist()
            for a in range(0, len(texts), 512):
                out: list[tuple] = []
                for name, ids in zip(names[a : a + 512], encode([t or "" for t in texts[a : a + 512]])):
                    whole = len(ids) - len(ids) % window
                    for start in range(0, whole, window):
                        out.append((name, start, window, ids[start : start + window].tobytes(), len(ids), sequence, 0))
                        sequence += 1
                    if whole < len(ids):
                        tokens[number] = (name, ids[whole:].copy(), whole)
                        if full := packer.place(number, whole, len(ids) - whole):
                            rows_of(full, out)
                        number += 1
                if out:
                    yield batch_of(out)
        for pieces in packer.rest():
            out = []
            rows_of(pieces, out)
            yield batch_of(out)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents with their token ids (little-endian unsigned 32-bit) and places in windows."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    columns = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(_pack_batches(window, path, ("id", "text")), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir)))
