"""SentencePiece encoding and decoding by suffix-array matching.

For a batch, the units of its texts (a unit: marks for spaces and what follows up to the
next space, or a run of characters between others that no longer piece holds) are
joined, each distinct unit once, and indexed by a suffix array.  Every piece is found in
it by binary search, as a range of occurrences.  The ranges become edges (place, length,
score), sorted by place; then units are relaxed along the edges: of all neighbours that an
edge joins, the highest score merges first, the leftmost of equals, until no edge joins
two neighbours.  That order is the model's own.  Characters that are no piece become bytes.

A null text is empty and has no ids; so has an empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct units whose ids a task remembers; characters of new units that are indexed together at most.
REMEMBERED, INDEXED = 200_000, 100_000
#: Texts that are encoded together.
TOGETHER = 256
#: Units of more characters are relaxed one by one, with a heap.
LONG = 64


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if m.is_control(i)}
        self.unknown = m.unk_id()
        normal = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.single = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}
        longer = [i for i in normal if len(self.pieces[i]) > 1]
        self.longest = max((len(self.pieces[i]) for i in longer), default=1)
        self.id = np.array(longer, np.int32)
        self.length = np.array([len(self.pieces[i]) for i in longer], np.int64)
        self.score = np.array([m.get_score(i) for i in longer], np.float64)
        self.key = np.array([self._key(self.pieces[i]) for i in longer], f"S{4 * self.longest}")
        self.after = np.array([self._key(self.pieces[i]) + b"\xff" * (4 * (self.longest - len(self.pieces[i]))) for i in longer], f"S{4 * self.longest}")
        inner = set("".join(self.pieces[i] for i in longer))
        self.unit = re.compile("(?:" + MARK + "+)?[" + re.escape("".join(sorted(inner - {MARK}))) + "]+|" + MARK + "+|[^" + re.escape("".join(sorted(inner))) + "]", re.S)

    @staticmethod
    def _key(text: str) -> bytes:
        return text.encode("utf-32-be")

    def split(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` characters (at least), by doubling of ranks."""
    n = len(chars)
    rank = np.unique(chars, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < depth and rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
    return order


class Encoder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self._forget()

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the piece of each length at each character, by binary search of all pieces in the suffix array."""
        v = self.v
        chars = np.frombuffer(text.encode("utf-32-be"), ">u4")
        order = suffix_array(chars.astype(np.uint32), v.longest)
        # Keys: the first characters of each suffix, in the array's order; a separator (0) ends each unit.
        wide = np.concatenate([chars, np.zeros(v.longest, ">u4")]).astype(">u4")
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, v.longest)[: len(chars)][order]).view(f"S{4 * v.longest}").ravel()
        low, high = np.searchsorted(keys, v.key, "left"), np.searchsorted(keys, v.after, "right")
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        by_place = np.lexsort((v.length[piece], at))
        at, piece = at[by_place], piece[by_place]
        score = np.full((len(chars), v.longest + 1), -np.inf)
        ids = np.full((len(chars), v.longest + 1), -1, np.int32)
        score[at, v.length[piece]] = v.score[piece]
        ids[at, v.length[piece]] = v.id[piece]
        return score, ids

    def _relax(self, unit: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the symbols left, for many short units at once; unit: the number of each character's unit, -1: separator."""
        top = self.v.longest
        start = np.flatnonzero(unit >= 0)
        length = np.ones(len(start), np.int64)
        own = unit[start]
        done_start, done_length = [], []
        while len(start):
            joined = np.minimum(length[:-1] + length[1:], top + 1)
            value = np.where((own[1:] == own[:-1]) & (joined <= top), score[start[:-1], np.minimum(joined, top)], -np.inf)
            value = np.append(value, -np.inf)
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.maximum.reduceat(value, head)
            per = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(start))))
            hit = np.flatnonzero((value == best[per]) & (best[per] > -np.inf))
            first = hit[np.concatenate([[True], per[hit][1:] != per[hit][:-1]])] if len(hit) else hit
            length[first] += length[first + 1]
            stay = np.ones(len(start), bool)
            stay[first + 1] = False
            over = best[per] == -np.inf
            done_start.append(start[over])
            done_length.append(length[over])
            stay &= ~over
            start, length, own = start[stay], length[stay], own[stay]
        start, length = np.concatenate(done_start), np.concatenate(done_length)
        order = np.argsort(start)
        return start[order], length[order]

    def _relax_long(self, a: int, b: int, score: np.ndarray) -> tuple[list[int], list[int]]:
        """The same for one unit of characters a to b."""
        end = {i: i + 1 for i in range(a, b)}
        before = {i: i - 1 for i in range(a, b)}
        top = self.v.longest
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if i >= a and j < b and end[j] - i <= top and score[i, end[j] - i] > -np.inf:
                heapq.heappush(heap, (-score[i, end[j] - i], i, j, end[j]))

        for i in range(a, b):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if end.get(i) != j or end.get(j) != e:
                continue
            end[i] = e
            del end[j]
            if e < b:
                before[e] = i
            offer(i)
            if i > a:
                offer(before[i])
        starts = sorted(end)
        return starts, [end[i] - i for i in starts]

    def learn(self, units: list[str]) -> None:
        """Encodes new units together."""
        v = self.v
        text = "\0".join(units) + "\0"
        score, ids = self.edges(text)
        ends = np.cumsum([len(u) + 1 for u in units])
        number = np.repeat(np.arange(len(units)), np.diff(ends, prepend=0))
        long = np.array([len(u) > LONG for u in units])
        number = np.where(long[number], -1, number)
        number[ends - 1] = -1
        start, length = self._relax(number, score)
        id_of = np.where(length > 1, ids[start, length], -1)
        alone = np.flatnonzero(length == 1)
        chars = np.array(list(text))[start[alone]]
        kinds, which = np.unique(chars, return_inverse=True)
        id_of[alone] = np.array([v.single.get(c, -1) for c in kinds], np.int64)[which]
        self._remember(units, text, start, length, id_of, ends, long, score, ids)

    def _bytes(self, one: list[int], chars: list[str]) -> list[int]:
        """Ids with bytes in the place of characters that are no piece."""
        v = self.v
        return [y for x, c in zip(one, chars) for y in ([x] if x >= 0 else [v.bytes.get(b, v.unknown) for b in c.encode()])]

    def _remember(self, units: list[str], text: str, start: np.ndarray, length: np.ndarray, id_of: np.ndarray, ends: np.ndarray, long: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Appends the units' ids to the flat store."""
        cut = np.searchsorted(start, ends)
        begin = np.concatenate([[0], cut[:-1]])
        count = cut - begin
        special = long.copy()  # relaxed one by one, or with bytes
        special[np.unique(np.searchsorted(cut, np.flatnonzero(id_of < 0), "right"))] = True
        base, flat = len(self.flat), [id_of.astype(np.int32)]
        more = len(id_of)
        for k in np.flatnonzero(special):
            if long[k]:
                starts, lengths = self._relax_long(int(ends[k]) - len(units[k]) - 1, int(ends[k]) - 1, score)
                one = [int(ids[s, n]) if n > 1 else self.v.single.get(text[s], -1) for s, n in zip(starts, lengths)]
            else:
                starts, one = start[begin[k] : cut[k]].tolist(), id_of[begin[k] : cut[k]].tolist()
            one = self._bytes(one, [text[s] for s in starts])
            begin[k], count[k] = more, len(one)
            flat.append(np.array(one, np.int32))
            more += len(one)
        first = len(self.begin)
        self.flat = np.concatenate([self.flat, *flat])
        self.begin = np.concatenate([self.begin, begin + base])
        self.count = np.concatenate([self.count, count])
        self.known.update(zip(units, range(first, first + len(units))))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.v.split(t) for t in texts]
        new, size = [], 0
        for u in {u: None for units in split for u in units if u not in self.known}:
            new.append(u)
            size += len(u) + 1
            if size > INDEXED:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        unit = np.fromiter((self.known[u] for units in split for u in units), np.int64)
        count = self.count[unit]
        ends = np.cumsum(count)
        at = np.repeat(self.begin[unit] - ends + count, count) + np.arange(count.sum())
        of_text = np.cumsum([0, *map(len, split)])
        return self.flat[at], np.concatenate([[0], ends])[of_text]


class Decoder:
    def __init__(self, path: str):
        v = Vocabulary(path)
        self.parts = [b"" if i in v.silent else bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]

    def __call__(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.parts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _encode_batches(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                flat, offsets = encode([t or "" for t in part[text].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], names=[*batch.schema.names, "ids"])

    return run


def _decode_batches(path: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(path)
        for batch in batches:
            column = batch[ids]
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = [decode(flat[at[i] : at[i + 1]]) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with ids, the token ids of the text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return restored(rows.mapInArrow(_encode_batches(path, text), f"{schema}, ids array<int>"), names, ids="ids")


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """rows with decoded, the text of the ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    inner, names = hidden(rows)
    ids = next(c for c, n in names.items() if n == ids_col)
    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes)
    return restored(inner.mapInArrow(_decode_batches(path, ids), f"{schema}, decoded string"), names, decoded="decoded")


def there_and_back(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with ids and with decoded, by one process for each task: encoded parts are decoded before the next part is read."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    there, back = _encode_batches(path, text), _decode_batches(path, "ids")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return restored(rows.mapInArrow(lambda batches: back(there(batches)), f"{schema}, ids array<int>, decoded string"), names, ids="ids", decoded="decoded")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every text as a digest, and whether decoding them gives the text back."""
    coded = there_and_back(documents(spark, sf_dir).select("doc_id", "text"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    first = F.array_join(F.slice("ids", 1, 8), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), first.alias("first_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("lossless"))
