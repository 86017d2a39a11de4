"""Pairs of similar texts inside blocks, by marks that alike texts have in common instead of comparisons of all with all.

Two texts are alike if they are equal, if one holds the other and the shorter is longer than half of
the longer, or if few edits (by length, at most EDITS) turn one into the other.  Equal texts of a block are
one class.  Different ones meet by marks, hashes of pieces of text, and a text has few of them, however long it is:

* Edits: of e + 1 chunks that stand side by side from the beginning of the shorter text on, e edits leave one, the i-th, whole, with at most i - 1
  edits before it and the rest behind: it stands in the longer text at one of few places.  The longer a text, the longer its chunks.
  Edits are counted in whole texts, or in their first characters only, where a caller asks for that.
* Inside: in a window of 2**k characters the piece of half the width whose hash is smallest depends on the window alone.  A text
  has that piece of its first window (2**k at most its length), and all windows of texts less than twice as long show it.

Both are equality joins on the hash; what they find is compared exactly, so a common hash of different pieces does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.plans.shared import kept_table

SHORTEST = 5
# Edits allowed by length and at most, characters compared, difference of lengths.
SHARE, EDITS, COMPARED, LONGER = 0.15, 6, 200, 10
#: Characters that are hashed at once.
AT_ONCE = 1 << 18
#: Whole texts up to this length are compared by Spark's levenshtein, whose work grows with the square of the length; longer ones along diagonals.
TABLED = 256
#: Kinds of marks.
CHUNK, PLACE, FIRST, ANY = range(4)
_FACTOR, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def edits(length: Column) -> Column:
    return F.least(F.lit(EDITS), F.floor(length * SHARE)).cast("int")


def alike(a: Column, b: Column) -> Column:
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((short / long_ > 0.5) & (a.contains(b) | b.contains(a))) | ((long_ - short < LONGER) & _few_edits(a, b, short))


def _few_edits(a: Column, b: Column, short: Column) -> Column:
    distance = F.levenshtein(F.substring(a, 1, COMPARED), F.substring(b, 1, COMPARED), EDITS)  # -1: more
    return distance.bitwiseAND(15) <= edits(short)  # -1 is 15 then; the distance is named, so computed, once


def few_edits(a: str, b: str, most: int) -> bool:
    """Whether at most `most` edits turn a into b: how far one gets on each diagonal with 0, 1, 2 edits, by comparing slices; few steps, however long the texts are."""
    goal, far = len(b) - len(a), {0: _shared(a, 0, b, 0)}
    for e in range(most + 1):
        if far.get(goal, -1) == len(a):
            return True
        left, reached = most - e - 1, {}
        for d in range(max(-e - 1, goal - left), min(e + 1, goal + left) + 1):
            i = min(max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1), len(a), len(b) - d)
            if i >= 0:
                reached[d] = i + _shared(a, i, b, i + d)
        far = reached
    return False


def _shared(a: str, i: int, b: str, j: int) -> int:
    """How many characters a from i on and b from j on begin with in common."""
    end, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < end and a[i + n : i + min(n + step, end)] == b[j + n : j + min(n + step, end)]:
        n, step = n + step, 2 * step
    if n >= end:
        return end
    other = min(n + step, end)  # they differ before it
    while other - n > 1:
        middle = (n + other) // 2
        if a[i + n : i + middle] == b[j + n : j + middle]:
            n = middle
        else:
            other = middle
    return n


def _bands(compared: int | None) -> Iterator[tuple[int, int, int, int]]:
    """(lowest length, highest, edits, characters of a chunk) of shorter texts, as far as they are compared; none where no edit is allowed."""
    allowed = lambda n: min(EDITS, int(n * SHARE))
    low, end = SHORTEST, compared or 1 << 31
    while low < end:
        e = allowed(low)
        # A band ends where more edits are allowed, or where chunks can be a third longer; whole prefixes are one of their own.
        until = min((e + 1) * -(-4 * (low // (e + 1)) // 3), end)
        high = next((n for n in range(low, until - 1) if allowed(n + 1) > e), until - 1) if e < EDITS else until - 1
        if e:
            yield low, high, e, low // (e + 1)
        low = high + 1
    if compared:
        yield compared, compared, allowed(compared), compared // (allowed(compared) + 1)


#: By how many characters are compared; None: whole texts.
BANDS = {compared: list(_bands(compared)) for compared in (COMPARED, None)}


def _mix(*parts) -> np.ndarray:
    """A hash of equally long arrays (or numbers) of unsigned 64 bits."""
    out = np.zeros(1, np.uint64)
    for x in parts:
        out = (out ^ np.asarray(x).astype(np.uint64)) * _FACTOR
        out = (out ^ (out >> np.uint64(29))) * _FACTOR
        out ^= out >> np.uint64(32)
    return out


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of pieces twice as wide as those of `hashes`, at each place of each row."""
    return _mix(hashes[:, :-width], hashes[:, width:])


def _lowest(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest of each `count` successive hashes of a row; count is a power of two, and one."""
    width = 1
    while 2 * width < count:
        hashes, width = np.minimum(hashes[:, :-width], hashes[:, width:]), 2 * width
    return np.minimum(hashes[:, :-1], hashes[:, 1:])


def _edit_marks(codes: np.ndarray, length: np.ndarray, block: np.ndarray, compared: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, row, mark) of texts, or of their first `compared` characters; codes: a row for each."""
    n = np.minimum(length, compared) if compared else length
    least = np.where(length >= compared + LONGER, compared, n - EDITS) if compared else n - EDITS  # shorter texts that may be alike
    met = [(*band, np.flatnonzero((n >= band[0]) & (least <= band[1]))) for band in BANDS[compared]]
    met = [(q.bit_length() - 1, q, low, high, e, longer) for low, high, e, q, longer in met if len(longer)]
    piece, width = _mix(codes), codes.shape[1]
    for j in range(1 + max((m[0] for m in met), default=-1)):
        for _, q, low, high, e, longer in (m for m in met if m[0] == j):
            size, tens, its = n[longer], length[longer] // LONGER, block[longer]
            short = size <= high
            shorter = longer[short]
            chunk = lambda rows, at: _mix(piece[rows, at], piece[rows, at + q - (1 << j)])  # noqa: B023, E731
            for i in range(e + 1):
                # Lengths are told apart by tens, so that many texts of one beginning meet only those nearly as long.
                name, above = _mix(its, low, i, tens), _mix(its, low, i, tens + 1)
                if len(shorter):
                    yield CHUNK, shorter, _mix(chunk(shorter, i * q), name[short])
                    yield CHUNK, shorter, _mix(chunk(shorter, i * q), above[short])
                # Of i edits before and e - i behind; the longer text has up to e characters more, except where both are cut.
                for shift in range(-min(i, e - i), (min(i, e - i) if low == compared else i) + 1):
                    at = i * q + shift
                    fits = at + q <= size
                    if 0 <= at <= width - q and fits.any():
                        yield PLACE, longer[fits], _mix(chunk(longer[fits], at), name[fits])
        piece = _doubled(piece, 1 << j)


def _inside_marks(codes: np.ndarray, length: np.ndarray, block: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, row, mark) of texts of 2**k characters or more and fewer than 2**(k + 1); codes: a row for each."""
    piece = _mix(codes)
    for j in range(k):
        if j >= k - 2:
            half = 1 << j
            shown = np.where(np.arange(piece.shape[1]) <= (length - half)[:, None], piece, _NONE)
            lowest = _lowest(shown, half + 1)
            row, at = np.nonzero((np.arange(lowest.shape[1]) <= (length - 2 * half)[:, None]) & np.c_[np.ones(len(lowest), bool), lowest[:, 1:] != lowest[:, :-1]])
            found = np.unique(np.rec.fromarrays([row, _mix(lowest[row, at], block[row], j)]))
            yield ANY, found["f0"], found["f1"]
            if j == k - 1:
                yield FIRST, np.arange(len(lowest)), _mix(lowest[:, 0], block, j)
        piece = _doubled(piece, 1 << j)


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for row, t in zip(out, texts):
        line = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(line)] = line
    return out


def _marks(batches: Iterator[pd.DataFrame], compared: int | None = COMPARED) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, ids, within = batch["text"].tolist(), batch["id"].to_numpy(), batch["within"].to_numpy()
        length, block = np.array([len(t) for t in texts], np.int64), within.astype(np.uint64)
        scale = np.frexp(length)[1] - 1
        for k in np.unique(scale):
            same = np.flatnonzero(scale == k)
            step = max(1, AT_ONCE >> max(int(k) + 1, 8))
            for rows in (same[i : i + step] for i in range(0, len(same), step)):
                some, n, b = [texts[i] for i in rows], length[rows], block[rows]
                codes = _codes(some, 1 << int(k) + 1)
                found = [*_edit_marks(_codes(some, compared) if compared else codes, n, b, compared), *_inside_marks(codes, n, b, int(k))]
                at = rows[np.concatenate([r for _, r, _ in found])]
                kind = np.concatenate([np.full(len(r), x, np.int8) for x, r, _ in found])
                yield pd.DataFrame({"mark": np.concatenate([m for _, _, m in found]).astype(np.int64), "kind": kind, "within": within[at], "id": ids[at], "n": length[at].astype(np.int32)})


def alike_pairs(rows: DataFrame, compared: int | None = COMPARED) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, block, text), the classes (block, text, id: the smallest) and the pairs (a, b), a < b, of alike classes of a block.

    Edits are counted in the first `compared` characters (COMPARED), or in whole texts (None).
    """
    classes = rows.filter(F.length("text") >= SHORTEST).groupBy("block", "text").agg(F.min("id").alias("id"))
    classes = kept_table(classes, "classes")
    id_type = classes.schema["id"].dataType.simpleString()
    marks = classes.select("id", "text", F.xxhash64("block").alias("within")).mapInPandas(partial(_marks, compared=compared), f"mark long, kind byte, within long, id {id_type}, n int")
    marks = kept_table(marks, "marks")
    side = lambda kind, of: marks.filter(F.col("kind") == kind).select("mark", "within", F.col("id").alias(of), F.col("n").alias(f"n{of}"))
    texts = lambda of, text: classes.select(F.xxhash64("block").alias("within"), F.col("block").alias(f"block_{of}"), F.col("id").alias(of), text.alias(f"text_{of}"))
    met = lambda one, other: side(one, "s").join(side(other, "l"), ["mark", "within"])
    near = met(CHUNK, PLACE).filter((F.col("nl") - F.col("ns") < LONGER) & ((F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("s") < F.col("l")))))
    inside = met(FIRST, ANY).filter("ns < nl and ns > 0.5 * nl")
    # What costs time is the comparison, not bytes: pairs are dealt out by number, which lasts where their texts are broadcast.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda found: found.repartition(parts, "within", "s", "l").distinct()
    near, whole = dealt(near.select("within", "s", "l", "ns")), F.col("text")
    if compared:
        searches = [(near, F.substring("text", 1, compared), _few_edits(F.col("text_s"), F.col("text_l"), F.col("ns")))]
    else:
        near, within = kept_table(near, "near"), F.udf(few_edits, "boolean", useArrow=False)
        searches = [
            (near.filter(F.col("ns") <= TABLED), whole, F.levenshtein("text_s", "text_l", EDITS).bitwiseAND(15) <= edits(F.col("ns"))),
            (near.filter(F.col("ns") > TABLED), whole, within("text_s", "text_l", edits(F.col("ns")))),
        ]
    pairs = []
    for found, text, fits in (*searches, (dealt(inside.select("within", "s", "l")), whole, F.col("text_l").contains(F.col("text_s")))):
        both = found.join(texts("s", text), ["within", "s"]).join(texts("l", text), ["within", "l"])
        pairs.append(both.filter((F.col("block_s") == F.col("block_l")) & fits).select(F.col("block_s").alias("block"), F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")))
    return classes, reduce(DataFrame.unionByName, pairs).distinct()


def groups(links: DataFrame) -> DataFrame:
    """(id, root) of all ids in links (a, b): the smallest id that links lead to.

    In turn, each id hands the smallest of its neighbours to the larger ones, and the larger ones to the smallest, until
    each link leads to its root.
    """
    now = kept_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    facts = lambda df: df.agg(F.count("*"), F.sum("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
    state = facts(now)
    while True:
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        larger = ends.filter("b > a").join(lowest, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        below = larger.groupBy("b").agg(F.min("a").alias("low"))
        handed = larger.join(below, "b").select(F.col("low"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        now = kept_table(handed.select(F.col("low").alias("a"), "b").filter("a < b").distinct(), "links")
        before, state = state, facts(now)
        if state == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
