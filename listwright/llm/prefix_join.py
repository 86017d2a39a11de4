"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct n-grams of words (with fewer words, the whole sequence).  Equal
word sequences form a class.  All sets are in one global order: n-grams that are rare in the
corpus come first.  How frequent they are is told by a table of BUCKETS counters, in which an n-gram
counts under its hash; the table's size is fixed, and any such function of the n-gram gives a valid order.

Two linked sets share an n-gram within the first n - ceil(t * n) + 1 of each, the prefix, and the
smaller one has it within a still shorter part.  Classes with a common prefix n-gram form a cell.  Of
cells with the same classes one stays.  Within a task, a cell's sets are a prefix tree: sets that
begin alike share a path, and what each other set has in common with the path is counted once for
all of them.  A set leaves a subtree as soon as the common n-grams, and what is left of it and of the longest
set below, can't make a link with the shortest one any more; so cells are searched wholly without looking at pairs.

Before texts travel to a cell, its classes are looked at by small signatures: parities of hashed n-grams in about
as many bits as there are n-grams.  Bits that differ are n-grams that only one set holds, so they bound what two sets have
in common; a class stays in a cell only if the bound leaves it a link.  No link is lost by it.

Cells are searched twice.  First the classes of each cell meet the cell's smallest class (its hub), in
blocks; most links are of classes with a hub or in a block with it.  Then only cells with classes of several components are
left; big components get blocks of their own, and blocks meet unless they are of one component.  A
block gives at most as many links as it has classes.  Every link at or above the threshold is found, or
connects classes that other links connect already.

N-grams are 64-bit hashes, of which the join compares 56 bits and the frequency.  Nulls and texts without words have empty sets and link
with nothing.  Rows that repeat an id are rows of their own; a null id takes part, and is never the smallest.
Long texts are taken whole.  An empty table gives no rows.  Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.components import components
from listwright.llm.frames import batches_of, documents, erase, written
from listwright.llm.near import shingle_sets
from listwright.llm.words import as_bytes

SIZE, PERCENT = 5, 80
#: Counters of the frequency table; steps of its logarithm that the order tells apart.
BUCKETS, STEPS, BLOCK_OF_BUCKETS = 1 << 20, 4, 1 << 10
BLOCK_OF_BITS = 1 << 12  # bytes
#: Classes of a block, and n-grams of its classes together.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Hashes of ids, as rows, and of n-grams, as bits, by which what joins nothing is sorted out before it moves.
SLOTS, BITS = 1 << 20, 1 << 24
#: N-grams of a path that are counted at once.
CHUNK = 64
#: Rows of texts or sets that a task's Python side holds at once, and texts whose copies it knows.
BATCH, KNOWN = 1000, 100000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.uint64((1 << 56) - 1)


def _name(text: bytes) -> bytes:
    """Of a class: the digest of its words."""
    return hashlib.md5(b" ".join(text.translate(_LOWER).split())).digest()


def _count_batches(size: int) -> Callable:
    """Rows with class and size, and at the end of a task its frequency table in blocks."""
    names = ["id", "node", "n", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = as_bytes(batch["text"])
            node, n = [], []
            for t, s in zip(texts, shingle_sets(texts, size)):
                node.append(_name(t) if len(s) else None)
                n.append(len(s))
                np.add.at(counts, s & np.uint64(BUCKETS - 1), 1)
            none = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(node, pa.binary()), pa.array(n, pa.int64()), *none], names=names)
        yield _blocks(counts, names)

    return run


def _blocks(counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    rows = counts.reshape(-1, BLOCK_OF_BUCKETS)
    some = np.flatnonzero(rows.any(1))
    none = pa.nulls(len(some), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.nulls(len(some), pa.binary()), none, pa.array(some), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=names)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    steps_ = [np.minimum(STEPS * np.log2(c + 1), 127).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(steps_, pa.binary())], names=["block", "steps"])


def _frequencies(counted: DataFrame, parts: int) -> np.ndarray:
    """The table, one byte a counter: how often n-grams under it occur, in steps of a logarithm."""
    blocks = counted.filter("block is not null").select("block", "counts").repartition(parts, "block")
    rank = np.zeros(BUCKETS, np.uint8).reshape(-1, BLOCK_OF_BUCKETS)
    for r in blocks.mapInArrow(_sum_blocks, "block long, steps binary").collect():  # BUCKETS bytes together
        rank[r.block] = np.frombuffer(r.steps, np.uint8)
    return rank.reshape(-1)


def _ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in global order: frequency above the hash."""
    out = (rank[grams & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(56)) | (grams & _BITS)
    out.sort()
    return out


def _signature(grams: np.ndarray) -> bytes:
    """Parities of the hashes in 64 bits or more, a power of two that isn't smaller than the set."""
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount(((grams >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _prefix_batches(size: int, percent: int, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            texts = as_bytes(batch["text"])
            node, grams, signature = [], [], []
            names = [_name(t) for t in texts]
            new = [i for i, x in enumerate(names) if x not in known and not known.add(x)]
            for i, s in zip(new, shingle_sets([texts[i] for i in new], size)):
                if len(s):
                    node.append(names[i])
                    grams.append(_ordered(s, rank)[: len(s) + percent * -len(s) // 100 + 1].astype(np.int64))
                    signature.append(_signature(s))
            if len(known) > KNOWN:
                known = set()
            columns = [pa.array(node, pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "grams", "signature"])

    return run


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's n-grams, in blocks."""
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[np.asarray(batch["token"]) & (BITS - 1)] = True
    rows = np.packbits(bits).reshape(-1, BLOCK_OF_BITS)
    some = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["block", "bits"])


def _any_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch["block"].to_pylist(), batch["bits"].to_pylist()):
            total[block] = total.get(block, 0) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([b.tobytes() for b in total.values()], pa.binary())], names=["block", "bits"])


def _bits_of(tokens: DataFrame, parts: int) -> np.ndarray:
    """Which of BITS hashes the tokens have: BITS / 8 bytes, however many tokens there are."""
    blocks = tokens.select("token").mapInArrow(_bit_batches, "block long, bits binary").repartition(parts, "block")
    out = np.zeros(BITS // 8, np.uint8).reshape(-1, BLOCK_OF_BITS)
    for r in blocks.mapInArrow(_any_bits, "block long, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _member_batches(bits: np.ndarray) -> Callable:
    """Each class with those of its prefix n-grams whose bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.asarray(batch["grams"].flatten())
            at = tokens & (BITS - 1)
            found = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7))) & 1)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch["grams"].value_lengths()))[found])
            yield pa.RecordBatch.from_arrays([batch["num"].take(owner), batch["n"].take(owner), pa.array(tokens[found])], names=["num", "n", "token"])

    return run


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Signatures as ones of fewer words."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _possible(n: np.ndarray, signatures: list[bytes], side: np.ndarray, root: np.ndarray, percent: int) -> np.ndarray:
    """Which classes of a cell may have a link to one of another component there, as far as signatures tell."""
    order = np.argsort(n, kind="stable")
    n, side, root = n[order], side[order], root[order]
    words = [np.frombuffer(signatures[i], np.uint64) for i in order]
    width = np.array([len(w) for w in words])
    starts = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1]])).tolist()
    levels = [(a, b, np.stack(words[a:b])) for a, b in zip(starts, [*starts[1:], len(n)])]
    last = np.searchsorted(percent * n, 100 * n, "right")  # how far sizes are near enough
    keep = np.zeros(len(n), bool)
    for at, (a, b, own) in enumerate(levels):
        further = [(x, y, _folded(rows, own.shape[1])) for x, y, rows in levels[at + 1 :] if x < last[b - 1]]
        for i in range(a, b):
            for x, y, rows in [(a, b, own), *further]:
                lo, hi = max(x, i + 1), min(y, last[i])
                if lo >= hi:
                    continue
                differ = np.bitwise_count(rows[lo - x : hi - x] ^ own[i - a]).sum(1, dtype=np.int64)
                both = n[lo:hi] + n[i]
                fit = ((100 + percent) * (both - differ) >= 2 * percent * both) & (root[lo:hi] != root[i]) & ((side[lo:hi] != side[i]) | (side[i] < 0))
                if fit.any():
                    keep[i] = True
                    keep[lo:hi] |= fit
    out = np.zeros(len(n), bool)
    out[order[keep]] = True
    return out


class _Tree:
    """Sets as a prefix tree, and the links that a walk through it finds."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, percent: int):
        self.n = np.array([len(s) for s in sets])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.width = len(values)
        self.first = np.cumsum(self.n) - self.n
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.places = owner * self.width + codes  # rising
        order = np.argsort(codes, kind="stable")
        self.holders = owner[order]  # of each code, the sets that hold it
        self.holder_ends = np.cumsum(np.bincount(codes, minlength=self.width))
        self.codes = np.split(codes, self.first[1:])
        keys = [c.astype(">u4").tobytes() for c in self.codes]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        self.rank = np.argsort(self.order)
        self.shared = np.zeros(len(sets), np.int64)  # of each set in order, the length of the path that it shares with the one before
        for k in range(1, len(sets)):
            a, b = self.codes[self.order[k - 1]], self.codes[self.order[k]]
            both = min(len(a), len(b))
            differs = np.flatnonzero(a[:both] != b[:both])
            self.shared[k] = differs[0] if len(differs) else both
        self.side, self.root, self.percent = side, root.copy(), percent

    def _common(self, path: np.ndarray) -> np.ndarray:
        """How many of the path's n-grams each set holds."""
        ends = self.holder_ends[path]
        sizes = ends - np.where(path > 0, self.holder_ends[path - 1], 0)
        at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.holders[at], minlength=len(self.n))

    def links(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        t, everyone = self.percent, np.ones(len(self.n), bool)
        stack = [(0, len(self.n), 0, np.zeros(len(self.n), np.int64), everyone)]
        while stack:
            lo, hi, depth, common, alive = stack.pop()
            below = self.order[lo:hi]
            first, sizes = below[0], self.n[below]
            shortest, longest = sizes.min(), sizes.max()
            alive = alive & (self.rank > lo) & (t * self.n <= 100 * longest) & (t * shortest <= 100 * self.n)
            if (self.root[below] == self.root[first]).all():
                alive &= self.root != self.root[first]
            if hi - lo == 1:
                alive &= (self.side != self.side[first]) | (self.side < 0)
            end = self.n[first] if hi - lo == 1 else self.shared[lo + 1 : hi].min()
            path, step = self.codes[first], max(CHUNK, int(longest) // 8)
            common = common.copy()
            for a in range(depth, end, step):
                if not alive.any():
                    break
                b = min(a + step, end)
                common += self._common(path[a:b])
                who = np.flatnonzero(alive)
                seen = np.searchsorted(self.places, who * self.width + path[b - 1], "right") - self.first[who]
                most = common[who] + np.minimum(longest - b, self.n[who] - seen)
                alive[who] = (100 + t) * most >= t * (self.n[who] + shortest)
            if not alive.any():
                continue
            if hi - lo == 1:
                for i in np.flatnonzero(alive & ((100 + t) * common >= t * (self.n + self.n[first]))):
                    if self.root[i] != self.root[first]:
                        out.append((int(first), int(i)))
                        self.root[self.root == self.root[i]] = self.root[first]
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)), hi]
            stack.extend((a, b, end, common, alive) for a, b in zip(cuts[-2::-1], cuts[:0:-1]))
        return out


def _link_cells(rows: pa.Table, size: int, percent: int, rank: np.ndarray) -> pa.RecordBatch | None:
    """Links of whole cells; rows are sorted by cell."""
    texts = as_bytes(rows["text"].combine_chunks())
    own = np.array([_name(t) == x for t, x in zip(texts, rows["node"].to_pylist())])  # not another text under the same id
    first: dict[int, int] = {}
    for i, x in enumerate(rows["num"].to_pylist()):
        if own[i]:
            first.setdefault(x, i)
    sets = dict(zip(first, (_ordered(s, rank) for s in shingle_sets([texts[i] for i in first.values()], size))))
    cell, num, side, root = (np.asarray(rows[c])[own] for c in ("cell", "num", "side", "root"))
    if not len(cell):
        return None
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    left, right = [], []
    for a, b in zip(heads, np.append(heads[1:], len(cell))):
        if (root[a:b] == root[a]).all():
            continue
        found = _Tree([sets[x] for x in num[a:b].tolist()], side[a:b], root[a:b], percent).links()
        left.extend(int(num[a + i]) for i, _ in found)
        right.extend(int(num[a + j]) for _, j in found)
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]) if left else None


def _possible_cells(rows: pa.Table, percent: int) -> pa.RecordBatch | None:
    """The rows of whole cells that may be part of a link."""
    cell, n, side, root = (np.asarray(rows[c]) for c in ("cell", "n", "side", "root"))
    signatures = rows["signature"].to_pylist()
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    keep = [_possible(n[a:b], signatures[a:b], side[a:b], root[a:b], percent) for a, b in zip(heads, np.append(heads[1:], len(cell)))]
    found = rows.filter(pa.array(np.concatenate(keep))).select(CELL.replace(" long", "").replace(" int", "").split(", ")).combine_chunks().to_batches()
    return found[0] if found else None


def _by_cells(of: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """Batches come sorted by cell; the last cell of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch["cell"][-1]
            if held and held[-1]["cell"][-1] == last and batch["cell"][0] == last:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch])
            other = np.flatnonzero(np.asarray(whole["cell"]) != last.as_py())
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut and (out := of(whole.slice(0, cut))) is not None:
                yield out
            held = whole.slice(cut).to_batches()
        if held and (out := of(pa.Table.from_batches(held))) is not None:
            yield out

    return run


CELL = "cell long, side int, num long, root long"


def _sieved(rows: DataFrame, key: str, wanted: DataFrame, own: str) -> DataFrame:
    """rows without most of those whose key isn't wanted: keys count by SLOTS hashes, so what is broadcast has at most SLOTS rows."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")
    slots = wanted.select(slot(own)).distinct()
    return rows.withColumn("slot", slot(key)).join(F.broadcast(slots), "slot", "left_semi").drop("slot")


def _searched(cells: DataFrame, signatures: DataFrame, classes: DataFrame, texts: DataFrame, parts: int, percent: int, links: Callable) -> DataFrame:
    """Links of cells (cell, side, num, root).  Texts travel, which are smaller than their sets, and only those of classes that may have links."""
    sort = lambda rows: rows.repartition(parts, "cell").sortWithinPartitions("cell")
    signed = cells.join(signatures, "num").select("cell", "side", "num", "root", "n", "signature")
    possible = sort(signed).mapInArrow(_by_cells(lambda rows: _possible_cells(rows, percent)), CELL)
    possible = written(possible.join(classes.select("num", "node", "least"), "num"), "cells")
    whole = _sieved(texts, "id", possible, "least").join(possible, F.col("id").eqNullSafe(F.col("least"))).select("cell", "side", "num", "root", "node", "text")
    found = written(sort(whole).mapInArrow(_by_cells(links), "a long, b long").filter("a <> b"), "links")
    erase(possible)
    return found


def _parts(members: Column, grams: Column) -> Column:
    return F.ceil(F.greatest(members / BLOCK, grams / BLOCK_GRAMS)).cast("long")


def _hub_cells(members: DataFrame) -> DataFrame:
    """Each class with the hubs of its cells, in blocks of bounded size; the hub is in each block."""
    pairs = members.filter("num <> hub").select("hub", "num", "n").distinct()
    blocks = pairs.groupBy("hub").agg(_parts(F.count("*"), F.sum("n")).alias("blocks"))
    placed = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("num"), "blocks").alias("block"), "num")
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("num"))
    return placed.unionByName(hubs).select(F.xxhash64("hub", "block").alias("cell"), F.lit(-1).alias("side"), "num", F.col("num").alias("root"))


def _open_cells(placed: DataFrame) -> DataFrame:
    """Of (token, num, n, root): the cells of several components, as blocks that meet.

    Components that fill a block have blocks of their own, which needn't meet each other; the rest share blocks.
    """
    roots = placed.groupBy("token", "root").agg(F.count("*").alias("m"), F.sum("n").alias("g"))
    mixed = roots.groupBy("token").agg(F.count("*").alias("roots")).filter("roots > 1").select("token")
    roots = roots.join(mixed, "token").withColumn("own", (F.col("m") >= BLOCK) | (F.col("g") >= BLOCK_GRAMS))
    rest = roots.filter("not own").groupBy("token").agg(_parts(F.sum("m"), F.sum("g")).alias("shared"))
    roots = roots.join(rest, "token", "left").withColumn("big", F.when(F.col("own"), F.col("root")).otherwise(F.lit(-1).cast("long")))
    roots = roots.withColumn("of", F.when(F.col("own"), _parts(F.col("m"), F.col("g"))).otherwise(F.col("shared")))
    key = F.when(F.col("big") < 0, F.xxhash64("root")).otherwise(F.xxhash64("num"))
    rows = placed.join(roots.select("token", "root", "big", "of"), ["token", "root"])
    rows = written(rows.select("token", "num", "root", F.struct("big", F.pmod(key, "of").alias("sub")).alias("block")), "open")
    blocks = rows.select("token", "block").distinct()
    meet = blocks.join(blocks.select("token", F.col("block").alias("other")), "token").filter("block <= other and (block.big <> other.big or block.big < 0)")
    cell = F.xxhash64("token", "block.big", "block.sub", "other.big", "other.sub").alias("cell")
    low = rows.join(meet, ["token", "block"]).select(cell, F.when(F.col("block") == F.col("other"), -1).otherwise(0).alias("side"), "num", "root")
    swapped = meet.filter("block <> other").select("token", F.col("block").alias("first"), F.col("other").alias("block"))
    cell = F.xxhash64("token", "first.big", "first.sub", "block.big", "block.sub").alias("cell")
    high = rows.join(swapped, ["token", "block"]).select(cell, F.lit(1).alias("side"), "num", "root")
    return low.unionByName(high)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, node, n, component) for each row; node: its class (null: empty set), component: smallest id reachable by links."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with batches_of(spark, BATCH):
        counted = written(texts.mapInArrow(_count_batches(size), "id long, node binary, n long, block long, counts binary"), "counted")
        rows = counted.filter("block is null").select("id", "node", "n")
        rank = _frequencies(counted, parts)
        classes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"))
        classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "classes")
        prefixes = texts.mapInArrow(_prefix_batches(size, percent, rank), "node binary, grams array<long>, signature binary").dropDuplicates(["node"])
        prefixes = written(prefixes.join(classes.select("node", "num", "n"), "node").select("num", "n", "signature", "grams"), "prefixes")

        # Cells: prefix n-grams of several classes, with one at least for which a set that isn't smaller may come.
        each = prefixes.select("num", "n", F.posexplode("grams").alias("pos", "token"))
        least = F.ceil(2 * percent * F.col("n") / (100 + percent))
        facts = each.groupBy("token").agg(
            F.count("*").alias("m"), F.max(F.col("pos") <= F.col("n") - least).alias("early"), F.min("num").alias("hub"), F.bit_xor(F.xxhash64("num")).alias("mark"),
        )
        cells = facts.filter("m > 1 and early").groupBy("hub", "m", "mark").agg(F.min("token").alias("token")).select("token", "hub")
        cells = written(cells, "tokens")
        shared = prefixes.select("num", "n", "grams").mapInArrow(_member_batches(_bits_of(cells, parts)), "num long, n long, token long")
        members = written(shared.join(cells, "token"), "members")

        search = lambda cells: _searched(cells, prefixes.select("num", "n", "signature"), classes, texts, parts, percent, lambda rows: _link_cells(rows, size, percent, rank))
        links = search(_hub_cells(members))
        roots = components(links)
        placed = members.join(roots.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
        rest = search(_open_cells(placed.select("token", "num", "n", "root")))
        last, roots = roots, components(links.unionByName(rest))
        found = classes.join(roots.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
        smallest = found.groupBy("root").agg(F.min("least").alias("component"))
        by_node = written(found.join(smallest, "root").select("node", "component"), "by-node")
    erase(classes, prefixes, cells, members, links, rest, last, roots)
    return rows.join(by_node, "node", "left").withColumn("component", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")))


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP12_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from d
), x as (
  select doc_id, len(s) as n, hash(unnest(s)) as h from s
), links as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.h = b.h and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach as (
  select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
)
select doc_id, len(s)::bigint as n_shingles, component_id from s join least on doc_id = a
"""
