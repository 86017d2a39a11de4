"""Near-duplicate documents by SetSketch registers, bands and exact confirmation.

A document's set holds its distinct shingles of `size` words (with fewer words,
the whole sequence).  Equal word sequences form a class.  Each class has a sketch:
register i is the minimum over the set of an exponentially distributed hash,
truncated to the exponentially spaced values b**-k, so that sketches of parts can
be merged by maximum and two sketches agree the more, the more similar the sets.

Classes that agree in all registers of a band share a bucket.  All pairs of a bucket
are candidates, but they aren't formed as rows.  First a hub of each bucket (the class with
the most company) meets the others, which joins most classes into components.  Then buckets
with classes of several components are searched in blocks, inside the tasks: a pair is looked
at in the first band that it shares, its similarity is estimated by likelihood from both
sketches and sizes, and if it comes near the threshold and the two aren't connected yet, it is
confirmed on full sets.  A block gives at most as many links as it has classes.

A pair at the threshold 0.75 shares no bucket with a probability of about
(1 - 0.75**4)**40 = 3e-7; there are no other losses.

Nulls and texts without words have empty sets and link with nothing.  Rows that
repeat an id are rows of their own.  A null id takes part; it is never the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from listwright.llm.components import components
from listwright.llm.frames import batches_of, documents, erase, written
from listwright.llm.words import SPACES, as_bytes, byte_table, mix, noise, steps, tokenize

SHINGLE, PERCENT = 5, 75
#: Registers: BANDS bands of ROWS registers; their base and largest value.
BANDS, ROWS, BASE, LARGEST = 40, 4, 1.001, 65534
REGISTERS = BANDS * ROWS
#: Candidates whose estimate lies this far below the threshold (more than five standard errors) aren't confirmed.
SLACK = 0.18
LIKELY = PERCENT / 100 - SLACK
#: Classes in a block of the search, and shingles of its classes together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Cells that are looked at together with others of their size, and pairs that one vectorised step handles.
SMALL, PAIRS = 64, 16384
#: Rows of texts, sets or sketches that a task's Python side holds at once.
BATCH = 1000

_SEP, _TO = byte_table(SPACES, lower=True)
_LOWER = bytes(_TO.tolist())
_XOR = (noise(REGISTERS, 11) >> np.uint64(32)).astype(np.uint32)
_MUL = (noise(REGISTERS, 12) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    m = noise(size + 1, 5) | np.uint64(1)
    for a, b in steps(texts):
        words = tokenize(texts[a:b], _SEP, _TO)
        h = words.hashes()
        with np.errstate(over="ignore"):
            for i in range(b - a):
                w = h[words.first[i] : words.first[i + 1]]
                n = len(w) - size + 1
                if not len(w):
                    yield w
                elif n < 1:
                    total = np.uint64(len(w)) * m[size]
                    for k, x in enumerate(w):
                        total += x * m[k]
                    yield mix(np.array([total], np.uint64))
                else:
                    total = w[:n] * m[0]
                    for k in range(1, size):
                        total = total + w[k : k + n] * m[k]
                    yield np.unique(mix(total))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a nonempty set of 64-bit hashes."""
    h = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 1024):
        part = h[a : a + 1024, None] ^ _XOR
        part *= _MUL
        np.minimum(least, part.min(0), out=least)
    rate = -np.log1p(-(least + 0.5) / 2**32)  # the exponential variate of which the minimum is kept
    return np.clip(np.floor(20 - np.log(rate) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def _chance(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that a register is larger by a share x of the elements, and its slope."""
    y = x * (BASE - 1) / BASE
    return np.clip(-np.log1p(-y) / np.log(BASE), 1e-9, 1), (BASE - 1) / BASE / (1 - y) / np.log(BASE)


def reaches(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray, least: float) -> np.ndarray:
    """Whether the Jaccard similarity that makes both sketches likeliest is `least` or more; rows of registers, and set sizes.

    The likelihood of a pair's larger, smaller and equal registers has one maximum, so its slope at
    `least` tells on which side the maximum lies.  Sizes too different for `least` never reach it.
    """
    more, less = (first > second).sum(1), (first < second).sum(1)
    same = REGISTERS - more - less
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    fit = np.minimum(u, v) > least * np.maximum(u, v)
    (p, dp), (q, dq) = _chance(np.where(fit, u - v * least, 0.5)), _chance(np.where(fit, v - u * least, 0.5))
    slope = same * (v * dp + u * dq) / np.clip(1 - p - q, 1e-9, 1) - more * v * dp / p - less * u * dq / q
    return fit & (slope >= 0)


SKETCHES = "id long, h long, node binary, n long, sketch binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch["text"])
        node, n, sketch = [], [], []
        for t, s in zip(texts, shingle_sets(texts)):
            n.append(len(s))
            node.append(hashlib.md5(b" ".join(t.translate(_LOWER).split())).digest() if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())], names=["id", "h", "node", "n", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(as_bytes(batch["text"]))]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "set"])


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = [hashlib.md5(w).digest() if (w := b" ".join(t.translate(_LOWER).split())) else None for t in as_bytes(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(node, pa.binary()), batch["text"]], names=["id", "node", "text"])


@F.pandas_udf(BooleanType())
def _likely(s1: pd.Series, s2: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    if not len(s1):
        return pd.Series([], dtype=bool)
    first, second = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (s1, s2))
    return pd.Series(reaches(first, second, n1.to_numpy(float), n2.to_numpy(float), LIKELY))


@F.pandas_udf(BooleanType())
def _confirmed(s1: pd.Series, s2: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(s1, s2):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([a, b])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= PERCENT * (len(a) + len(b) - common))
    return pd.Series(out, dtype=bool)


class _Cells:
    """Rows of whole cells (a cell: a block of a bucket, or two), and the pairs that they have to look at."""

    def __init__(self, rows: pa.Table):
        cell = np.stack([np.asarray(rows[c], np.int64) for c in ("bucket", "low", "high")])
        self.head = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(0)]))
        self.size = np.diff(np.append(self.head, rows.num_rows))
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.bands = self.sketch.view(np.uint64)  # a band of four registers is one number
        self.band = np.asarray(rows["band"])
        self.n, self.side, self.two = np.asarray(rows["n"], float), np.asarray(rows["side"]), cell[1] != cell[2]
        self.root = np.unique(np.array(rows["root"].to_pylist(), "S16"), return_inverse=True)[1]

    def likely(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of one cell, in different components, that share no earlier band and that may be links; by the first row."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for g in np.unique(self.size[self.size <= SMALL]):  # small cells of one size at once
            i, j = np.triu_indices(g, 1)
            heads = self.head[self.size == g]
            step = max(1, PAIRS // max(1, len(i)))
            for a in range(0, len(heads), step):
                at = heads[a : a + step, None]
                left, right = (at + i).ravel(), (at + j).ravel()
                fit = self._fit(left, right)
                left, right = left[fit], right[fit]
                first = (self.bands[left] == self.bands[right]).argmax(1) == self.band[left]
                found.append(self._reaching(left[first], right[first]))
        for h, g in zip(self.head[self.size > SMALL], self.size[self.size > SMALL]):
            right = np.arange(h, h + g)
            step = max(1, PAIRS // g)
            for a in range(h, h + g, step):
                left = np.arange(a, min(a + step, h + g))[:, None]
                fit = self._fit(left, right) & (left < right)
                for k in range(self.band[h]):
                    fit &= self.bands[left, k] != self.bands[right, k]
                i, j = np.nonzero(fit)
                found.append(self._reaching(a + i, h + j))
        left, right = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(left, kind="stable")
        return left[order], right[order]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        few, many = np.minimum(self.n[left], self.n[right]), np.maximum(self.n[left], self.n[right])
        return (self.root[left] != self.root[right]) & (~self.two[left] | (self.side[left] != self.side[right])) & (100 * few >= PERCENT * many)

    def _reaching(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = [np.empty(0, bool)]
        for a in range(0, len(left), PAIRS):
            i, j = left[a : a + PAIRS], right[a : a + PAIRS]
            keep.append(reaches(self.sketch[i], self.sketch[j], self.n[i], self.n[j], LIKELY))
        keep = np.concatenate(keep)
        return left[keep], right[keep]


def _likely_rows(rows: pa.Table) -> pa.RecordBatch | None:
    """The rows that are part of a likely pair."""
    keep = np.unique(np.concatenate(_Cells(rows).likely()))
    return rows.take(pa.array(keep)).combine_chunks().to_batches()[0] if len(keep) else None


def _links(rows: pa.Table) -> pa.RecordBatch | None:
    """Confirmed links that connect different components."""
    cells = _Cells(rows)
    left, right = cells.likely()
    if not len(left):
        return None
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    ends = np.cumsum([len(x) for x in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    code, root = np.split(codes, ends[:-1]), cells.root
    mine = np.zeros(len(values), bool)
    out: list[tuple[int, int]] = []
    heads = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    for a, b in zip(heads, np.append(heads[1:], len(left))):
        i = int(left[a])
        others = right[a:b][root[right[a:b]] != root[i]]
        if not len(others):
            continue
        mine[code[i]] = True
        lengths = np.array([len(code[j]) for j in others])
        common = np.add.reduceat(mine[np.concatenate([code[j] for j in others])], np.cumsum(lengths) - lengths, dtype=np.int64)
        mine[code[i]] = False
        for j in others[100 * common >= PERCENT * (len(code[i]) + lengths - common)]:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    if not out:
        return None
    node = rows["node"].combine_chunks()
    first, second = zip(*out)
    return pa.RecordBatch.from_arrays([node.take(pa.array(first)), node.take(pa.array(second))], names=["a", "b"])


def _by_cells(of):
    """Batches come sorted by cell; the last cell of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks()
            cell = np.stack([np.asarray(whole[c], np.int64) for c in ("bucket", "low", "high")])
            other = np.flatnonzero((cell != cell[:, -1:]).any(0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut and (out := of(whole.slice(0, cut).combine_chunks())) is not None:
                yield out
            held = whole.slice(cut).to_batches()
        if held and (out := of(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


CELLS = "bucket long, low int, high int, side int, band int, node binary, root binary, n long, sketch binary"
_CELL = ["bucket", "low", "high"]


def _sets_of(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of classes, from the text of the row that stands for each."""
    chosen = nodes.join(classes.select("node", F.col("least").alias("id")), "node")
    named = texts.mapInArrow(_node_batches, "id long, node binary, text string")
    text = named.join(chosen, (named.node == chosen.node) & named.id.eqNullSafe(chosen.id), "left_semi").select("node", "text")
    return written(text.dropDuplicates(["node"]).mapInArrow(_set_batches, "node binary, set binary"), "sets")


def _cells_of(open_: DataFrame, parts: int) -> DataFrame:
    """Blocks of open buckets, and pairs of blocks, whole and sorted within partitions.

    A bucket has as many blocks as its classes and their shingles need, so that no cell outgrows a task.
    """
    facts = open_.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    cells = open_.join(facts.select("bucket", blocks.alias("blocks")), "bucket").select("*", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    cells = cells.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side, "band", "node", "root", "n", "sketch")
    return cells.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, node, n, component) for each row; h: hash of the text, node: its class (null: empty set), component: smallest id reachable."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with batches_of(spark, BATCH):
        rows = written(texts.withColumn("h", F.xxhash64("text")).mapInArrow(_sketch_batches, SKETCHES), "sketches")
        classes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        classes = written(classes, "classes")
        width = 2 * ROWS
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))).alias("bucket")))
        banded = classes.select("node", F.explode(bands).alias("b")).select("node", "b.*")
        several = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
        buckets = written(banded.join(several, "bucket"), "buckets")
        sketches = classes.select("node", "n", "sketch")

        # Hubs: of each bucket, the class with the largest buckets.
        company = buckets.join(buckets.groupBy("node").agg(F.sum("size").alias("company")), "node")
        hubs = company.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
        pairs = buckets.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        s = [sketches.toDF(x, f"n{x}", f"s{x}") for x in "ab"]
        pairs = written(pairs.join(s[0], "a").join(s[1], "b").filter(_likely("sa", "sb", "na", "nb")).select("a", "b"), "pairs")
        sets = _sets_of(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        x, y = (sets.toDF(k, f"set_{k}") for k in "ab")
        links = written(pairs.join(x, "a").join(y, "b").filter(_confirmed("set_a", "set_b")).select("a", "b"), "links")
        roots = components(links)

        # The rest: pairs of different components.
        placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("bucket")
        cells = _cells_of(placed.join(mixed, "bucket").join(sketches, "node"), parts)
        likely = written(cells.mapInArrow(_by_cells(_likely_rows), CELLS), "likely")
        more = _sets_of(texts, classes, likely.select("node").distinct().join(sets.select("node"), "node", "left_anti"))
        whole = likely.join(sets.unionByName(more), "node").select(*likely.columns, "set")
        rest = written(whole.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_by_cells(_links), "a binary, b binary"), "links")
        last, roots = roots, components(links.unionByName(rest))
        members = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = members.groupBy("root").agg(F.min("least").alias("component"))
        by_node = written(members.join(smallest, "root").select("node", "component"), "members")
    erase(classes, buckets, pairs, sets, more, links, likely, rest, last, roots)
    return rows.select("id", "h", "node", "n").join(by_node, "node", "left").withColumn("component", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")))


def is_kept() -> Column:
    return F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that a near-duplicate of smaller id stands for."""
    gone = near_duplicates(docs, id_col, text_col).filter(~is_kept()).select("id", "h").distinct()
    same = F.col(id_col).cast("long").eqNullSafe(gone["id"]) & (F.xxhash64(text_col) == gone["h"])
    return docs.join(gone, same, "left_anti")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), is_kept().alias("kept"))


OP8_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from d
), x as (
  select doc_id, len(s) as n, hash(unnest(s)) as h from s
), links as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.h = b.h and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach as (
  select doc_id as a, doc_id as b from s union select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join least on doc_id = a
"""
