"""Removal of long passages that occur more than once, by recompression.

1. Every text is parsed into the symbols of listwright.llm.recompress.  Each
   window of `window` words picks one symbol whose context lies inside it, a
   function of its words alone, so that equal windows pick equal symbols at equal
   distances.  A window without such a symbol (inside a long run) picks its own hash.
2. A count by symbol (combined before the shuffle) finds the shared symbols.
   Windows that picked one are the candidates; all other windows are unique.
3. Candidates are verified by the hash of all their words among those of the same
   symbol.  Symbols that occur more than HOT times are dealt out by the hashes of
   their windows, and windows that meet in a batch are settled before the shuffle, so
   no symbol is one task's work.
4. Words covered by a verified window go.

Two windows are taken for equal if their symbols and the hashes of all their words agree, 64 bits
each.  Windows of different words meet in a comparison only where they share a symbol, which only
texts with words in common do; their hashes then agree by chance once in 2**64 comparisons.

Nulls count as texts without words.  Rows with equal id and text count as
repetitions of each other, as do two places in one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm import recompress
from listwright.llm.frames import documents, hidden, restored, written
from listwright.llm.words import SPACES, as_bytes, byte_table, mix, noise, steps, tokenize

WINDOW = 35
#: Levels of symbols among which windows pick, longest first.
LEVELS = (6, 5, 4)
#: Occurrences from which a symbol is dealt out by window.
HOT = 4096

_SEP, _TO = byte_table(SPACES, lower=False)


def _window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A hash of every `window` consecutive hashes."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k, m in enumerate(noise(window, 3) | np.uint64(1)):
            total += words[k : k + n] * m
    return mix(total)


def _picks(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a step: symbol, first and last window start (in the step), and occurrences of each pick."""
    n = len(words)
    lengths = np.diff(first)
    real = np.zeros(n, bool)  # whether a window starts at a word
    for a, b in zip(first[:-1][lengths >= window], first[1:][lengths >= window]):
        real[a : b - window + 1] = True
    edge = np.zeros(n, bool)
    edge[first[:-1][lengths > 0]] = True
    (level, edge), kept = recompress.named_runs(recompress.word_level(words), edge), {}
    for r in range(1, max(LEVELS) + 1):
        level, edge = recompress.next_level(level, r, edge)
        kept[r] = level
    best = np.full(n, -1, np.int64)
    open_, names, base = real.copy(), [], 0
    for r in LEVELS:
        x = kept[r]
        count = x.low - (x.high - window) + 1
        fit = np.flatnonzero((count > 0) & (x.high - x.low <= window))
        fit = fit[np.argsort(x.name[fit], kind="stable")[::-1]]  # the smallest name, then the first place, is written last and stays
        begin, count = x.high[fit] - window, count[fit]
        count = count + np.minimum(begin, 0)
        begin = np.maximum(begin, 0)
        fit, begin, count = fit[count > 0], begin[count > 0], count[count > 0]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        pick = np.full(n, -1, np.int64)
        pick[at] = np.repeat(fit, count)
        new = open_ & (pick >= 0)
        best[new] = pick[new] + base
        open_ &= ~new
        names.append(x.name)
        base += len(x.name)
    at = np.flatnonzero(best >= 0)
    symbol, begin = np.unique(best[at], return_index=True)
    last = len(at) - 1 - np.unique(best[at][::-1], return_index=True)[1]
    out = [(np.concatenate(names)[symbol], at[begin], at[last], np.ones(len(symbol), np.int64))]
    if open_.any():  # runs of one window are one pick that counts for each
        own = _window_hashes(words, window)
        at = np.flatnonzero(open_)
        head = np.concatenate([[True], (own[at[1:]] != own[at[:-1]]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(head)
        count = np.diff(np.concatenate([begin, [len(at)]]))
        out.append((own[at[begin]] ^ np.uint64(0x5BD1E995), at[begin], at[begin] + count - 1, count))
    return tuple(np.concatenate(x) for x in zip(*out))


PICKS = "symbol long, k1 long, k2 long, begin int, last int, n long"


def _pick_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for a, b in steps(texts):
                words = tokenize(texts[a:b], _SEP, _TO)
                if len(words.start) < window:
                    continue
                symbol, begin, last, n = _picks(words.hashes(), words.first, window)
                doc = np.searchsorted(words.first, begin, side="right") - 1
                origin = words.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (symbol.view(np.int64), k1[a + doc], k2[a + doc], (begin - origin).astype(np.int32), (last - origin).astype(np.int32), n)],
                    names=["symbol", "k1", "k2", "begin", "last", "n"],
                )

    return run


CANDIDATES = "symbol long, salt int, k1 long, k2 long, begin int, hashes binary"


def _candidate_batches(window: int, text: str):
    """Windows to verify, for texts with their shared picks.  salt -1: begin and hashes hold a settled window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, picks = as_bytes(batch[text]), batch["picks"].to_pylist()
            k1, k2 = batch["k1"].to_pylist(), batch["k2"].to_pylist()
            rows: list[tuple] = []
            hot: list[tuple[np.ndarray, ...]] = []
            for a, b in steps(texts):
                words = tokenize(texts[a:b], _SEP, _TO)
                all_hashes = words.hashes()
                for i in range(a, b):
                    own = _window_hashes(all_hashes[words.first[i - a] : words.first[i - a + 1]], window)
                    for p in picks[i]:
                        part = own[p["begin"] : p["last"] + 1]
                        if p["total"] <= HOT:
                            rows.append((p["symbol"], 0, k1[i], k2[i], p["begin"], part.tobytes()))
                        else:
                            m = len(part)
                            hot.append((np.full(m, p["symbol"]), np.full(m, p["total"]), np.full(m, i), np.arange(p["begin"], p["begin"] + m), part))
            if hot:
                symbol, total, doc, at, part = (np.concatenate(x) for x in zip(*hot))
                _, where, count = np.unique(part ^ symbol.view(np.uint64), return_inverse=True, return_counts=True)
                _, one = np.unique(where, return_index=True)
                salt = (part % (total // HOT + 1).astype(np.uint64)).astype(np.int64)
                rows.extend((int(symbol[j]), int(salt[j]), k1[doc[j]], k2[doc[j]], int(at[j]), part[j].tobytes()) for j in one)
                rows.extend((k2[doc[j]], -1, k1[doc[j]], k2[doc[j]], int(at[j]), b"") for j in np.flatnonzero(count[where] > 1))
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["symbol", "salt", "k1", "k2", "begin", "hashes"])

    return run


REPEATS = "k1 long, k2 long, begin int, flags binary"


def _settle(table: pa.Table) -> pa.RecordBatch | None:
    """Repeated windows among whole groups of (symbol, salt)."""
    settled = np.asarray(table["salt"]) == -1
    hashes = table["hashes"].to_pylist()
    sizes = np.fromiter((len(h) // 8 for h in hashes), np.int64, len(hashes))
    part = np.frombuffer(b"".join(hashes), np.uint64)
    symbol = np.repeat(np.asarray(table["symbol"]).view(np.uint64), sizes)
    with np.errstate(over="ignore"):
        order = np.lexsort((part, symbol))
    same = (part[order][1:] == part[order][:-1]) & (symbol[order][1:] == symbol[order][:-1])
    repeated = np.zeros(len(part), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    ends = np.cumsum(sizes)
    any_ = np.zeros(len(sizes), bool)
    np.logical_or.at(any_, np.repeat(np.arange(len(sizes)), sizes), repeated)
    rows = np.flatnonzero(any_ | settled)
    if not len(rows):
        return None
    flags = [b"\x01" if settled[i] else repeated[ends[i] - sizes[i] : ends[i]].tobytes() for i in rows]
    few = table.take(pa.array(rows)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(few[c].combine_chunks() if isinstance(few[c], pa.ChunkedArray) else few[c] for c in ("k1", "k2", "begin")), pa.array(flags, pa.binary())], names=["k1", "k2", "begin", "flags"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by (symbol, salt); a group that a batch cuts is held until it is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, salt = np.asarray(batch["symbol"]), np.asarray(batch["salt"])
        change = np.flatnonzero((symbol[1:] != symbol[:-1]) | (salt[1:] != salt[:-1])) + 1
        if held and (np.asarray(held[-1]["symbol"])[-1] != symbol[0] or np.asarray(held[-1]["salt"])[-1] != salt[0]):
            change = np.concatenate([[0], change])
        if not len(change):
            held.append(batch)
            continue
        cut = int(change[-1])
        if (out := _settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))) is not None:
            yield out
        held = [batch.slice(cut)]
    if held and (out := _settle(pa.Table.from_batches(held))) is not None:
        yield out


def _cut_batches(window: int, text: str):
    """Texts with their repeated windows become kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeats = as_bytes(batch[text]), batch["repeats"].to_pylist()
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in repeats[i] or ():
                    at = r["begin"] + np.flatnonzero(np.frombuffer(r["flags"], bool))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                stay = np.cumsum(gone[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(words[j] for j in np.flatnonzero(stay)) if n_removed[-1] else b" ".join(words))
            names = [c for c in batch.schema.names if c not in ("k1", "k2", "repeats")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept: the words outside all repeated windows, joined by one space.

    Words are runs of bytes other than space and \\t to \\r.  Rows stay, also those with no word left.
    """
    keyed, names = hidden(docs)
    new = {n: c for c, n in names.items()}
    ident, text = F.col(new[id_col]), new[text_col]
    keyed = keyed.withColumns({"k1": F.coalesce(ident.cast("long"), F.lit(0)), "k2": F.xxhash64(ident, F.col(text))})
    picks = written(keyed.select("k1", "k2", F.col(text).alias("text")).mapInArrow(_pick_batches(window), PICKS), "picks")
    # Written, so that the join below reads plain shuffles on both sides, of which Spark splits the large partitions.
    shared = written(picks.groupBy("symbol").agg(F.sum("n").alias("total")).filter("total > 1"), "shared")
    shared_picks = picks.join(shared, "symbol").groupBy("k1", "k2").agg(F.collect_set(F.struct("symbol", "begin", "last", "total")).alias("picks"))
    candidates = keyed.join(shared_picks, ["k1", "k2"]).mapInArrow(_candidate_batches(window, text), CANDIDATES)
    repeats = candidates.repartition("symbol", "salt").sortWithinPartitions("symbol", "salt").mapInArrow(_verify, REPEATS)
    by_text = repeats.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "flags")).alias("repeats"))
    schema = ", ".join(f"{c} {t}" for c, t in keyed.drop("k1", "k2").dtypes)
    out = keyed.join(by_text, ["k1", "k2"], "left").mapInArrow(_cut_batches(window, text), f"{schema}, n_words long, n_removed long, kept string")
    return restored(out, names, n_words="n_words", n_removed="n_removed", kept="kept")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
with d as (
  select row_number() over () as row_id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), words as (
  select row_id, unnest(w) as word, generate_subscripts(w, 1) as i from d
), windows as (
  select row_id, i, case when i + 34 <= len(w) then md5(array_to_string(w[i : i + 34], ' ')) end as h
  from d, lateral (select unnest(range(1, len(w) + 1)) as i)
), repeated as (
  select h from windows where h is not null group by h having count(*) > 1
), marked as (
  select w.row_id, w.i, max(case when r.h is not null then 1 else 0 end) over (partition by w.row_id order by w.i rows between 34 preceding and current row) as gone
  from windows w left join repeated r on w.h = r.h
), kept as (
  select m.row_id, sum(gone) as n_removed, coalesce(string_agg(word, ' ' order by m.i) filter (gone = 0), '') as kept
  from marked m join words x on m.row_id = x.row_id and m.i = x.i group by m.row_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept on d.row_id = kept.row_id
"""
