"""Language identification by unigram models over pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary.  A word
(a run of letters in lower case, with a mark for its start) has the probability that a
forward pass sums over all its segmentations into pieces; a text that of its words.
Expectation-maximisation fits the probabilities on a bounded sample of labelled rows:
at most SAMPLE rows for each language, those with the smallest hashes of id and text.
What reaches the driver is one number for each piece and language.

A text that is null or has no letter is `und` with score 0; without labelled rows all
texts are.  Rows without a label or without an id are scored like all others, repeated rows are rows
of their own, an empty table gives an empty one, columns of docs keep their names (`lang_pred` and
`score` are replaced), texts and words have any length.  The model holds a column of numbers for each
label: a table whose labels aren't languages has to be cleaned first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored, written
from listwright.llm.words import mix, noise

VOCABULARY = "piece_bpe_32k.model"
#: Labelled rows of a language from which its model is fitted; rounds of fitting; weight of the smoothing.
SAMPLE, ROUNDS, SMOOTH = 1000, 3, 0.05
#: Words a task remembers; characters of words that are scored at once (a longer word is scored alone).
REMEMBERED, SCORED = 400_000, 1 << 16
#: Probability of a character that is no piece, alike for all languages.
UNKNOWN = 1e-7
UND = "und"

_WORD = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary as sorted hashes by length, to look up all substrings of many words at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.names = sorted(names)
        self.longest = max(map(len, self.names), default=1)
        self.weights = noise(self.longest, 21) | np.uint64(1)
        by_length: list[list[tuple[int, int]]] = [[] for _ in range(self.longest + 1)]
        for i, n in enumerate(self.names):
            for k, h in self._hashes(np.array([ord(c) for c in n], np.uint64)):
                if k == len(n):
                    by_length[k].append((int(h[0]), i))
        self.table = []
        for rows in by_length:
            rows.sort()
            self.table.append((np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)))

    def _hashes(self, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length k, the hashes of all k characters in a row."""
        total = np.zeros(len(chars), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, min(self.longest, len(chars)) + 1):
                total = total[: len(chars) - k + 1] + chars[k - 1 :] * self.weights[k - 1]
                yield k, mix(total + np.uint64(k))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(starts, ends, [piece of length k at each character or -1]) over the joined words, each with its start mark."""
        text = "".join("▁" + w for w in words)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        left = np.repeat(ends, ends - starts) - np.arange(len(chars))  # characters up to the word's end
        found = [np.full(len(chars), -1, np.int32) for _ in range(self.longest + 1)]
        for k, h in self._hashes(chars):
            hashes, index = self.table[k]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found[k][: len(h)] = np.where((hashes[at] == h) & (left[: len(h)] >= k), index[at], -1)
        return starts, ends, found


def _by_length(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Words of equal length together, so that a pass takes a step for all of them."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cut):
        if len(group):
            yield int(length[group[0]]), group


def _steps(found: list[np.ndarray], k: int, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray | None]:
    """(which words, probabilities for all languages) of the pieces of length k at characters `at`; a character that is no piece is unknown."""
    piece = found[k][at]
    if k == 1:
        return slice(None), p[piece] + (UNKNOWN * (piece < 0))[:, None]  # the last row of p, for -1, is 0
    which = np.flatnonzero(piece >= 0)
    return which, p[piece[which]] if len(which) else None


def score_words(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language; p: pieces and a row of zeros, by language."""
    starts, ends, found = pieces.lattice(words)
    out = np.zeros((len(words), p.shape[1]))
    for n, group in _by_length(starts, ends):
        alpha, scale = [np.ones((len(group), p.shape[1]))], np.zeros((len(group), p.shape[1]))
        for i in range(1, n + 1):
            total = np.zeros_like(alpha[0])
            for k in range(1, min(i, pieces.longest) + 1):
                which, chance = _steps(found, k, starts[group] + i - k, p)
                if chance is not None:
                    total[which] += alpha[-k][which] * chance
            alpha.append(total)
            alpha = alpha[-pieces.longest :]
            if i % 16 == 0:  # long words: keep the numbers in range
                top = alpha[-1].copy()
                alpha = [a / top for a in alpha]
                scale += np.log(top)
        out[group] = np.log(alpha[-1]) + scale
    return out


def _parts(words: list[str]) -> Iterator[list[str]]:
    """The words in order, in parts of about SCORED characters."""
    part, held = [], 0
    for w in words:
        if part and held + len(w) > SCORED:
            yield part
            part, held = [], 0
        part.append(w)
        held += len(w)
    if part:
        yield part


def expected_counts(pieces: Pieces, p: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in the words, under the probabilities of one language."""
    total = np.zeros(len(p))
    starts, ends, found = pieces.lattice(words)
    p, longest = p[:, None], pieces.longest

    def rescale(values: dict[int, np.ndarray], scale: dict[int, np.ndarray], at: int, window: range) -> None:
        top = np.maximum(values[at], 1e-300)
        for j in window:
            values[j], scale[j] = values[j] / top, scale[j] + np.log(top)

    for n, group in _by_length(starts, ends):
        at = starts[group]
        none = np.zeros((len(group), 1))
        alpha, up = {0: np.ones((len(group), 1))}, {0: none}
        for i in range(1, n + 1):
            alpha[i] = np.zeros_like(none)
            for k in range(1, min(i, longest) + 1):
                which, chance = _steps(found, k, at + i - k, p)
                if chance is not None:
                    alpha[i][which] += alpha[i - k][which] * chance
            up[i] = up[i - 1]
            if i % 16 == 0:  # long words: keep the numbers in range; what is still needed has one scale
                rescale(alpha, up, i, range(max(0, i + 1 - longest), i + 1))
        beta, down = {n: np.ones((len(group), 1))}, {n: none}
        for i in range(n - 1, -1, -1):
            beta[i] = np.zeros_like(none)
            for k in range(1, min(n - i, longest) + 1):
                which, chance = _steps(found, k, at + i, p)
                if chance is not None:
                    beta[i][which] += beta[i + k][which] * chance
            down[i] = down[i + 1]
            if (n - i) % 16 == 0:
                rescale(beta, down, i, range(i, min(n, i + longest - 1) + 1))
        share = weight[group][:, None] / np.maximum(alpha[n], 1e-300)
        for i in range(n):
            for k in range(1, min(n - i, longest) + 1):
                which, chance = _steps(found, k, at + i, p)
                if chance is not None:
                    value = (alpha[i] * beta[i + k] * np.exp(up[i] + down[i + k] - up[n]) * share)[which] * chance
                    np.add.at(total, found[k][at + i][which], value[:, 0])
    total[-1] = 0
    return total


class Model:
    """Languages, and the probability of each piece in each."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray):
        self.path, self.languages, self.p = path, languages, p


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str | None = None) -> Model:
    """docs: the rows to learn from."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    size = len(Pieces(path).names)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(2**31)).alias("h")).filter("lang is not null and text is not null")
    # Hashes below a bound that leaves about twice the sample of each language; the sample is then exact.
    bounds = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg((2**31 * 2.0 * SAMPLE / F.count("*")).alias("bound"))
    # One row for each language, of which the driver holds a column of the model anyway: broadcast, so that texts beyond the bound aren't shuffled.
    rows = rows.join(F.broadcast(bounds), "lang").filter("h < bound").drop("bound")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= SAMPLE).select("lang", "text")

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lang, texts in rows.groupby("lang").text:
                seen = Counter(w for t in texts for w in _WORD.findall(t.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})

    words = written(rows.mapInPandas(words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    p = np.full((size + 1, len(languages)), 1 / max(size, 1))
    p[-1] = 0
    number = {x: i for i, x in enumerate(languages)}
    for _ in range(ROUNDS if languages else 0):
        now = p

        def count(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            pieces, total = Pieces(path), np.zeros_like(now)
            for rows in batches:
                for lang, part in rows.groupby("lang"):
                    j = number[lang]
                    for a in range(0, len(part), 4096):
                        total[:, j] += expected_counts(pieces, now[:, j], part.word.tolist()[a : a + 4096], part.n.to_numpy(float)[a : a + 4096])
            at = np.argwhere(total > 0)
            yield pd.DataFrame({"piece": at[:, 0], "language": at[:, 1], "n": total[at[:, 0], at[:, 1]]})

        counts = words.mapInPandas(count, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(p)
        total[counts.piece, counts.language] = counts.n
        mean = total.sum(1, keepdims=True) / max(total.sum(), 1)
        p = (1 - SMOOTH) * total / np.maximum(total.sum(0, keepdims=True), 1) + SMOOTH * mean + 1e-9
        p[-1] = 0
    return Model(path, languages, p)


def _predict_batches(model, text: str):
    """model: a broadcast Model, whose size the vocabulary and the number of languages bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        pieces = Pieces(m.path)
        known: dict[str, int] = {}
        values = np.zeros((0, len(m.languages)))
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for a in range(0, len(batch), 256):
                split = [_WORD.findall(t.lower()) if t else [] for t in batch[text].slice(a, 256).to_pylist()]
                if len(known) > REMEMBERED:
                    known, values = {}, values[:0]
                if new := list(dict.fromkeys(w for words in split for w in words if w not in known)):
                    known.update(zip(new, range(len(values), len(values) + len(new))))
                    values = np.concatenate([values, *(score_words(pieces, m.p, part) for part in _parts(new))])
                for words in split:
                    if not m.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
                        langs.append(UND)
                        scores.append(0.0)
                        continue
                    total = values[[known[w] for w in words]].sum(0)
                    best = int(total.argmax())
                    langs.append(m.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of the language."""
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = rows.mapInArrow(_predict_batches(shared, text), f"{schema}, lang_pred string, score double")
    return restored(out, names, lang_pred="lang_pred", score="score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
