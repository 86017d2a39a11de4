"""Whitening of embeddings by block Lanczos, without forming a covariance matrix.

Components c become whole numbers x = floor(SCALE * c) + OFFSET.  The fit list holds each distinct
vector once; of it come n, the sums S and the trace of the covariance V, all exact.  The leading
eigenvectors of V come from products of V with blocks of vectors: one distributed pass over the fit
list for each block, in which every task sums the centred rows times their projections.  New blocks
are made orthogonal to the whole basis, twice.  Directions that vanish in doing so (the space that
the block spans is used up) are replaced by fresh ones, so that further eigenvectors, of repeated
values too, are found.  It ends when the residuals of all wanted eigenvectors are small, or
when the basis fills the whole space.  The basis is held on the driver: at most the square of the width.

Rows whose vector is null, or holds null or non-finite entries, or entries of 2**50 or more in size
(which have no exact place in this arithmetic), take no part.  Entries that a shorter vector lacks
count as 0.  Rows that repeat an id, and rows with a null id, are rows of their own; repeated vectors count
once in the fit.  Directions without variance aren't components: there are fewer then, and none for a
single vector or an empty table, which gives no rows.  A deviation beyond a long is null.
Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import erase, written

SCALE, OFFSET, COMPONENTS = 64, 1000000, 16
#: Residuals, and eigenvalues that count as none, in shares of the largest eigenvalue.
RESIDUAL, NOTHING = 1e-13, 1e-12
#: Norm below which a direction counts as used up, in shares of what it was.
_USED, _LARGE = 1e-10, 2.0**50
_LOW = (1 << 31) - 1


@dataclass
class Model:
    n: int
    base: np.ndarray  # whole part of the mean of x
    rest: np.ndarray  # what S is beyond n times base
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # of width x components
    identity_error: float = float("nan")

    @property
    def width(self) -> int:
        return len(self.base)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact; null beyond a long."""
        d = x - self.base
        largest = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if self.width * largest**2 < 1 << 63:
            return ((self.n * d - self.rest) ** 2).sum(1).tolist()
        total = ((self.n * d.astype(object) - self.rest.astype(object)) ** 2).sum(1)
        return [int(t) if t < 1 << 63 else None for t in total]


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part; x: an array of long, of the width of the longest."""
    fine = F.forall(vector_col, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < _LARGE))  # NaN is larger than all numbers
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * SCALE) + OFFSET)
    rows = rows.filter(F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).alias("id"), x.alias("x"))
    sizes = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if sizes[0] is None or sizes[0] == sizes[1]:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(sizes[0]) - F.size("x"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fit: DataFrame, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of of(rows), a matrix of floats: summed in tasks, then by rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(batch["x"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = fit.mapInArrow(run, "i long, v array<double>")
    rows = parts.groupBy("i").agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(shape[1]))).alias("v")).collect()
    out = np.zeros(shape)
    for r in rows:
        out[r.i] = r.v
    return out


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and S, exact: halves of the numbers are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(width, np.int64), np.zeros(width, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"], width)
                high, low, n = high + (x >> 31).sum(0), low + (x & _LOW).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], names=["i", "high", "low", "n"])

    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "n")]
    rows = sorted(fit.mapInArrow(run, "i long, high long, low long, n long").groupBy("i").agg(*total).collect())
    return int(rows[0].n), [(int(r.high) << 31) + int(r.low) for r in rows]


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """block's directions orthogonal to the basis and each other; fresh ones in place of those that vanish, while there are any."""
    width, out = len(block), basis
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(8):
            if out.shape[1] == width:
                return out[:, basis.shape[1] :]
            v = column
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > _USED * size > 0:
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            column = rng.standard_normal(width)  # breakdown: restart in a fresh direction
            size = np.linalg.norm(column)
    return out[:, basis.shape[1] :]


def lanczos(product: Callable[[np.ndarray], np.ndarray], width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix, of which only product(block) is known."""
    rng = np.random.default_rng(1)
    k = min(k, width)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    block = _orthogonal(rng.standard_normal((width, k)), basis, rng)  # as wide as k, so that up to k equal eigenvalues are found
    while True:
        basis = np.column_stack([basis, block])
        images = np.column_stack([images, product(block)])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        vectors = basis @ inner
        residual = images @ inner - vectors * values
        if basis.shape[1] == width or np.linalg.norm(residual, axis=0).max() <= RESIDUAL * max(values[0], 0):
            return values, vectors / np.linalg.norm(vectors, axis=0)
        block = _orthogonal(images[:, -block.shape[1] :], basis, rng)


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Model | None:
    """The model of (id, x); None without vectors."""
    fit_list = written(vectors.select("x").distinct(), "fit-list")
    first = fit_list.first()
    if first is None or not len(first.x):
        erase(fit_list)
        return None
    width = len(first.x)
    n, sums = _sums(fit_list, width)
    base = np.array([s // n for s in sums], np.int64)
    model = Model(n, base, np.array([s % n for s in sums], np.int64), 0.0, np.zeros(0), np.zeros((width, 0)))

    deviation = lambda x: np.array([[(model.centred(_matrix(x, width)) ** 2).sum()]])
    model.trace = float(_summed(fit_list, (1, 1), deviation)[0, 0] / n)

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: pa.Array) -> np.ndarray:
            c = model.centred(_matrix(x, width))
            return c.T @ (c @ block)

        return _summed(fit_list, block.shape, of) / n

    if model.trace > 0:
        values, vectors_ = lanczos(product, width, k)
        some = values > NOTHING * values[0]
        model.values, model.vectors = values[some], vectors_[:, some]
        m = len(model.values)

        def squares(x: pa.Array) -> np.ndarray:
            w = model.whitened(_matrix(x, width))
            return w.T @ w

        model.identity_error = float(np.abs(_summed(fit_list, (m, m), squares) / n - np.eye(m)).max())
    erase(fit_list)
    return model


def transform(vectors: DataFrame, model: Model) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    m, explained = len(model.values), model.values / model.trace
    type_ = vectors.schema["id"].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], model.width)
            each = np.repeat(np.arange(len(x)), m)
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(each))
            columns = [
                batch["id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), deviation,
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.mapInArrow(run, f"id {type_}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each row that takes part, once for each of up to k components; see transform."""
    vectors = whole_vectors(rows, id_col, vector_col)
    model = fit(vectors, k)
    if model is None or not len(model.values):
        nothing = "cast(id as {}) as id, 1 as component, 1L as n, 0L as deviation, 0D as whitened, 0D as explained, 0D as identity_error"
        return vectors.filter("false").selectExpr(*nothing.format(vectors.schema["id"].dataType.simpleString()).split(", "))
    return transform(vectors, model)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumnRenamed("id", "vec_id")
