"""Exact top-k by inner product, with elimination by a table of pivot distances.

Vectors get one coordinate more, so that all candidates have the largest norm M and a
higher inner product is a smaller distance.  Each vector's distances to the pivots are a table,
written once; by the triangle inequality, the largest difference between the query's and a
candidate's bounds their distance from below.  Candidates are evaluated in the order of
that bound until it shows that no other can enter the best k.

Queries and candidates meet in blocks: every block of queries with every block of
candidates, each pair a task of bounded size.  Pivots come from a bounded sample
(SAMPLE rows with the smallest hashes), which affects only how much is evaluated.

Vectors that are null, or hold null or non-finite components, and rows without an id take
no part; components that a shorter vector lacks count as 0.  Rows with the query's id are its own;
of other ids, repeated rows are candidates each.  An empty table, or one without queries, gives no
rows.  Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listwright.llm.frames import written

K, EVERY, SCALE = 20, 20, 64
PIVOTS, SAMPLE = 32, 2000
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 1024, 8192, 256
#: What the table's single precision can make a difference of distances too large, in shares of the largest norm.
ROUNDED = 1e-6


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) with v the whole numbers floor(SCALE * x), of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    fine = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows that lie far from each other."""
    chosen = [int((sample**2).sum(1).argmax())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if vectors.map(len).eq(width).all():
        return np.stack(vectors.to_list()).astype(float)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _distances(vectors: pd.Series, pivots: np.ndarray, norm2: float, candidates: bool) -> np.ndarray:
    """Distances to the pivots, which are candidates, of candidates or of queries, with the added coordinate."""
    x = _matrix(vectors, pivots.shape[1])
    more = lambda m: np.sqrt(np.maximum(norm2 - (m**2).sum(1), 0))  # noqa: E731  the added coordinate; queries have 0
    own = np.full(len(x), norm2) if candidates else (x**2).sum(1)
    between = x @ pivots.T + (np.outer(more(x), more(pivots)) if candidates else 0)
    return np.sqrt(np.maximum(own[:, None] + norm2 - 2 * between, 0))


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, width: int, norm2: float, k: int) -> Iterator[pd.DataFrame]:
    candidates = candidates.sort_values("id")
    x, ids = _matrix(candidates.v, width), candidates.id.to_numpy()
    q, names = _matrix(queries.v, width), queries.id.to_numpy()
    to_x, to_q = (np.stack(c.to_list()).astype(float) if len(c) else np.zeros((0, 1)) for c in (candidates.to, queries.to))
    to_x = np.ascontiguousarray(to_x.T)
    for i in range(len(q)):
        gap = np.maximum(np.abs(to_x - to_q[i][:, None]).max(0) - ROUNDED * np.sqrt(norm2), 0)
        bound = (float(q[i] @ q[i]) + norm2 - gap**2) / 2  # of the inner product, from above
        bound[ids == names[i]] = -np.inf
        head = np.argpartition(-bound, STEP)[:STEP] if len(bound) > STEP else np.arange(len(bound))
        at = head[bound[head] > -np.inf]
        score = x[at] @ q[i]
        top = np.lexsort((ids[at], -score))[:k]
        score, at = score[top], at[top]
        enough = lambda: score[-1] - 1e-6 * (1 + norm2) if len(score) == k else -np.inf
        bound[head] = -np.inf
        order = np.flatnonzero((bound >= enough()) & (bound > -np.inf))  # what the first step leaves open
        order = order[np.argsort(-bound[order])]
        a, step = 0, STEP
        while a < len(order) and bound[order[a]] >= enough():
            part = order[a : a + step]
            more_ = x[part] @ q[i]
            a, step = a + step, 2 * step
            if len(score) == k:
                part, more_ = part[more_ >= score[-1]], more_[more_ >= score[-1]]
            score, at = np.concatenate([score, more_]), np.concatenate([at, part])
            top = np.lexsort((ids[at], -score))[:k]
            score, at = score[top], at[top]
        yield pd.DataFrame({"query_id": names[i], "vec_id": ids[at], "score": np.rint(score).astype(np.int64)})


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner products, ties to smaller ids."""
    x, q = whole_vectors(rows, id_col, vector_col), whole_vectors(queries, id_col, vector_col)
    facts = x.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("norm2"), F.max(F.size("v")).alias("width")).first()
    n_queries = q.count()
    width = facts.width or 0
    if not width or not n_queries:
        return q.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).filter("false")
    sample = x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    pivots, norm2 = choose_pivots(_matrix(sample.v, width), PIVOTS), float(facts.norm2)
    blocks = [-(-n // size) for n, size in ((n_queries, QUERY_BLOCK), (facts.n, CANDIDATE_BLOCK))]

    def table(vectors: DataFrame, candidates: bool) -> DataFrame:
        @F.pandas_udf("array<float>")
        def distances(v: pd.Series) -> pd.Series:
            return pd.Series(list(_distances(v, pivots, norm2, candidates)), dtype=object)

        return written(vectors.withColumn("to", distances("v")), "pivot-table")

    x, q = table(x, True), table(q, False)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = q.select(own(blocks[0]).alias("qb"), every(blocks[1]).alias("cb"), F.lit(True).alias("query"), "id", "v", "to")
    cells = cells.unionByName(x.select(every(blocks[0]).alias("qb"), own(blocks[1]).alias("cb"), F.lit(False).alias("query"), "id", "v", "to"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        out = list(_best(group[group["query"]], group[~group["query"]], width, norm2, k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = cells.groupBy("qb", "cb").applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % EVERY == 0))


OP10_SQL = """
with x as (
  select vec_id, list_transform(embedding, lambda e: floor(64 * e::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from x q join x c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
