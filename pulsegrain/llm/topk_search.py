"""Exact top-k inner-product search by the threshold algorithm.

The candidates are dealt into blocks; each block keeps, for every dimension, its vectors sorted by
that component, made once; queries stream past it. For a query the lists are read from their good ends in parallel; each newly met
vector gets its full score, and reading stops when the bound, the score of a vector made of the
last components read, is below the k-th best score. A task holds one block of candidates and a batch
of queries, so no side is ever held whole. The best k of all blocks are then ranked for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

K = 20
SCALE = 64
#: Vectors of a block of candidates (in expectation).
CANDIDATES = 8192
FIRST_DEPTH = 64


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component; unusable vectors are left out.

    Unusable are null vectors and those that hold a null, NaN or infinite component.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def threshold_search(matrix: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the best k rows of matrix for a query, without the row `own`.

    order[d] lists the rows by component d, the smallest first. Ties go to the smaller id.
    """
    n = len(matrix)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = ids == own
    left = n - int(seen.sum())
    best = np.empty(0, dtype=np.int64)
    scores = np.empty(0, dtype=query.dtype)
    at, depth = 0, FIRST_DEPTH
    while left:
        to = min(n, at + depth)
        if len(up) + len(down):
            met = np.concatenate([order[up, n - to : n - at].ravel(), order[down, at:to].ravel()])
        else:  # every score is 0, so the order of reading does not matter
            met = np.arange(at, to)
        new = np.zeros(n, dtype=bool)
        new[met] = True
        new &= ~seen
        seen |= new
        fresh = np.flatnonzero(new)
        left -= len(fresh)
        best, scores = np.concatenate([best, fresh]), np.concatenate([scores, matrix[fresh] @ query])
        if len(best) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= kth
            best, scores = best[near], scores[near]
            rank = np.lexsort((ids[best], -scores))[:k]
            best, scores = best[rank], scores[rank]
        if len(best) == k and to < n:
            bound = matrix[order[up, n - to], up] @ query[up] + matrix[order[down, to - 1], down] @ query[down]
            if bound < scores.min():
                break
        at, depth = to, depth * 2
    rank = np.lexsort((ids[best], -scores))
    return best[rank], scores[rank]


class Block:
    """Candidates of one length with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.whole = np.stack(vectors).astype(np.int64).reshape(len(vectors), -1)
        self.largest = int(np.abs(self.whole.astype(object)).max()) if self.whole.size else 0
        self.matrix = self.whole.astype(float)
        self.order = np.argsort(self.whole, axis=0, kind="stable").T.copy()

    def search(self, query_id: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # doubles hold whole numbers below 2**53; larger scores are summed as 64-bit whole numbers
        bound = len(v) * self.largest * max(map(abs, map(int, v)), default=0)
        if bound >= 1 << 63:
            raise OverflowError(f"scores of query {query_id} may not fit into 64 bits")
        exact = bound >= 1 << 53
        at, scores = threshold_search(self.whole if exact else self.matrix, self.ids, self.order, np.asarray(v, dtype=np.int64 if exact else float), query_id, k)
        return self.ids[at], scores.astype(np.int64)


def _search(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows come by block, candidates before queries."""
    at, waiting, blocks = None, [], None
    for frame in frames:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for (block, asks), part in frame.groupby(["block", "asks"], sort=True):
            if block != at:
                at, waiting, blocks = block, [], None
            if not asks:
                waiting += zip(part["id"].tolist(), part["v"], strict=True)
                continue
            if blocks is None:
                by_length: dict[int, list] = {}
                for i, v in waiting:
                    by_length.setdefault(len(v), []).append((i, v))
                blocks = {n: Block(np.array([i for i, _ in rows], dtype=np.int64), [v for _, v in rows]) for n, rows in by_length.items()}
                waiting = []
            for query_id, v in zip(part["id"].tolist(), part["v"], strict=True):
                if len(v) in blocks:
                    ids, scores = blocks[len(v)].search(query_id, v, k)
                    out["query_id"].append(np.full(len(ids), query_id))
                    out["vec_id"].append(ids)
                    out["score"].append(scores)
        yield pd.DataFrame({c: np.concatenate(x) if x else np.empty(0, dtype=np.int64) for c, x in out.items()})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    Queries are the rows whose id fulfils is_query (a condition on the column "id"); candidates
    are all rows but the query's own id. Scores are inner products of quantized vectors, exact
    within 64 bits; one that may lie beyond is an error. Ties go to the smaller id. Rows with a null id or an unusable
    vector take no part; a vector of another length is no candidate. A repeated candidate counts as
    often as it occurs; a repeated query asks once, with each of its different vectors its results
    are ranked together. Fewer candidates than k are all returned; an empty table gives none.
    """
    usable = cut_lineage(quantized(vectors, id_col, vector_col, scale).filter(F.col("id").isNotNull()))
    asked = usable.filter(is_query).distinct()
    blocks = max(1, -(-usable.count() // candidates))
    own = usable.select("id", "v", F.pmod(F.xxhash64("id", F.lit(blocks)), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    every = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    dealt = own.unionByName(every).repartition("block").sortWithinPartitions("block", "asks")
    found = dealt.mapInPandas(lambda frames: _search(frames, k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH d AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM d q JOIN d c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
