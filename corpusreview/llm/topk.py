"""Exact top-k inner products by columnar branch and bound."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusreview.llm import common

K = 10
SCALE = 1024
#: Queries that are broadcast at a time, rows that are searched at a time, dimensions that are added at a time.
QUERY_BLOCK = 1024
ROW_BLOCK = 16384
DIM_BLOCK = 16
_EXACT = float(2**52)
_LONG = 2**63 - 1


def _whole(values: list[float]) -> list[int]:
    return [math.floor(v * SCALE) if abs(v) < 1e15 else int(v) * SCALE for v in values]


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Scaled whole components, dimensions x vectors (vertical layout), cut or filled with 0 to ``dims``.

    Floats while every sum of products stays exact in them, else Python integers.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = dim < dims
    row, dim, flat = row[keep], dim[keep], flat[keep]
    large = len(flat) and float(np.abs(flat).max()) * SCALE + 1 > math.sqrt(_EXACT / max(dims, 1))
    out = np.zeros((dims, len(vectors)), dtype=object if large else np.float64)
    out[dim, row] = _whole(flat.tolist()) if large else np.floor(flat * SCALE)
    return out


class Search:
    """The best rows so far of a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int = K):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = [(np.zeros(0, dtype=queries.dtype), np.zeros(0, dtype=np.int64)) for _ in ids]
        dims = queries.shape[0]
        self.blocks = [slice(d, min(d + DIM_BLOCK, dims)) for d in range(0, dims, DIM_BLOCK)]
        mass = np.array([(queries[b].astype(float) ** 2).sum(axis=0) for b in self.blocks]).reshape(len(self.blocks), len(ids))
        self.order = np.argsort(-mass, axis=0, kind="stable")
        self.mass = mass

    def _merge(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.best[at]
        scores, ids = np.concatenate([old_scores, scores]), np.concatenate([old_ids, ids])
        if scores.dtype == object:
            best = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        else:
            best = np.lexsort((ids, -scores))[: self.k]
        self.best[at] = (scores[best], ids[best])

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Search a block of rows.

        Distances are added one block of dimensions at a time, the blocks with most of the query's mass first.  What the
        remaining dimensions can add is bounded by the product of the remaining norms; rows that cannot reach the k-th best
        score any more leave the candidate list, which stays compact.
        """
        if not len(ids):
            return
        norms = np.array([(rows[b].astype(float) ** 2).sum(axis=0) for b in self.blocks]).reshape(len(self.blocks), len(ids))
        total = norms.sum(axis=0)
        for at, own in enumerate(self.ids):
            live = np.flatnonzero(ids != own)
            scores = np.zeros(len(live), dtype=np.result_type(rows, self.queries))
            rest, left = total[live], float(self.mass[:, at].sum())
            for step, b in enumerate(self.order[:, at]):
                query = self.queries[self.blocks[b], at]
                scores = scores + query @ rows[self.blocks[b]][:, live]
                rest = np.maximum(rest - norms[b][live], 0.0)
                left = max(left - float(self.mass[b, at]), 0.0)
                if step == 0 and len(live) > 4 * self.k and len(self.best[at][0]) < self.k:
                    # no threshold yet: the rows that lead after the first block are scored in full
                    lead = live[np.argpartition(-scores.astype(float), self.k)[: self.k]]
                    self._merge(at, self.queries[:, at] @ rows[:, lead], ids[lead])
                    keep = ~np.isin(live, lead)
                    live, scores, rest = live[keep], scores[keep], rest[keep]
                if len(self.best[at][0]) == self.k:
                    reach = scores.astype(float) + np.sqrt(rest * left) * (1 + 1e-9) + 1e-6
                    floor = float(self.best[at][0][-1])
                    keep = reach * (1 + 1e-12 * np.sign(reach)) >= floor - abs(floor) * 1e-12
                    live, scores, rest = live[keep], scores[keep], rest[keep]
                    if not len(live):
                        break
            self._merge(at, scores, ids[live])


def _valid(column: str) -> F.Column:
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(column).isNotNull() & F.forall(column, fits)


def top_products(queries: DataFrame, rows: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product for every query.

    ``queries`` and ``rows`` have ``vec_id`` and ``embedding``.  Queries are taken in blocks of about ``query_block``, each of
    which is broadcast to a scan of all rows; every task keeps the best ``k`` of its rows per query, and a ranking joins
    them.  Null ids, null vectors and vectors with null or non-finite components take no part.  Vectors of other lengths
    count as filled up with zeros.  Rows with the query's id are its own.  A repeated row is ranked as often as it occurs; of
    several queries with one id the smallest vector counts.  Scores outside the range of a long become
    its end and tie.
    """
    asked = (
        queries.filter(F.col("vec_id").isNotNull() & _valid("embedding"))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    blocks = max(1, math.ceil(asked.count() / query_block))
    found = None
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").toArrow()
        part = _search(block, rows, k)
        found = part if found is None else found.unionAll(part)
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _search(block: pa.Table, rows: DataFrame, k: int) -> DataFrame:
    vectors = block.column("embedding").combine_chunks()
    ids = block.column("vec_id").to_numpy().astype(np.int64)
    dims = int(vectors.value_lengths().to_numpy(zero_copy_only=False).max()) if len(ids) else 0
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix(vectors, dims)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, k=k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                piece = batch.slice(start, ROW_BLOCK)
                search.add(piece.column("vec_id").to_numpy().astype(np.int64), matrix(piece.column("embedding"), dims))
        sizes = [len(best) for best, _ in search.best]
        if sum(sizes):
            scores = [max(-_LONG - 1, min(_LONG, int(s))) for best, _ in search.best for s in best]
            yield pa.record_batch(
                {
                    "query_id": pa.array(np.repeat(search.ids, sizes)),
                    "vec_id": pa.array(np.concatenate([i for _, i in search.best])),
                    "score": pa.array(scores, pa.int64()),
                }
            )

    usable = rows.filter(F.col("vec_id").isNotNull() & _valid("embedding"))
    return usable.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every vector whose id is divisible by 100, against all others."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.e, r.e)])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
