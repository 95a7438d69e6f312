"""Exact top-k inner products by columnar branch and bound.

Candidates are held in vertical layout (one row of the block's matrix per
dimension). Scores accumulate dimension block by dimension block; after each
block a candidate's best possible score is what it has plus the product of the
remaining masses (norms over the dimensions to come) of query and candidate.
Those that can't reach the query's k-th score any more are dropped and the rest
are compacted.

Queries are taken in blocks of a fixed number of rows: a block is collected,
sent to all executors (its size is bounded by ``block`` x dimension) and held
against all candidates where they lie. Each task returns k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, materialize

by_value(__name__)

#: Dimensions accumulated between two prunings.
STEP = 16
#: Candidates per vertical block.
ROWS = 8192
#: Sums below this are exact in doubles, so blocks can be multiplied as such.
EXACT = 1 << 53


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class _Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.id: list[np.ndarray] = [np.empty(0, np.int64)] * n

    def floor(self, q: int) -> float:
        return self.score[q][-1] if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]


def _masses(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms over the dimensions from each cut on, of every vector."""
    squares = m.astype(np.float64) ** 2
    return [np.sqrt(squares[c:].sum(axis=0)) for c in cuts]


def search_block(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: _Best, at: np.ndarray) -> None:
    """Hold queries (dimension x queries) against candidates (dimension x candidates)."""
    dim = len(columns)
    most = float(np.abs(columns).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dim, 1)
    kind = np.float64 if most < EXACT else np.int64
    cols, qs = columns.astype(kind), queries.astype(kind)
    cuts = list(range(STEP, dim, STEP))
    rest, qrest = _masses(columns, cuts), _masses(queries, cuts)
    for lo in range(0, qs.shape[1], 256):
        part = qs[:, lo : lo + 256]
        first = part[:STEP].T @ cols[:STEP]  # the first dimension block of all pairs of the block
        for j in range(part.shape[1]):
            q, have = at[lo + j], first[j]
            live = np.flatnonzero(ids != query_ids[lo + j])
            have = have[live]
            for c, cut in enumerate(cuts):
                if len(live) > best.k and best.floor(q) == -np.inf:  # exact scores of the most promising give a first bound
                    try_ = live[np.argpartition(have + rest[c][live] * qrest[c][lo + j], -best.k)[-best.k :]]
                    bound = (part[:, j] @ cols[:, try_]).min()
                else:
                    bound = best.floor(q)
                reach = have + rest[c][live] * qrest[c][lo + j] * (1 + 1e-9) + 1e-6
                keep = reach >= bound
                live, have = live[keep], have[keep]
                if not len(live):
                    break
                have = have + part[cut : cut + STEP, j] @ cols[cut : cut + STEP, live]
            if len(live):
                best.add(q, have.astype(np.int64), ids[live])


def _search(batches, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """(vec_id, v) batches to (query_id, vec_id, score) rows; queries: by dimension (ids, matrix)."""
    offsets, n = {}, 0
    for dim, (ids, _) in queries.items():
        offsets[dim], n = n, n + len(ids)
    best = _Best(n, k)
    held: dict[int, list] = {}

    def flush(dim: int) -> None:
        parts = held.pop(dim)
        ids = np.concatenate([p[0] for p in parts])
        columns = np.ascontiguousarray(np.concatenate([p[1] for p in parts]).T)
        qids, matrix = queries[dim]
        search_block(matrix, qids, columns, ids, best, offsets[dim] + np.arange(len(qids)))

    for batch in batches:
        lists = batch.column(1)
        ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for dim in np.unique(sizes):
            if dim not in queries:
                continue
            rows = np.flatnonzero(sizes == dim)
            index = (ends[rows] - dim)[:, None] + np.arange(dim)
            held.setdefault(dim, []).append((ids[rows], flat[index]))
            if sum(len(p[0]) for p in held[dim]) >= ROWS:
                flush(dim)
    for dim in list(held):
        flush(dim)
    for dim, (qids, _) in queries.items():
        for j, qid in enumerate(qids):
            score, ids = best.score[offsets[dim] + j], best.id[offsets[dim] + j]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid)), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _merged(batches):
    rows = list(batches)
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    ``candidates`` and ``queries``: vec_id long, v array<long>, as ``quantized``
    makes them; rows with a null id or vector take no part. A vec_id tells rows
    apart: rows that repeat one are candidates of their own, and those of a
    repeated query are ranked together. Score: integer inner
    product; ties go to the smaller vec_id. A query never meets its own vec_id,
    nor vectors of another dimension. Fewer candidates than k: all of them. The
    sums must fit a long. Every block of ``block`` queries is one pass over the
    candidates.
    """
    spark = candidates.sparkSession
    candidates = materialize(candidates.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL"), "topk")
    queries = queries.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    total = queries.count()
    n_blocks = max(1, -(-total // block))
    found = None
    for b in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()  # about `block` rows
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        packed = {d: (np.array([r["vec_id"] for r in rs], np.int64), np.array([r["v"] for r in rs], np.int64).reshape(len(rs), d).T) for d, rs in by_dim.items()}
        sent = spark.sparkContext.broadcast(packed)
        part = candidates.mapInArrow(lambda it, sent=sent: _merged(_search(it, sent.value, k)), "query_id long, vec_id long, score long")
        if n_blocks > 1:
            part = materialize(part, "topk-block")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
