"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into bounded blocks; every pair of a query block and a candidate block is
one tile. A tile multiplies vectors rounded to int8 (exact sums, held in float32) and knows how far the true
inner product can be off: |q.x - q'.x'| <= |q||x - x'| + |q - q'||x'|. A pair survives if its upper bound
reaches the lower bound of the tile's k-th best pair of that query. Survivors are recomputed in double
precision, and each tile's best k per query are merged by heaps. The result equals the exact search; ties go
to the smaller id.

Vectors that are null, zero, or that hold null or non-finite components take no part; the others must have one
length, or the search fails. A query is not its own candidate: rows with its id are left out. Rows with equal ids are
separate candidates, and separate queries: every query row gets a list of its own, with ranks from 1.
Few candidates: all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
MAX_EXACT_DIM = 1 << 10      # int8 sums of so many products are exact in float32


def usable(vec: Column) -> Column:
    """Finite in every component and not all zero."""
    ok = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda v: v != 0)


class Tile:
    """Vectors of a block with their int8 form and the norms that bound its error."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        scale = np.abs(vectors).max(axis=1) / 127.0
        self.small = np.rint(vectors / scale[:, None]).astype(np.int8)
        self.scale = scale
        rounded = self.small * scale[:, None]
        self.norm = np.linalg.norm(vectors, axis=1)
        self.off = np.linalg.norm(vectors - rounded, axis=1)
        self.rounded_norm = np.linalg.norm(rounded, axis=1)


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed component by component: equal vectors score equally."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        out += queries[:, j] * candidates[:, j]
    return out


def tile_best(q: Tile, c: Tile, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, candidate id, score) of each query's best k in a tile."""
    out_q, out_id, out_score = [], [], []
    step = min(q.small.shape[1], MAX_EXACT_DIM)
    for at in range(0, len(q.ids), rows):
        part = slice(at, min(at + rows, len(q.ids)))
        product = np.zeros((part.stop - part.start, len(c.ids)))
        for d in range(0, q.small.shape[1], step):
            product += (q.small[part, d:d + step].astype(np.float32) @ c.small[:, d:d + step].astype(np.float32).T)
        near = product * q.scale[part, None] * c.scale[None, :]
        bound = (q.norm[part, None] * c.off[None, :] + q.off[part, None] * c.rounded_norm[None, :]) * (1 + 1e-9) + 1e-12
        own = q.ids[part, None] == c.ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        if len(c.ids) > k:
            floor = np.partition(low, len(c.ids) - k, axis=1)[:, len(c.ids) - k]
        else:
            floor = np.full(len(low), -np.inf)
        r, j = np.nonzero((near + bound >= floor[:, None]) & ~own)
        for lo in range(0, len(r), 1 << 18):
            rr, jj = r[lo:lo + (1 << 18)], j[lo:lo + (1 << 18)]
            score = exact_scores(q.vectors[at + rr], c.vectors[jj])
            out_q.append(at + rr)
            out_id.append(c.ids[jj])
            out_score.append(score)
    if not out_q:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    rq, rid, rs = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)
    order = np.lexsort((rid, -rs, rq))
    rq, rid, rs = rq[order], rid[order], rs[order]
    head = np.concatenate([[True], rq[1:] != rq[:-1]]) if len(rq) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    rank = np.arange(len(rq)) - np.repeat(first, np.diff(np.concatenate([first, [len(rq)]])))
    keep = rank < k
    return rq[keep], rid[keep], rs[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates with the largest inner product."""
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(usable(F.col("v")) & F.col("id").isNotNull())
    base = common.saved(base.withColumn("h", F.xxhash64("id", "v")), "vectors")
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("q"), F.min(F.size("v")).alias("low"),
                      F.max(F.size("v")).alias("high")).first()
    if counts["low"] != counts["high"]:
        raise ValueError(f"the vectors have {counts['low']} to {counts['high']} components; an inner product needs one length")
    # as many blocks as keep each at about its size; a row's block is a hash of it and its place in the file
    n_q = max(1, -(-int(counts["q"] or 0) // query_block))
    n_c = max(1, -(-int(counts["n"] or 0) // candidate_block))
    spread = F.xxhash64("h", F.monotonically_increasing_id())
    candidates = base.select("id", "v", F.pmod(spread, F.lit(n_c)).alias("c")).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))
    queries = base.where("q").select("id", F.monotonically_increasing_id().alias("row"), "v", F.pmod(spread, F.lit(n_q)).alias("r")).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint"))))

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())),
                             "scores": pa.array([], pa.list_(pa.float64()))})
        q = Tile(left.column("id").to_numpy(), _matrix(left.column("v")))
        c = Tile(right.column("id").to_numpy(), _matrix(right.column("v")))
        row, ids, scores = tile_best(q, c, k)
        starts = np.concatenate([np.searchsorted(row, np.arange(len(q.ids))), [len(row)]]).astype(np.int32)
        return pa.table({"row": left.column("row"), "query_id": pa.array(q.ids), "ids": pa.ListArray.from_arrays(pa.array(starts), pa.array(ids)),
                         "scores": pa.ListArray.from_arrays(pa.array(starts), pa.array(scores))})

    tiles = (queries.groupBy("r", "c").cogroup(candidates.groupBy("r", "c"))
             .applyInArrow(tile, "row bigint, query_id bigint, ids array<bigint>, scores array<double>"))

    def merge(batches):
        """Rows sorted by query row: the tiles' sorted lists of one query are merged by a heap."""
        query, own, lists = None, None, []

        def flush():
            best = heapq.merge(*lists)
            got = [(i, s) for (s, i), _ in zip(best, range(k))]
            n = len(got)
            return pa.RecordBatch.from_arrays(
                [pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()),
                 pa.array([i for i, _ in got], pa.int64()), pa.array([-s for _, s in got], pa.float64())],
                ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row, qid, ids, scores in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row != own and own is not None:
                    yield flush()
                    lists = []
                own, query = row, qid
                lists.append(sorted(zip((-s for s in scores), ids, strict=True)))
                if len(lists) > 64:
                    lists = [list(x for x, _ in zip(heapq.merge(*lists), range(k)))]
        if own is not None:
            yield flush()

    dealt = tiles.repartition("row").sortWithinPartitions("row")
    return dealt.mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")
