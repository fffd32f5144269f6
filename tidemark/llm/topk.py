"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

#: Fixed-point scale of the components.
SCALE = 1024
#: Rows of one block of queries and of candidates; a task holds one block of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
_CELL = "query_id long, query_copy int, vec_id long, vec_copy int, score long, depth int"


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, copy, v): floor(SCALE * component) of each vector that takes part.

    Left out: a null vec_id, a null vector, one holding null or non-finite components. Rows that share a vec_id
    all stay; ``copy`` numbers them from 1 by vector. Vectors of different length compare as if padded with zeros.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
        .withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers as exact doubles where every product sum fits 53 bits, else as 64-bit integers."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def threshold_top_k(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
    """For each query row: its number, the positions and scores of its k best vectors (ties to the smaller id), and how deep it walked.

    Each dimension has a list of the vectors sorted by that component. A query walks every list at once, from
    the largest component where its own is positive, from the smallest where it is negative. At depth d
    no unseen vector scores above the sum of the query's products with the components at d. Vectors met are scored
    whole; the walk stops when k of them, or the query's entry in ``floors`` (what k vectors elsewhere reach at least), score above that bound.
    Vectors below the floor are passed over. Depth doubles from step to step, and a vector is scored once. ``ids`` and ``own`` are rows of
    numbers compared in order; candidates that equal the query's own don't count.
    """
    n, width = vectors.shape
    exact = np.abs(queries).max(initial=0) * float(np.abs(vectors).max(initial=0)) * width < 2.0**53
    scored = vectors.astype(np.float64) if exact else vectors
    asked = queries.astype(np.float64) if exact else queries
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(scored, order, axis=0)
    by_id = np.lexsort(ids.T[::-1])
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    first_depth = max(16, k)
    lowest = -np.inf if exact else np.iinfo(np.int64).min
    floors = np.full(len(queries), lowest) if floors is None else floors
    for row, q in enumerate(asked):
        use = np.flatnonzero(q)
        down = q[use] > 0
        rising, falling = use[~down], use[down]
        seen = (ids == own[row]).all(axis=1)
        positions, scores = np.empty(0, np.int64), np.empty(0, scored.dtype)
        floor = floors[row]
        done, depth = 0, min(n, first_depth)
        while True:
            before = seen.copy()
            seen[order[n - depth : n - done, falling]] = True
            seen[order[done:depth, rising]] = True
            if not len(use):
                seen[:] = True
            new = np.flatnonzero(seen & ~before)
            found = scored[new] @ q
            keep = found >= floor
            positions, scores = np.concatenate([positions, new[keep]]), np.concatenate([scores, found[keep]])
            if len(positions) > k:
                best = np.lexsort((rank[positions], -scores))[:k]
                positions, scores = positions[best], scores[best]
            if len(positions) == k:
                floor = max(floor, scores.min())
            finished = depth >= n or not len(use)
            if not finished and floor > lowest:
                at = np.where(down, lists[n - depth, use], lists[depth - 1, use])
                finished = floor > at @ q[use]
            if finished:
                best = np.lexsort((rank[positions], -scores))
                yield row, positions[best], scores[best], depth
                break
            done, depth = depth, min(n, depth * 2)


def _cell(k: int):
    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))
            own, ids = (np.stack([t[c].to_numpy().astype(np.int64) for c in ("vec_id", "copy")], axis=1) for t in (left, right))
            floors = left["floor"].to_pylist()
            known = None if None in floors else np.array(floors, np.int64)
            for row, positions, scores, depth in threshold_top_k(_matrix(left["v"], width), _matrix(right["v"], width), own, ids, k, known):
                n = len(positions)
                for c, x in zip(out, (np.full(n, own[row, 0]), np.full(n, own[row, 1]), ids[positions, 0], ids[positions, 1], scores.astype(np.int64), np.full(n, depth))):
                    c.append(x)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), t) for c, t in zip(out, types)], names=[c.split()[0] for c in _CELL.split(", ")])

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, query_copy, rank, vec_id, vec_copy, score, depth): the k vectors of largest integer inner product for each query.

    Both sides are (vec_id, copy, v) as from ``scaled``; a query's own row (same vec_id and copy) is no candidate. Queries and candidates are
    dealt into blocks of bounded size by hash, and each pair of blocks is one task that runs the threshold algorithm and
    passes on k rows a query at most. The first block of candidates comes first: the k-th score that a query reaches there is a floor for
    all others, whose walks stop at it. A window by query merges them. A candidate is copied once for each
    block of queries, a query once for each block of candidates. Ties go to the smaller vec_id, then copy; fewer
    than k candidates give fewer rows; an empty side gives an empty table. ``depth`` is how far the walk went that found the row.
    """
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks, v_blocks = -(-n_queries // QUERY_BLOCK) or 1, -(-n_vectors // CANDIDATE_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("vec_id", "copy"), F.lit(n)).cast("int")
    asked = queries.select(*(F.col(c).alias(c) for c in ("vec_id", "copy", "v")), block(q_blocks).alias("qb"))
    every_q = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")
    dealt = vectors.select("vec_id", "copy", "v", block(v_blocks).alias("vb"), every_q)

    def search(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_cell(k), _CELL)

    found = stored(search(asked.withColumns({"vb": F.lit(0), "floor": F.lit(None).cast("long")}), dealt.filter("vb = 0")), "top-first")
    if v_blocks > 1:
        floors = found.groupBy("query_id", "query_copy").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
        rest = F.explode(F.sequence(F.lit(1), F.lit(v_blocks - 1))).alias("vb")
        lowest = F.coalesce("floor", F.lit(-(1 << 63)).cast("long")).alias("floor")
        left = asked.join(floors, (F.col("vec_id") == F.col("query_id")) & (F.col("copy") == F.col("query_copy")), "left").select("vec_id", "copy", "v", "qb", lowest, rest)
        found = found.unionByName(search(left, dealt.filter("vb > 0")))
    best = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "vec_copy")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_copy", "rank", "vec_id", "vec_copy", "score", "depth")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = stored(scaled(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors).select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS copy
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings)
), scores AS (
  SELECT q.vec_id AS query_id, q.copy AS query_copy, c.vec_id, c.copy, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.copy <> c.copy WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id, copy) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
