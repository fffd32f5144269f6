import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    v = {}
    for i, x, _ in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(float(np.float32(c)) * 1024) for c in x])
    every = [(i, n + 1, y) for i, ys in v.items() for n, y in enumerate(sorted(ys))]
    out = set()
    for q, qn, y in every:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(y, z)), i, n) for i, n, z in every if (i, n) != (q, qn))
            out |= {(q, qn, m + 1, i, n, -s) for m, (s, i, n) in enumerate(scores[:k])}
    return out


def found(df):
    v = topk.scaled(df)
    return {tuple(r) for r in topk.top_k(v.filter(F.col("vec_id") % 100 == 0), v).drop("depth").collect()}


def test_equals_brute_force_over_blocks_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.1) for _ in range(8)], 1) for i in range(700)]
    rows += [(i, rows[100][1], 1) for i in range(700, 760)]  # ties
    rows += [(800, None, 1), (801, [1.0, None], 1), (802, [math.nan] * 8, 1), (803, [math.inf] * 8, 1), (900, [], 1), (901, [0.5], 1), (None, [0.1] * 8, 1), (1000, [0.0] * 8, 1)]
    rows += [(5, rows[5][1], 2), (300, rows[7][1], 2), (300, rows[300][1], 2), (5, rows[9][1], 2)]  # rows of one vec_id
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1))
    assert found(df) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [0.5, -1.0], 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {(0, 1, 1, 1, 1, 1024 * 512 - 2048 * 1024)}
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_the_walk_stops_early_when_one_component_decides_and_earlier_at_a_floor():
    n = 4000
    vectors = np.zeros((n, 2), np.int64)
    vectors[:, 0] = np.arange(n)
    ids = np.stack([np.arange(n), np.ones(n, int)], axis=1)
    (_, best, _, depth), = topk.threshold_top_k(np.array([[5, 0]]), vectors, np.array([[-1, 1]]), ids, 3)
    assert best.tolist() == [n - 1, n - 2, n - 3] and depth <= 32
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(0, 300, (n, 3)).astype(np.int64)
    queries = rnd.normal(0, 300, (20, 3)).astype(np.int64)
    own = np.full((20, 2), -1)
    plain = list(topk.threshold_top_k(queries, vectors, own, ids, 5))
    floors = np.array([s[-1] for _, _, s, _ in plain], np.int64)
    with_floor = list(topk.threshold_top_k(queries, vectors[::2], own, ids[::2], 5, floors))
    assert sum(d for *_, d in with_floor) * 2 < sum(d for *_, d in plain) < 20 * n / 4
    for (_, p, s, _), (_, q, r, _) in zip(plain, with_floor):
        assert [(i, x) for i, x in zip(p, s) if i % 2 == 0] == [(2 * i, x) for i, x in zip(q, r)]
