"""Recursions by composition beside the row-at-a-time ones, on long and short keys, with missing values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import prefix, scans

K, O = ["k"], ["t", "i"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    found, t = [], 0
    for i in range(6000):
        t += rnd.randrange(3)
        k = rnd.choice([1, 1, 1, 1, 2, 3, None])
        x = rnd.choice([None, float("nan"), 1e6 + rnd.random()]) if rnd.random() < 0.05 else 1e3 + rnd.gauss(0, 5)
        found.append((k, t, i, x if k != 3 else None, rnd.random(), rnd.randrange(1000)))
    return spark.createDataFrame(found, "k long, t long, i long, x double, u double, free long").cache()


def same(a, b, columns, tolerance):
    a, b = ({r.i: r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and len(a) == 6000
    for i, r in a.items():
        for c in columns:
            x, y = r[c], b[i][c]
            assert (x is None) == (y is None) and (x is None or x == y or math.isclose(x, y, rel_tol=tolerance, abs_tol=tolerance)), (i, c, x, y)


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.9])
def test_weighted_means_and_variances(spark, rows, alpha):
    got = prefix.ewma(rows, K, O, "x", alpha, F.floor(F.col("t") / 100))
    same(got, scans.ewma(rows, K, O, "x", alpha), ["ewma", "ewma_var"], 1e-6)


def test_no_blocks_and_an_empty_table(spark, rows):
    same(prefix.ewma(rows, K, O, "x", 0.2), scans.ewma(rows, K, O, "x", 0.2), ["ewma", "ewma_var"], 1e-6)
    none = rows.limit(0)
    assert prefix.ewma(none, K, O, "x", 0.2).count() == prefix.shedding(none, K, O, "free", (1, 2, 3), (4, 5, 6)).count() == prefix.least_squares(none, K, O, "u", "x").count() == 0


def test_link_quality(spark, rows):
    same(prefix.link_quality(rows, K, O, "u", "x", 900, 0.1, F.floor(F.col("t") / 500)), scans.link_quality(rows, K, O, "u", "x", 900, 0.1), ["lost_share", "rate", "jitter"], 1e-6)


def test_least_squares(spark, rows):
    df = rows.withColumn("y", F.when(F.col("x") < 2e3, F.col("x") - 1e3 + 3 * F.col("u")))
    got = prefix.least_squares(df, K, O, "u", "y", block=F.floor(F.col("t") / 100))
    same(got, scans.rls(df, K, O, "u", "y"), ["residual", "theta0", "theta1", "theta2"], 1e-6)


@pytest.mark.parametrize("wide", [2, 64])
def test_the_ladder(spark, rows, wide, monkeypatch):
    monkeypatch.setattr(prefix, "WIDE", wide)
    df = rows.filter("k is not null")
    marks = (400, 200, 50), (600, 300, 100)
    a, b = ({r.i: r.stage for r in x.collect()} for x in (prefix.shedding(df, K, O, "free", *marks, F.floor(F.col("t") / 700)), scans.shedding(df, K, O, "free", *marks)))
    assert a == b and set(a.values()) == {0, 1, 2, 3}


def test_the_ladder_sends_no_table_whole_to_every_task(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS", 500)
    df = rows.filter("k is not null")
    found = prefix.shedding(df, K, O, "free", (400, 200, 50), (600, 300, 100), F.floor(F.col("t") / 700))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert found.rdd.getNumPartitions() == -(-df.count() // 500) and found.count() == df.count()


def test_one_long_key_is_many_tasks_and_no_python(spark, rows):
    found = prefix.ewma(rows.filter("k = 1"), K, O, "x", 0.05, F.floor(F.col("t") / 100))
    plan = found._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
    blocks = prefix.numbered(rows.filter("k = 1"), K, O, F.floor(F.col("t") / 100), F.lit(True), "n")
    assert blocks.select("_block").distinct().count() > 40 and blocks.agg(F.max("n")).first()[0] == rows.filter("k = 1").count()


def test_rows_are_numbered_without_a_join(spark, rows):
    times = F.when(F.col("i") % 50 != 0, F.col("t"))  # a row without a time has no block
    df = rows.withColumn("t", times)
    df = df.unionAll(df.filter("i < 300"))  # rows that come twice
    found = prefix.numbered(df, K, O, F.floor(F.col("t") / 100), F.col("x").isNotNull(), "n")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want, counts = [], {}
    for r in sorted(df.collect(), key=lambda r: (r.t is not None, r.t or 0, r.i)):
        counts[r.k] = counts.get(r.k, 0) + (r.x is not None)
        want.append((r.k, r.i, counts[r.k]))
    assert None in counts and counts[3] == 0
    assert sorted(((r.k, r.i, r.n) for r in found.collect()), key=str) == sorted(want, key=str)


def test_the_ladder_joins_nodes_and_not_rows(spark, rows, monkeypatch):
    kept, stored = {}, prefix.stored

    def keep(df, name):
        kept.setdefault(name, []).append(found := stored(df, name))
        return found

    monkeypatch.setattr(prefix, "stored", keep)
    df = rows.select(*K, *O, F.when(F.col("i") % 11 != 0, F.col("free")).alias("free"))
    df = df.unionAll(df.filter("i < 300"))
    low, resume, stages, want, counts = (400, 200, 50), (600, 300, 100), {}, [], {}
    for r in sorted(df.filter("k IS NOT NULL").collect(), key=lambda r: (r.t, r.i)):  # rows without a key are left out
        s, counts[r.k] = stages.get(r.k, 0), counts.get(r.k, 0) + 1
        worst = max((n + 1 for n, mark in enumerate(low) if r.free is not None and r.free < mark), default=0)
        stages[r.k] = worst if worst > s else s - 1 if s and r.free is not None and r.free >= resume[s - 1] else s
        want.append((r.k, r.i, stages[r.k]))
    found = prefix.shedding(df, K, O, "free", low, resume, F.floor(F.col("t") / 700))
    assert sorted((r.k, r.i, r.stage) for r in found.collect()) == sorted(want)
    assert kept["rows"][0].columns == [*df.columns, "_i"] and "_all" not in kept["maps"][0].columns
    assert kept["entered"][0].filter("k IS NOT NULL").count() == sum(-(-n // prefix.WIDE) for n in counts.values())
