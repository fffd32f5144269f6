"""Trees of hashes over timelines, beside the comparison of all rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merkle
from tidemark.operators.aggregates import timeline_diff


def timeline(spark, n, change=()):
    df = spark.range(n).select((F.col("id") % 3).alias("mission"), F.floor(F.col("id") / 3).alias("ordinal"), F.lit("ok").alias("severity"), (F.col("id") / 7).cast("float").alias("value"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("code"))
    for ordinal, column, value in change:
        df = df.withColumn(column, F.when((F.col("ordinal") == ordinal) & (F.col("mission") == 1), value).otherwise(F.col(column)))
    return df


@pytest.mark.parametrize("wide", [2, 64])
def test_differences_are_those_of_all_rows(spark, wide, monkeypatch):
    monkeypatch.setattr(merkle, "WIDE", wide)
    a, b = timeline(spark, 3000), timeline(spark, 2900, [(7, "severity", F.lit("warn")), (500, "value", F.lit(0.5).cast("float")), (501, "code", F.lit(None).cast("long")), (999, "severity", F.lit("x"))])
    rows = lambda df: sorted((r.mission, r.ordinal, str(r.left), str(r.right)) for r in df.collect())
    want = rows(timeline_diff(a, b, ["mission"], "ordinal"))
    assert rows(merkle.tree_diff(a, b, ["mission"], first=10**6)) == want and len(want) > 100
    cut = merkle.tree_diff(a, b, ["mission"]).collect()
    assert sorted((r.mission, r.ordinal) for r in cut) == sorted(x for m in range(3) for x in sorted(w[:2] for w in want if w[0] == m)[:20])
    ranges = merkle.differing(merkle.tree(a, ["mission"]), merkle.tree(timeline(spark, 3000, [(7, "severity", F.lit("warn"))]), ["mission"]), ["mission"])
    assert [tuple(r) for r in ranges.collect()] == [(1, 7 // wide)]


def test_equal_and_empty_timelines(spark):
    a = timeline(spark, 600)
    tops = merkle.tree(a, ["mission"]).filter("level = 1")
    assert tops.count() == 3 and merkle.differing(merkle.tree(a, ["mission"]), merkle.tree(timeline(spark, 600), ["mission"]), ["mission"]).count() == 0
    assert merkle.tree_diff(a, timeline(spark, 600), ["mission"]).count() == 0 == merkle.tree_diff(a.limit(0), a.limit(0), ["mission"]).count()
    assert merkle.tree_diff(a, a.limit(0), ["mission"]).count() == 60
