from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import align, ingest

EPOCH = 1_700_000_000_000_000_000  # nanoseconds that a double can't tell apart


def test_ticks_and_stale_times_are_exact_at_epoch_nanoseconds(spark):
    df = spark.createDataFrame([("a", EPOCH - 1), ("a", EPOCH + 250_000_000), ("b", -150_000_000), ("b", 0)], "k string, t long")
    got = sorted((r.k, r.tick) for r in align.ticks(df, ["k"], "t", 100_000_000).collect())
    assert got == [("a", EPOCH), ("a", EPOCH + 100_000_000), ("a", EPOCH + 200_000_000), ("b", -100_000_000), ("b", 0)]
    df = spark.createDataFrame([("a", EPOCH - 101), ("a", EPOCH + 10_000)], "k string, t long")
    assert [r.stale_at for r in ingest.stale_intervals(df, ["k"], "t", 100, 1000).collect()] == [EPOCH]
    one = spark.range(1).select(scalars.companion_to_controller_us(F.lit(EPOCH + 999), F.lit(0)).alias("x")).first().x
    assert one == EPOCH // 1000


def test_as_of_takes_the_last_of_equal_times(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5), ("b", 10)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 2, "x"), ("a", 10, 1, "y"), ("a", 9, 3, "z")], "k string, t long, seq int, v string")
    by_seq = {(r.k, r.t): r.v for r in align.as_of(left, right, ["k"], "t", "t", ["v"], ("seq",)).collect()}
    assert by_seq == {("a", 10): "x", ("a", 5): None, ("b", 10): None}
    assert {(r.k, r.t): r.v for r in align.as_of(left, right, ["k"], "t", "t", ["v"]).collect()}[("a", 10)] == "y"
