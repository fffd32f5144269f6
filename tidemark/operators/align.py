"""Aligning streams: ordered union, latest values, as-of joins on a logical grid and on step functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evaluation grid in nanoseconds.
TICK_NS = 100_000_000


def merged(streams: list[DataFrame]) -> DataFrame:
    """One table of several streams; columns that a stream lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row within its key; a null sequence sorts as 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the last value that isn't null, at or before the row in total order. One sort, one window, no join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in values.items()})


def ticks(df: DataFrame, keys: list[str], time: str, step: int = TICK_NS) -> DataFrame:
    """(keys, tick): the grid of each key: from the first multiple of ``step`` after its first row, up to its last row."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    start = F.col("_first") - F.pmod(F.col("_first"), F.lit(step).cast("long")) + step
    ends = ends.withColumn("_start", start.cast("long")).filter(F.col("_start") <= F.col("_last"))
    return ends.select(*keys, F.explode(F.sequence("_start", "_last", F.lit(step).cast("long"))).alias("tick"))


def at_ticks(df: DataFrame, keys: list[str], time: str, order: list[str], values: list[str], step: int = TICK_NS, span: DataFrame | None = None) -> DataFrame:
    """(keys, tick, values): on each grid point the last values of rows strictly before it, nulls passed over.

    Grid rows join the events in a union and sort before events of equal time, so the window sees earlier ones only.
    ``span``: a cheaper table with the first and last times of ``df``, where ``df`` is the end of long work that would be done twice.
    """
    grid = ticks(df if span is None else span, keys, time, step).select(*keys, F.col("tick").alias("_t"), F.lit(0).alias("_event"))
    events = df.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_event"), *dict.fromkeys([*(o for o in order if o not in keys), *values]))
    both = grid.unionByName(events, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_event", *(o for o in order if o != time)).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return seen.filter("_event = 0").select(*keys, F.col("_t").alias("tick"), *values)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], right_order: tuple[str, ...] = ()) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at or before its time, by union and window.

    Of rows of ``right`` of equal time the last by ``right_order``, then by the values themselves, counts.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    marked = F.struct(*values)
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), marked.alias("_found"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", *(f"_o{i}" for i in range(len(right_order))), "_found").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_found", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def step_lookup(df: DataFrame, steps: list[tuple[int, str]], elapsed: Column, name: str) -> DataFrame:
    """Adds the value of the last step that began at or before ``elapsed``: a short schedule as a literal, no join."""
    rows = sorted(steps)
    schedule = F.array(*(F.struct(F.lit(t).cast("long").alias("at"), F.lit(v).alias("value")) for t, v in rows))
    begun = F.filter(schedule, lambda s: s["at"] <= elapsed)
    return df.withColumn(name, F.get(begun, F.size(begun) - 1)["value"])
