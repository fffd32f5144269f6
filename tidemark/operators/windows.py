"""Detectors that ordinary windows express: robust scale, drift sums, streaks, latches, rates.

The drift sums equal their recursions in exact arithmetic; in floating point they may differ in the last bits. Where a
replay must repeat a recursion bit for bit, ``tidemark.operators.scans`` has the ordered folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_START = Window.unboundedPreceding
#: Makes the median of absolute deviations an estimate of the standard deviation.
MAD_SCALE = 1.4826


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def middle(values: Column) -> Column:
    """The median of an array: the middle value, or half the sum of the two in the middle; null if it is empty."""
    v = F.array_sort(values)
    n = F.size(values)
    high, low = F.get(v, F.floor(n / 2).cast("int")), F.get(v, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, high).otherwise(0.5 * (low + high)))


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Adds median: of the last ``size`` values, the row's own included."""
    return df.withColumn("median", middle(F.collect_list(value).over(_w(keys, order).rowsBetween(-(size - 1), 0))))


def rolling_z(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, floor: float) -> DataFrame:
    """Adds median, mad and z: the distance from the median of the last ``size`` values in units of max(1.4826 * MAD, floor)."""
    seen = F.collect_list(value).over(_w(keys, order).rowsBetween(-(size - 1), 0))
    out = df.withColumn("_seen", seen).withColumn("median", middle(F.col("_seen")))
    out = out.withColumn("mad", middle(F.transform("_seen", lambda x: F.abs(x - F.col("median")))))
    scale = F.greatest(F.lit(MAD_SCALE) * F.col("mad"), F.lit(floor))
    return out.withColumn("z", (F.col(value) - F.col("median")) / scale).drop("_seen")


def cusum(df: DataFrame, keys: list[str], order: list[str | Column], value: str, target: float, slack: float, limit: float) -> DataFrame:
    """Adds cusum_up, cusum_down and trip ("up" before "down", null if neither): sums of deviations beyond the slack, floored at 0.

    S = max(0, S + d) is the running sum of d less its lowest value so far (or 0). Rows that tie in order are one step: each has the sums after all of them.
    """
    w = _w(keys, order).rangeBetween(_START, 0)
    d = F.col(value) - target
    out = df.withColumn("_up", F.sum(d - slack).over(w)).withColumn("_down", F.sum(-d - slack).over(w))
    for side in ("up", "down"):
        out = out.withColumn(f"cusum_{side}", F.col(f"_{side}") - F.least(F.lit(0.0), F.min(f"_{side}").over(w)))
    trip = F.when(F.col("cusum_up") > limit, "up").when(F.col("cusum_down") > limit, "down")
    return out.withColumn("trip", trip).drop("_up", "_down")


def page_hinkley(df: DataFrame, keys: list[str], order: list[str | Column], value: str, delta: float, limit: float) -> DataFrame:
    """Adds ph_up, ph_down and whether either is over the limit (trip_up, trip_down): drift from the running mean by more than delta.

    Rows that tie in order are one step, as in ``cusum``.
    """
    w = _w(keys, order).rangeBetween(_START, 0)
    out = df.withColumn("_mean", F.avg(value).over(w))
    out = out.withColumn("_up", F.sum(F.col(value) - F.col("_mean") - delta).over(w)).withColumn("_down", F.sum(F.col(value) - F.col("_mean") + delta).over(w))
    out = out.withColumn("ph_up", F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(w)))
    out = out.withColumn("ph_down", F.greatest(F.lit(0.0), F.max("_down").over(w)) - F.col("_down"))
    return out.withColumn("trip_up", F.col("ph_up") > limit).withColumn("trip_down", F.col("ph_down") > limit).drop("_mean", "_up", "_down")


def streak(df: DataFrame, keys: list[str], order: list[str], bad: Column, reset: Column, name: str = "streak") -> DataFrame:
    """Adds a streak: one more on a bad row, zero on a reset, unchanged on rows that are neither."""
    w = _w(keys, order).rowsBetween(_START, 0)
    group = f"_{name}_group"
    out = df.withColumn(group, F.sum(F.when(reset, 1).otherwise(0)).over(w))
    inner = _w([*keys, group], order).rowsBetween(_START, 0)
    return out.withColumn(name, F.sum(F.when(bad & ~reset, 1).otherwise(0)).over(inner)).drop(group)


def latch(df: DataFrame, keys: list[str], order: list[str], rank: Column, evidence: list[str], name: str = "latched") -> DataFrame:
    """Adds a struct (rank, evidence...) of the highest rank so far, from the first row that reached it; null before rank 1."""
    w = _w(keys, order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_rank", rank)
    best = F.max(F.when(F.col("_rank") > 0, F.struct("_rank", (-F.col("_n")).alias("_n"), *evidence))).over(w.rowsBetween(_START, 0))
    out = out.withColumn("_best", best)
    return out.withColumn(name, F.when(F.col("_best").isNotNull(), F.struct(F.col("_best._rank").alias("rank"), *(F.col(f"_best.{e}").alias(e) for e in evidence)))).drop("_n", "_rank", "_best")


def freeze_after(df: DataFrame, keys: list[str], order: list[str], trip: Column, columns: list[str]) -> DataFrame:
    """From the first row where ``trip`` holds, ``columns`` keep that row's values; adds frozen."""
    w = _w(keys, order)
    out = df.withColumn("_trip", trip)
    tripped = F.struct(*columns)
    out = out.withColumn("_at", F.first(F.when(F.col("_trip"), tripped), ignorenulls=True).over(w.rowsBetween(_START, 0)))
    out = out.withColumn("frozen", F.col("_at").isNotNull())
    for c in columns:
        out = out.withColumn(c, F.when(F.col("frozen"), F.col(f"_at.{c}")).otherwise(F.col(c)))
    return out.drop("_trip", "_at")


def rate(df: DataFrame, keys: list[str], order: list[str], time: str, value: str, unit: float, monotone: bool = False) -> DataFrame:
    """Adds rate: change by elapsed time in units; null without time in between, and where a monotone counter steps back."""
    w = _w(keys, order)
    dt, dv = (F.col(time) - F.lag(time).over(w)) / unit, F.col(value) - F.lag(value).over(w)
    return df.withColumn("rate", F.when((dt > 0) & ((dv >= 0) if monotone else F.lit(True)), dv / dt))


def despiked(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds despiked: the median of the last three values, the value itself before there are three."""
    w = _w(keys, order)
    a, b, c = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumn("despiked", F.when(c.isNull(), a).otherwise(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))))


def gauge_faults(df: DataFrame, keys: list[str], order: list[str], consumed: str, remaining: str) -> DataFrame:
    """Adds gauge_fault: consumption fell by over 1, or the rest rose by over 0.05, in 32-bit arithmetic; NaN on either side is no fault."""
    w = _w(keys, order)
    one, step = F.lit(1.0).cast("float"), F.lit(0.05).cast("float")
    c, r = F.col(consumed).cast("float"), F.col(remaining).cast("float")
    fell = ((c + one).cast("float") < F.lag(c).over(w)) & ~F.isnan(F.lag(c).over(w))
    rose = (r > (F.lag(r).over(w) + step).cast("float")) & ~F.isnan(r)
    return df.withColumn("gauge_fault", F.coalesce(fell, F.lit(False)) | F.coalesce(rose, F.lit(False)))


def reject_rate(df: DataFrame, keys: list[str], order: list[str], rejected: str, size: int = 32) -> DataFrame:
    """Adds reject_rate: the share of rejected rows among the last ``size``."""
    share = F.avg(F.col(rejected).cast("int")).over(_w(keys, order).rowsBetween(-(size - 1), 0))
    return df.withColumn("reject_rate", share)


def warm(df: DataFrame, keys: list[str], order: list[str], time: str, counts: Column, least_time: int, least_rows: int) -> DataFrame:
    """Adds warm: since a key's first row ``least_time`` has passed and ``counts`` held in ``least_rows`` rows."""
    w = _w(keys, order).rowsBetween(_START, 0)
    since = F.col(time) - F.first(time).over(w)
    return df.withColumn("warm", (since >= least_time) & (F.sum(F.when(counts, 1).otherwise(0)).over(w) >= least_rows))


#: Fixed values of the flight-phase machine: angular rates to enter and leave a manoeuvre, frames they must hold, start-up time.
OMEGA_ENTER, OMEGA_LEAVE, DWELL, TRANSIENT_NS, ARMED = 0.35, 0.25, 5, 3_000_000_000, 2


def flight_phase(df: DataFrame, keys: list[str], order: list[str], time: str, arming: str, omega: str) -> DataFrame:
    """Adds phase of each state row: disarmed, transient (3 s from arming), maneuver or steady.

    A manoeuvre begins with the fifth frame in a row above the upper rate and ends with the fifth in a row below
    the lower one; a missing rate counts as above.
    """
    w = _w(keys, order)
    upto = w.rowsBetween(_START, 0)
    armed = F.coalesce(F.col(arming) == ARMED, F.lit(False))
    rate_ = F.when(F.col(omega).isNull() | F.isnan(omega), float("inf")).otherwise(F.col(omega))
    out = df.withColumn("_armed", armed).withColumn("_epoch", F.sum(F.when(armed, 0).otherwise(1)).over(upto))
    out = out.withColumn("_band", F.when(~F.col("_armed"), 0).when(rate_ > OMEGA_ENTER, 1).when(rate_ < OMEGA_LEAVE, -1).otherwise(0))
    out = out.withColumn("_new", F.when(F.lag("_band").over(w) == F.col("_band"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(upto))
    run = _w([*keys, "_epoch", "_run"], order)
    epoch = _w([*keys, "_epoch"], order).rowsBetween(_START, 0)
    out = out.withColumn("_length", F.row_number().over(run))
    edge = F.when((F.col("_length") >= DWELL) & (F.col("_band") != 0), F.col("_band"))
    out = out.withColumn("_edge", edge).withColumn("_in", F.coalesce(F.last("_edge", ignorenulls=True).over(epoch), F.lit(-1)) == 1)
    out = out.withColumn("_since", F.min(F.when(F.col("_armed"), F.col(time))).over(epoch))
    phase = F.when(~F.col("_armed"), "disarmed").when(F.col(time) - F.col("_since") < TRANSIENT_NS, "transient").when(F.col("_in"), "maneuver").otherwise("steady")
    return out.withColumn("phase", phase).drop("_armed", "_epoch", "_band", "_new", "_run", "_length", "_edge", "_in", "_since")
