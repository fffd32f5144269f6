"""Validation, classification, continuity, age and staleness of telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import direction

WRAP = 1 << 32
SWEEP = 100_000_000
#: Stream ids, and the nominal period of those that have one, in nanoseconds.
STREAMS = {"state": 0, "imu": 1, "power": 2, "gps": 3, "estimator": 4, "actuator": 5, "event": 6, "safety_status": 7}
PERIOD_NS = {0: 40_000_000, 1: 20_000_000, 2: 100_000_000, 3: 200_000_000, 4: 100_000_000, 5: 60_000_000}
#: A stream is stale once it has been silent for so many periods.
STALE_PERIODS = 4
#: Stages of the shedding ladder, and the streams that each one drops. The others are never shed.
SHED = {"normal": [], "shed_raw": [], "shed_bf": ["imu", "actuator"], "shed_crit": ["imu", "actuator", "power", "gps", "estimator"]}


def seq_gap(df: DataFrame, keys: list[str], order: list[str], seq: str = "sequence") -> DataFrame:
    """Adds seq_gap: messages missing before a row. Sequences wrap at 2^32; a repeat or step back counts 0, so does the first row."""
    before = F.lag(seq).over(Window.partitionBy(*keys).orderBy(*order))
    step = F.pmod(F.col(seq) - before, F.lit(WRAP))
    gap = F.when(before.isNull() | (step == 0) | (step > WRAP // 2 - 1), 0).otherwise(step - 1)
    return df.withColumn("seq_gap", gap.cast("long"))


def boot_epoch(df: DataFrame, keys: list[str], order: list[str], boot: str = "boot", counts: Column | None = None) -> DataFrame:
    """Adds epoch: how often the boot id has changed so far. ``counts`` marks the rows that tell it; others take what holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    told = F.col(boot) if counts is None else F.when(counts, F.col(boot))
    before = F.last(told, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.when(told.isNotNull() & before.isNotNull() & (told != before), 1).otherwise(0)
    return df.withColumn("_changed", changed).withColumn("epoch", F.sum("_changed").over(w)).drop("_changed")


def demux(frames: DataFrame, message: str, sent: str, sync: int, safety: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(replies, telemetry, acknowledgements): clock replies (requests, whose ``sent`` is zero, go), all other frames, and those of the safety status again."""
    is_sync = F.col(message).eqNullSafe(F.lit(sync))
    return frames.filter(is_sync & (F.col(sent) != 0)), frames.filter(~is_sync), frames.filter(F.col(message) == safety)


def age_ns(now_ns: Column, fc_us: Column, offset_ns: Column, locked: Column) -> Column:
    """Time since a measurement by the common clock; null while the clocks aren't locked."""
    return F.when(locked, now_ns - (fc_us * 1000 - offset_ns))


def inter_arrival(df: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """Adds dt: time since the row before, null unless it is positive."""
    dt = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("dt", F.when(dt > 0, dt))


def stale_intervals(df: DataFrame, keys: list[str], time: str, limit: int, sweep: int) -> DataFrame:
    """One row for each silence of more than ``limit``: last_seen, stale_at (the first sweep beyond it) and recovered_at."""
    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time))
    found = df.select(*keys, F.col(time).alias("last_seen"), after.alias("recovered_at"))
    due = F.col("last_seen") + limit
    stale_at = due - F.pmod(due, F.lit(sweep).cast("long")) + sweep
    return found.withColumn("stale_at", stale_at.cast("long")).filter(F.col("stale_at") <= F.col("recovered_at"))


def fresh(tick: Column, last_seen: Column, period: int) -> Column:
    """Seen (0 means never) and not longer ago than STALE_PERIODS periods."""
    return F.coalesce((last_seen != 0) & (tick - last_seen <= STALE_PERIODS * period), F.lit(False))


def reject_reason(system: Column, component: Column, version: Column, confidence: Column, message: Column, want_system: int, want_version: int) -> Column:
    """Why a message is refused, the first of: unknown id, source, schema version, range; null if it is not."""
    return (
        F.when(direction(message).isNull(), "unknown")
        .when((system != want_system) | (component != 1), "source")
        .when(version != want_version, "schema")
        .when(confidence > 100, "range")
    )


def allowed(stage: Column, stream: Column) -> Column:
    """Whether a shedding stage keeps rows of a stream."""
    drops = F.lit(False)
    for name, streams in SHED.items():
        if streams:
            drops = drops | ((stage == name) & stream.isin(streams))
    return ~drops


def per_second(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Rows and summed gaps for each key and second."""
    return df.groupBy(*keys, seconds.alias("second")).agg(F.count("*").alias("rows"), F.sum("seq_gap").alias("gaps"))


def link_state(age: Column) -> Column:
    """From the age of the last heartbeat in nanoseconds; null means none yet."""
    return F.when(age.isNull(), "down").when(age <= 2_500_000_000, "up").when(age <= 5_000_000_000, "degraded").otherwise("down")
