"""Rollups, histograms, dominant findings, differences and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import FLAG, FLAG_DEGRADED, FLAG_TIMESYNC, MERGE_RANK, PRIORITY, lookup
from tidemark.operators.ingest import STREAMS


def stream_rollup(df: DataFrame, keys: list[str], time: str, gap: str = "seq_gap") -> DataFrame:
    """Rows, first and last time and summed gaps of each key: one partial and one final aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.sum(gap).alias("gap_total"))


def totals(df: DataFrame, levels: list[str], sums: list[str]) -> DataFrame:
    """Sums for each key, each prefix of the keys and overall."""
    return df.rollup(*levels).agg(*(F.sum(c).alias(c) for c in sums))


def drop_totals(events: DataFrame) -> DataFrame:
    """Dropped rows for each stream and reason, from the operational log."""
    return events.filter("kind = 'drop'").groupBy("stream", "reason").agg(F.sum("count").alias("dropped"))


def log_health() -> list[Column]:
    """Aggregates over rows of the operational log, for ``agg`` or ``observe``: dropped rows by stream, dropped raw frames (no stream), parts sealed,
    write errors and missed rows (kinds seal, write_error, lag), the last shed stage and free space, and whether anything was dropped, shed or failed."""
    kind, dropped = F.col("kind"), F.col("kind") == "drop"
    total = lambda rows: F.sum(F.when(rows, F.col("count")).otherwise(0)).cast("long")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("cc_receive_time_ns", c)))[c]
    wrong = F.coalesce((dropped & (F.col("count") > 0)) | (kind == "write_error") | (F.col("shed_stage") > 0), F.lit(False))
    return [
        *(total(dropped & (F.col("stream_id") == k)).alias(f"dropped_{name}") for name, k in STREAMS.items()), total(dropped & F.col("stream_id").isNull()).alias("raw_dropped"),
        total(kind == "seal").alias("parts_sealed"), total(kind == "write_error").alias("write_errors"), total(kind == "lag").alias("lagged"),
        last("shed_stage").alias("shed_stage"), last("free_bytes").cast("long").alias("free_bytes"), F.bool_or(wrong).alias("warn"),
    ]


def audit(timeline: DataFrame, missions: list[str]) -> DataFrame:
    """One row: missions, ticks, ticks with a warning and a critical finding, their share (warn_rate), and whether the gate passes."""
    warn, critical = F.count_if(F.col("severity") == "warn"), F.count_if(F.col("severity") == "critical")
    out = timeline.agg(F.count_distinct(*missions).alias("missions"), F.count("*").alias("ticks"), warn.alias("warn_ticks"), critical.alias("critical_ticks"))
    share = F.when(F.col("ticks") == 0, 0.0).otherwise((F.col("warn_ticks") + F.col("critical_ticks")) / F.col("ticks"))
    return out.withColumn("warn_rate", share).withColumn("passes", (F.col("critical_ticks") == 0) & (share <= 0.005))


def audit_histogram(timeline: DataFrame) -> DataFrame:
    """Ticks with a finding by detail code."""
    found = timeline.filter(F.col("severity").isin("warn", "critical"))
    return found.groupBy("detail_code").agg(F.count("*").alias("ticks"))


def merge_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One conclusion for each key from lane results (lane, availability, severity, action, detail_code, value, limit, confidence, timesync_locked).

    The finding of highest rank wins, at equal rank the subsystem that comes first. Flags of all lanes that aren't ok are
    or-ed; a lane that isn't available adds 512, an unlocked clock 1024. Return-home and hold become land
    when gps or estimator isn't ok.
    """
    rank, first = lookup(MERGE_RANK, F.col("severity")), lookup(PRIORITY, F.col("lane"))
    raised = (F.col("availability") == "available") & (rank > 0)
    top = F.max(F.when(raised, F.struct(rank.alias("rank"), (-first).alias("order"), "severity", "action", "detail_code", "value", "limit", "confidence")))
    flags = F.coalesce(F.bit_or(F.when(raised, lookup(FLAG, F.col("lane")))), F.lit(0))
    out = findings.groupBy(*keys).agg(
        top.alias("top"), flags.alias("flags"), F.bool_or(F.col("availability") != "available").alias("degraded"), F.bool_and("timesync_locked").alias("locked"),
        F.bool_or(raised & F.col("lane").isin("gps", "estimator")).alias("lost"),
    )
    flags = F.col("flags").bitwiseOR(F.when(F.col("degraded"), FLAG_DEGRADED).otherwise(0)).bitwiseOR(F.when(F.col("locked"), 0).otherwise(FLAG_TIMESYNC))
    action = F.when(F.col("lost") & F.col("top.action").isin("rtl", "hold"), "land").otherwise(F.col("top.action"))
    return out.select(
        *keys, F.coalesce("top.severity", F.lit("ok")).alias("severity"), F.coalesce(action, F.lit("none")).alias("action"), flags.cast("int").alias("health_flags"),
        F.coalesce("top.detail_code", F.lit(0)).cast("int").alias("detail_code"), F.coalesce("top.value", F.lit(0.0)).cast("float").alias("value"),
        F.coalesce("top.limit", F.lit(0.0)).cast("float").alias("limit"), F.coalesce("top.confidence", F.lit(100)).cast("int").alias("confidence"),
    )


def sectors_visited(df: DataFrame, keys: list[str], sector: Column) -> DataFrame:
    """How many sectors a key has been in: the bits of an or-ed mask."""
    return df.groupBy(*keys).agg(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), sector))).cast("int").alias("sectors"))


def percentiles(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at given places (from 0, as columns over the count ``n``) of each key's sorted values; a long key is sorted, never held in one row."""
    w = Window.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), (F.row_number().over(w.orderBy(value)) - 1).alias("nth"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("nth") == place, F.col("x"))).alias(name) for name, place in ranks.items()))


def rank_of(percent: int) -> Column:
    """The place of the nearest rank of a percentile among ``n`` values."""
    return F.least(F.expr(f"n * {percent} div 100"), F.col("n") - 1)


def active_mean(values: Column, n: Column) -> Column:
    """The mean of the first ``n`` elements, added in order."""
    return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x.cast("double")) / n


def worst_excess(values: Column) -> Column:
    """(index, excess): the element farthest from the mean, the first of equals."""
    mean = active_mean(values, F.size(values))
    ranked = F.transform(values, lambda x, i: F.struct(F.abs(x.cast("double") - mean).alias("size"), (-i).alias("order"), (x.cast("double") - mean).alias("excess")))
    top = F.array_max(ranked)
    return F.struct((-top["order"]).alias("index"), top["excess"].alias("excess"))


def timeline_diff(a: DataFrame, b: DataFrame, keys: list[str], ordinal: str, most: int | None = None) -> DataFrame:
    """Rows of two timelines that differ, matched by place: full outer join on key and ordinal. ``most``: a report of the first ones only."""
    values = [c for c in a.columns if c not in (*keys, ordinal)]
    left, right = (d.select(*keys, ordinal, F.struct(*values).alias(n)) for d, n in ((a, "left"), (b, "right")))
    out = left.join(right, [*keys, ordinal], "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    return out if most is None else out.orderBy(*keys, ordinal).limit(most)


def reconcile(manifest: DataFrame, disk: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest rows against rows on disk for each key: both counts and whether they agree; either side may lack a key."""
    m, d = manifest.withColumnRenamed("rows", "manifest_rows"), disk.withColumnRenamed("rows", "disk_rows")
    both = m.select(*keys, "manifest_rows").join(d.select(*keys, "disk_rows"), keys, "full_outer")
    return both.withColumn("agrees", F.col("manifest_rows").eqNullSafe(F.col("disk_rows")))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """The worst of a key's failed checks (level, reason): corrupt, dirty or clean, with the reasons in order."""
    found = checks.groupBy(*keys).agg(
        F.bool_or(F.col("failed") & (F.col("level") == "corrupt")).alias("c"), F.bool_or("failed").alias("d"),
        F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("reason")))).alias("reasons"),
    )
    level = F.when(F.col("c"), "corrupt").when(F.col("d"), "dirty").otherwise("clean")
    return found.select(*keys, level.alias("verdict"), F.array_join("reasons", ";").alias("reasons"))
