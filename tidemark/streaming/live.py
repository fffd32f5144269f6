"""The live path on Structured Streaming: validated rows, counters, a stale-stream watchdog and running statistics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ingest import STALE_PERIODS
from tidemark.operators.aggregates import log_health
from tidemark.operators.scans import Ewma
from tidemark.sources.shared import folder


def counters(rows: DataFrame, keys: list[str], time: str = "ts", every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Rows and gaps of each key and interval, final once the watermark has passed."""
    windowed = rows.withWatermark(time, late).groupBy(*keys, F.window(time, every).alias("w"))
    return windowed.agg(F.count("*").alias("rows"), F.sum("seq_gap").alias("gaps")).select(*keys, F.col("w.start").alias("at"), "rows", "gaps")


def watchdog(rows: DataFrame, keys: list[str], period_ms: int, time: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(keys, state, at_ms): "stale" once when a key has been silent for STALE_PERIODS periods of event time, "fresh" when it returns.

    State is one time and one flag a key; a timer fires it as the watermark passes.
    """
    limit = STALE_PERIODS * period_ms
    kinds = [(k, rows.schema[k].dataType.simpleString()) for k in keys]
    out = ", ".join(f"{k} {t}" for k, t in kinds) + ", state string, at_ms long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, stale = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.update((last, True))
            yield pd.DataFrame([(*key, "stale", last + limit)], columns=[*keys, "state", "at_ms"])
            return
        found = []
        for x in sorted(int(x.timestamp() * 1000) for b in batches for x in b[time]):
            if last and not stale and x - last > limit:
                found.append((*key, "stale", last + limit))
                stale = True
            if stale and x > last:
                found.append((*key, "fresh", x))
                stale = False
            last = max(last, x)
        newest = last
        if found:
            yield pd.DataFrame(found, columns=[*keys, "state", "at_ms"])
        state.update((newest, False))
        if newest + limit > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(newest + limit)
        else:
            state.update((newest, True))
            yield pd.DataFrame([(*key, "stale", newest + limit)], columns=[*keys, "state", "at_ms"])

    grouped = rows.withWatermark(time, late).groupBy(*keys)
    return grouped.applyInPandasWithState(step, out, "last long, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)


def running_ewma(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """(keys, order, ewma): the EWMA after each row; rows of a key are sorted within a micro-batch and follow on from the one before."""
    kinds = [(k, rows.schema[k].dataType.simpleString()) for k in (*keys, order)]
    out = ", ".join(f"{k} {t}" for k, t in kinds) + ", ewma double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Ewma(alpha)
        if state.exists:
            fold.mean, fold.var, fold.n = state.get
        parts = list(batches)
        found = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values(order)
        means = []
        for x in found[value].tolist():
            fold.update(x)
            means.append(fold.mean)
        state.update((float(fold.mean), float(fold.var), int(fold.n)))
        yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key)}, order: found[order].to_numpy(), "ewma": means})

    bare = rows.select(*dict.fromkeys([*keys, order, value]))  # every other column would be shuffled and converted for nothing
    return bare.groupBy(*keys).applyInPandasWithState(step, out, "mean double, var double, n long", "append", GroupStateTimeout.NoTimeout)


def record(rows: DataFrame, path: str, checkpoint: str, partitions: list[str]):
    """Start writing rows to Parquet parts by partition; the file sink's log makes a restart neither lose nor repeat rows."""
    return rows.writeStream.format("parquet").partitionBy(*partitions).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tee(rows: DataFrame, path: str, checkpoint: str, branches: dict[str, Callable[[DataFrame], DataFrame]], every: str | None = None):
    """Start writing several branches of one stream (raw frames, telemetry, clock replies), each to its folder: all that is there now, or a batch ``every`` interval.

    A micro-batch that runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, branch in branches.items():
                branch(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def observed(operations: DataFrame, name) -> DataFrame:
    """The operational log with its health counters taken as it is written; ``name``: an Observation, or a name to find in a stream's progress."""
    return operations.observe(name, *log_health())


def status(query) -> str:
    """What a running stream last did, as JSON: its batch, rows, rates and observed counters."""
    last = query.lastProgress
    if last is None:
        return json.dumps({"id": str(query.id), "active": query.isActive})
    progress = json.loads(last.json)
    kept = {k: progress.get(k) for k in ("batchId", "timestamp", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "observedMetrics")}
    return json.dumps({"id": str(query.id), "active": query.isActive, **kept})


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now, and read what it wrote. In complete mode each batch replaces the last one's result."""
    spark = rows.sparkSession
    path = folder(spark, "stream")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{path}/out")
    writer.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")
