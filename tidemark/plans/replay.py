"""Replaying recorded telemetry into a timeline of conclusions, and hashing, comparing and auditing timelines."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators.aggregates import merge_findings
from tidemark.operators.scans import ordered_scan
from tidemark.plans import lanes
from tidemark.sources.shared import stored

MISSION = ["mission_id"]
COLUMNS = ["severity", "action", "health_flags", "detail_code", "value", "limit", "confidence"]


def lane_findings(events: DataFrame) -> DataFrame:
    """(mission_id, tick, lane, availability, severity, action, detail_code, value, limit, confidence, timesync_locked): eight rows a tick.

    ``events``: telemetry rows of any number of missions in one wide table. A tick sees what came strictly before
    it. A boot, told by state rows, begins all lanes anew, but not the times at which streams were last seen. The
    prepared rows are written once to the shared folder, and so are the states at ticks; each lane scans its own columns of them and judges in a
    projection of its own, which stays within what generated code may have.
    """
    df = stored(lanes.prepared(events), "prepared")
    seen = [F.when(F.col("stream_id") == k, F.col("t")).alias(f"seen{k}") for k in range(8)]
    base = df.select("mission_id", *lanes.ORDER, *seen, F.col("age_locked").alias("locked"), F.col("phase").alias("phase_now"), F.col("epoch").alias("epoch_now"))
    rows = align.merged([base, *lanes.lane_states(df)])
    values = [*(f"seen{k}" for k in range(8)), "locked", "phase_now", "epoch_now", *lanes.STATES]
    at = align.at_ticks(rows, MISSION, "t", lanes.ORDER, values, span=df)
    at = at.withColumns({s: F.when(F.col(f"{s}.epoch") == F.col("epoch_now"), F.col(s)) for s in lanes.STATES})
    at = stored(at, "at-ticks")
    found = lanes.judged(F.array(*(f"seen{k}" for k in range(8))), F.col("tick"), F.coalesce("phase_now", F.lit("disarmed")))
    locked = F.coalesce("locked", F.lit(False)).alias("timesync_locked")
    each = [at.select("mission_id", "tick", F.lit(lane).alias("lane"), found[lane].alias("f"), locked) for lane in lanes.LANES]
    return align.merged([x.select("mission_id", "tick", "lane", "f.*", "timesync_locked") for x in each])


def replay(events: DataFrame) -> DataFrame:
    """One conclusion for each mission and tick: (mission_id, tick, severity, action, health_flags, detail_code, value, limit, confidence)."""
    return merge_findings(lane_findings(events), ["mission_id", "tick"])


class _Digest:
    def __init__(self):
        self.hash = None

    def step(self, total, nth, tick, severity, action, flags, code, value, limit, confidence):
        if self.hash is None:
            self.hash = hashlib.sha256(struct.pack("<Q", total))
        text = severity.encode() + b"\0" + action.encode() + b"\0"
        self.hash.update(struct.pack("<q", tick) + text + struct.pack("<IHffB", flags, code, value, limit, confidence))
        return (self.hash.hexdigest() if nth == total else None,)


def timeline_hash(timeline: DataFrame) -> DataFrame:
    """(mission_id, ticks, sha256): the canonical hash of each timeline: its length, then its rows in order, little-endian, floats by their bits."""
    w = Window.partitionBy("mission_id")
    df = timeline.withColumn("total", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("tick")))
    df = ordered_scan(df, MISSION, ["tick"], _Digest, ["total", "nth", "tick", *COLUMNS], "sha256 string")
    return df.filter("sha256 is not null").select("mission_id", F.col("total").alias("ticks"), "sha256")


def summary(timeline: DataFrame) -> DataFrame:
    """(mission_id, hash, ticks, findings): the head of each timeline's report."""
    found = timeline.groupBy("mission_id").agg(F.count_if(F.col("severity") != "ok").alias("findings"))
    return timeline_hash(timeline).join(found, "mission_id").select("mission_id", F.col("sha256").alias("hash"), "ticks", "findings")
