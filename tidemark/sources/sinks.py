"""Writing missions: parts by segment and stream, manifests, timelines; and reading scenario files."""

from __future__ import annotations

import tomllib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import STREAMS
from tidemark.sources.files import Files
from tidemark.sources.streams import OPERATIONS, PERIODIC, schema


#: What a scenario may say.
SEVERITIES = ["ok", "warn", "critical", "stale"]
ACTIONS = ["none", "warn_only", "block_offboard", "hold", "land", "rtl"]
FLAGS = {"battery": 1, "motor": 2, "vibration": 4, "gps": 8, "estimator": 16, "thermal": 32, "link": 64, "mission": 128, "storage": 256, "ai_degraded": 512, "timesync": 1024}


def _published(df: DataFrame, root: str, folders: list[str], rows_per_part: int) -> None:
    """One partitioned write beside the mission, whose parts, once all are whole, are moved to root/folder/folder."""
    files, staged = Files(df.sparkSession, root), f"{root}/_staged-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_part).partitionBy(*folders).parquet(staged)

    def move(at: str, to: str, depth: int) -> None:
        for name in files.names(at):
            if depth < len(folders) and "=" in name:
                move(f"{at}/{name}", f"{to}/{name.partition('=')[2]}", depth + 1)
            elif depth == len(folders) and name.startswith("part-"):
                files.move(f"{at}/{name}", f"{to}/{name}")

    move(staged, root, 0)
    files.delete(staged)


def write_parts(events: DataFrame, root: str, rows_per_part: int = 100_000) -> None:
    """Write telemetry (with a column segment) as parts under root/segment/stream: one job, whatever the number of segments and streams. A part has all
    columns that were given; those of other streams are null and take no space, and readers leave them out."""
    ids = {n: STREAMS[n] for n in PERIODIC}
    name = F.element_at(F.create_map(*(F.lit(x) for n, i in ids.items() for x in (i, n))), F.col("stream_id").cast("int"))
    wanted = list(dict.fromkeys(f.name for n in PERIODIC for f in schema(n).fields if f.name in events.columns))
    _published(events.filter(F.col("stream_id").isin(list(ids.values()))).select("segment", name.alias("stream"), *wanted), root, ["segment", "stream"], rows_per_part)


def write_manifest(rollup: DataFrame, path: str, head: dict) -> None:
    """Write a manifest from ``part_rollup``: a row for each segment and stream; replaced in one step."""
    segments: dict[str, dict] = {}
    for r in rollup.orderBy("segment", "stream").collect():
        entry = {"sealed_parts": r.parts, "rows": r.rows, "dropped": 0, "first_cc_ns": r.first, "last_cc_ns": r.last, "seq_gap_total": r.gap_total, "bytes": r.bytes}
        segments.setdefault(r.segment, {"index": len(segments), "dir": r.segment, "closed_wall_unix_ns": 0, "close_reason": "clean", "streams": {}})["streams"][r.stream] = entry
    Files(rollup.sparkSession, path).replace(path, head | {"segments": list(segments.values())})


def write_parameters(parameters: DataFrame, path: str, head: dict) -> None:
    """Write a vehicle's parameters (id, index, type, value; some thousands at most) by index, with how many came of those expected."""
    found = [r.asDict() for r in parameters.select("id", "index", "type", "value").orderBy("index").collect()]
    expected = head.get("expected_count", len(found))
    Files(parameters.sparkSession, path).replace(path, head | {"expected_count": expected, "received_count": len(found), "complete": len(found) == expected, "params": found})


def write_operations(rows: DataFrame, root: str, rows_per_part: int = 256) -> None:
    """Append rows of the operational log (with a column segment) under root/segment/events, in parts of at most 256 rows."""
    rows = rows.select("segment", F.lit("events").alias("log"), *(F.col(n).cast(t).alias(n) for n, t in OPERATIONS))
    _published(rows, root, ["segment", "log"], max(1, min(rows_per_part, 256)))


def write_timeline(timeline: DataFrame, summary: DataFrame, path: str, findings_only: bool = False) -> None:
    """Under path/summary one JSON object a mission (``replay.summary``), under path/rows one a tick, a folder a mission, in order within a file."""
    summary.write.json(f"{path}/summary")
    rows = timeline.filter("severity <> 'ok'") if findings_only else timeline
    rows.repartition("mission_id").sortWithinPartitions("mission_id", "tick").write.partitionBy("mission_id").json(f"{path}/rows")


def _events(path: str) -> list[dict]:
    with open(path, "rb") as file:
        return tomllib.load(file).get("event", [])


def _time(event: dict) -> int:
    return int(round(event["t_s" if "t_s" in event else "t"] * 1_000_000_000))


def read_scenario(path: str) -> list[tuple[int, str]]:
    """(time in ns, severity) of the events of a TOML scenario, sorted by time, for ``align.step_lookup``."""
    return sorted((_time(e), str(e.get("severity", "ok")).lower()) for e in _events(path))


def read_conclusions(path: str) -> list[dict]:
    """The events of a TOML scenario as conclusions by time: time_ns, severity, action, health_flags, confidence. Names count in any case; a wrong one is a ValueError.

    A scenario is a file of some lines on the driver's disk, as its user writes it.
    """

    def one(kind: str, name: str, known) -> str:
        if str(name).lower() not in known:
            raise ValueError(f"bad {kind} {name!r}")
        return str(name).lower()

    out = []
    for e in _events(path):
        action = one("action", e.get("action", "none"), {*ACTIONS, "warn"})
        flags = 0
        for name in e.get("flags", []):
            flags |= FLAGS[one("flag", name, FLAGS)]
        out.append({"time_ns": _time(e), "severity": one("severity", e["severity"], SEVERITIES), "action": "warn_only" if action == "warn" else action, "health_flags": flags, "confidence": int(e.get("confidence", 100))})
    return sorted(out, key=lambda x: x["time_ns"])
