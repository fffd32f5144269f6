"""Recording missions so that a recorder may die at any step: a log of numbered entries, staged batches, recovery.

What a mission holds is what its log says. A batch is staged by one Spark write, planned (where each staged file goes and what is in it),
moved, and then told by one entry of the log; entries are numbered and only put where there is none, so of two recorders one goes on and the other
stops. A recorder that opens a mission left unfinished completes a batch that was planned, throws away one that wasn't (its source sends it
again), closes the open segment with what the log knows of it and begins the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import STREAMS
from tidemark.sources.files import Files

#: Why a segment was closed.
CLEAN, RESTART, REBOOT, CAP = "clean", "cc_restart", "px4_reboot", "rotation_cap"
NANOS = 1_000_000_000
#: Entries after which the log gets a summary, so that reading it takes one file and fewer than this many entries.
SUMMARY = 25


class Superseded(RuntimeError):
    """Another recorder has gone on with this mission."""


class BelowFloor(RuntimeError):
    """Too little space is left to begin recording."""


class Journal:
    """The numbered entries of a mission and the state that they add up to."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder, self.next, self.state = files, f"{folder}/_log", 0, {}

    def _name(self, number: int, kind: str = "entry") -> str:
        return f"{self.folder}/{number:012d}.{kind}.json"

    def read(self) -> Journal:
        names = self.files.names(self.folder)
        sums = [n for n in names if n.endswith(".summary.json")]
        self.next, self.state = 0, {}
        if sums:
            self.next, self.state = int(sums[-1][:12]) + 1, self.files.read(f"{self.folder}/{sums[-1]}")
        for name in names:
            if name.endswith(".entry.json") and int(name[:12]) >= self.next:
                self.state = folded(self.state, self.files.read(f"{self.folder}/{name}"))
                self.next = int(name[:12]) + 1
        return self

    def add(self, entry: dict, number: int | None = None) -> None:
        number = self.next if number is None else number
        if number != self.next or not self.files.put(self._name(number), entry):
            raise Superseded(self._name(number))
        self.state, self.next = folded(self.state, entry), number + 1
        if self.next % SUMMARY == 0:
            self.files.put(self._name(number, "summary"), self.state)


def folded(state: dict, entry: dict) -> dict:
    """The state after an entry: the head, the segments with rows, parts, gaps, bytes and times of each stream, and the last batch of each source."""
    head = entry.get("head", state.get("head"))
    segments = [{**s, "streams": {k: dict(v) for k, v in s["streams"].items()}} for s in state.get("segments", [])]
    for change in entry.get("segments", []):
        if change["index"] == len(segments):
            segments.append({"streams": {}, "closed_wall_unix_ns": None, "close_reason": None} | change)
        else:
            segments[change["index"]] |= change
    for f in entry.get("files", []):
        own = segments[f["segment"]]["streams"].setdefault(f["stream"], {"sealed_parts": 0, "rows": 0, "dropped": 0, "first_cc_ns": f["first"], "last_cc_ns": f["last"], "seq_gap_total": 0, "bytes": 0})
        own |= {"sealed_parts": own["sealed_parts"] + 1, "rows": own["rows"] + f["rows"], "seq_gap_total": own["seq_gap_total"] + f["gaps"], "bytes": own["bytes"] + f["bytes"]}
        own |= {"first_cc_ns": min(own["first_cc_ns"], f["first"]), "last_cc_ns": max(own["last_cc_ns"], f["last"])}
    batches = dict(state.get("batches", {}))
    if "batch" in entry:
        batches[entry["source"]] = entry["batch"]
    return {"head": head, "segments": segments, "batches": batches, "cc_boot_id": entry.get("cc_boot_id", state.get("cc_boot_id", 0)), "complete": entry.get("complete", state.get("complete", False))}


class Recorder:
    """One recorder of one mission. ``open_mission`` makes it; ``append`` batches, then ``finalize``."""

    def __init__(self, spark: SparkSession, files: Files, folder: str, journal: Journal, caps: dict, clock: Callable[[], int], at: Callable[[str], None]):
        self.spark, self.files, self.folder, self.journal, self.caps, self.clock, self._at = spark, files, folder, journal, caps, clock, at

    @property
    def mission_id(self) -> int:
        return self.journal.state["head"]["mission_id"]

    def _segment(self, index: int, boot: int, opened: int) -> dict:
        for stream in STREAMS:
            self.files.make(f"{self.folder}/segment_{index:02d}/{stream}")
        return {"index": index, "dir": f"segment_{index:02d}", "cc_boot_id": self.journal.state["cc_boot_id"], "px4_boot_id": boot, "opened_wall_unix_ns": self.clock(), "opened_cc_ns": opened}

    def _manifest(self) -> None:
        state = self.journal.state
        self.files.replace(f"{self.folder}/manifest.json", {"manifest_version": 1, "complete": state["complete"], **state["head"], "segments": state["segments"]})

    def refresh(self) -> None:
        """Write the manifest of a mission again if its recorder died before it did."""
        name = f"{self.folder}/manifest.json"
        if not self.files.exists(name) or not self.files.read(name)["complete"]:
            self._manifest()

    def _dealt(self, rows: DataFrame) -> tuple[DataFrame, list[dict]]:
        """The rows with the segment each goes to, and the segments that close and open: another boot or ``seconds`` of a segment begin a new one.

        Boots follow one another by their first time; rows from before a segment was opened, or of a boot that has gone, go to the one that is open.
        """
        current = self.journal.state["segments"][-1]
        boots = rows.groupBy("px4_boot_id").agg(F.min("cc_receive_time_ns").alias("first"), F.max("cc_receive_time_ns").alias("last")).orderBy("first", "px4_boot_id").collect()  # boots of one batch
        gone = {s["px4_boot_id"] for s in self.journal.state["segments"][:-1]} - {current["px4_boot_id"]}
        span = self.caps["seconds"] * NANOS
        changes, index, opened, boot = [], current["index"], current["opened_cc_ns"], current["px4_boot_id"]
        segment = F.lit(index)
        for b in sorted((b for b in boots if b["px4_boot_id"] not in gone), key=lambda b: (b["px4_boot_id"] != boot, b["first"])):
            if opened is None or b["px4_boot_id"] != boot:
                if b["px4_boot_id"] != boot:
                    changes.append({"index": index, "closed_wall_unix_ns": self.clock(), "close_reason": REBOOT})
                    index += 1
                    changes.append(self._segment(index, b["px4_boot_id"], b["first"]))
                else:
                    changes.append({"index": index, "opened_cc_ns": b["first"]})
                opened, boot = b["first"], b["px4_boot_id"]
            more = F.greatest(F.floor((F.col("cc_receive_time_ns") - opened) / span), F.lit(0))
            segment = F.when(F.col("px4_boot_id") == boot, index + more).otherwise(segment)
            for _ in range(max(b["last"] - opened, 0) // span):
                changes.append({"index": index, "closed_wall_unix_ns": self.clock(), "close_reason": CAP})
                index, opened = index + 1, opened + span
                changes.append(self._segment(index, boot, opened))
        return rows.withColumn("segment", segment.cast("int")), changes

    def append(self, source: str, batch: int, rows: DataFrame) -> bool:
        """Record the rows of one batch (telemetry with stream_id, px4_boot_id and cc_receive_time_ns); False if they are there already.

        Batches of a source come in order and, after a failure, again with the same rows, as micro-batches do. Rows of an unknown stream or without a time
        are left out, as they have no part to go to.
        """
        if batch <= self.journal.state["batches"].get(source, -1):
            return False
        stream = F.element_at(F.create_map(*(F.lit(x) for name, i in STREAMS.items() for x in (i, name))), F.col("stream_id").cast("int"))
        known = rows.withColumn("stream", stream).filter(F.col("stream").isNotNull() & F.col("cc_receive_time_ns").isNotNull())
        dealt, changes = self._dealt(known)
        staged = f"{self.folder}/_staged/{source}-{batch}"
        self.files.delete(staged)
        dealt.write.option("maxRecordsPerFile", self.caps["rows"]).partitionBy("segment", "stream").parquet(f"{staged}/rows")
        self._at("staged")
        files = []
        if any(n.startswith("segment=") for n in self.files.names(f"{staged}/rows")):
            read = self.spark.read.parquet(f"{staged}/rows")
            of_file = read.groupBy("segment", "stream", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(
                F.count("*").alias("rows"), F.min("cc_receive_time_ns").alias("first"), F.max("cc_receive_time_ns").alias("last"), F.coalesce(F.sum("seq_gap"), F.lit(0)).cast("long").alias("gaps")
            )
            for n, f in enumerate(of_file.orderBy("segment", "stream", "path").collect()):  # one row a file
                to = f"{self.folder}/segment_{f.segment:02d}/{f.stream}/{source}-{batch:08d}-{n:05d}.parquet"
                files.append({"from": f"{staged}/rows/segment={f.segment}/stream={f.stream}/{f.path.rpartition('/')[2]}", "to": to, **{k: f[k] for k in ("segment", "stream", "rows", "first", "last", "gaps", "bytes")}})
        plan = {"number": self.journal.next, "entry": {"source": source, "batch": batch, "segments": changes, "files": files}}
        self.files.replace(f"{staged}/plan.json", plan)
        self._at("planned")
        self._publish(staged, plan)
        if sum(s["bytes"] for s in self.journal.state["segments"][-1]["streams"].values()) >= self.caps["bytes"]:
            last = self.journal.state["segments"][-1]
            opening = self._segment(last["index"] + 1, last["px4_boot_id"], None)
            self.journal.add({"segments": [{"index": last["index"], "closed_wall_unix_ns": self.clock(), "close_reason": CAP}, opening]})
            self._manifest()
        return True

    def _publish(self, staged: str, plan: dict) -> None:
        for f in plan["entry"]["files"]:
            self.files.move(f["from"], f["to"])
            self._at("moved")
        self.journal.add(plan["entry"], plan["number"])
        self._at("told")
        self._manifest()
        self._at("manifest")
        self.files.delete(staged)

    def recover(self) -> None:
        """Complete a planned batch, drop what is staged besides."""
        for name in self.files.names(f"{self.folder}/_staged"):
            staged = f"{self.folder}/_staged/{name}"
            plan = self.files.read(f"{staged}/plan.json") if self.files.exists(f"{staged}/plan.json") else None
            if plan is not None and plan["number"] == self.journal.next and plan["entry"]["batch"] > self.journal.state["batches"].get(plan["entry"]["source"], -1):
                self._publish(staged, plan)
            else:
                self.files.delete(staged)

    def sink(self, source: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a micro-batch that runs again after a failure is recorded once."""
        return lambda rows, batch: self.append(source, batch, rows) and None

    def finalize(self) -> None:
        """Close the open segment and the mission."""
        last = self.journal.state["segments"][-1]
        self.journal.add({"segments": [{"index": last["index"], "closed_wall_unix_ns": self.clock(), "close_reason": CLEAN}], "complete": True})
        self._at("completed")
        self._manifest()


def open_mission(
    spark: SparkSession, root: str, vehicle_id: int, px4_boot_id: int, head: dict, seconds: int = 1800, size: int = 512 << 20, rows_per_part: int = 100_000,
    free: int | None = None, floor: int = 0, clock: Callable[[], int] = time.time_ns, at: Callable[[str], None] = lambda step: None,
) -> Recorder:
    """A recorder of the newest mission of a vehicle under ``root`` that isn't complete, else of a new one.

    ``head``: dialect_hash, schema_version and whatever the manifest's head should tell. A segment is closed after ``seconds`` of data, or once it has ``size``
    bytes. ``free`` bytes below ``floor`` raise BelowFloor. ``at`` is called after each step with its name (for tests that die there).
    """
    if free is not None and free < floor:
        raise BelowFloor(f"{free} bytes free, {floor} needed")
    files = Files(spark, root)
    caps = {"seconds": seconds, "bytes": size, "rows": rows_per_part}
    missions = [n for n in files.names(root) if n.startswith("mission_") and n[8:].isdigit()]
    for name in reversed(missions):
        journal = Journal(files, f"{root}/{name}").read()
        if not journal.state or journal.state["head"]["vehicle_id"] != vehicle_id:
            continue
        recorder = Recorder(spark, files, f"{root}/{name}", journal, caps, clock, at)
        if journal.state["complete"]:
            recorder.refresh()
            continue
        recorder.recover()
        last = journal.state["segments"][-1]
        at("recovered")
        closing = [] if last["closed_wall_unix_ns"] is not None else [{"index": last["index"], "closed_wall_unix_ns": clock(), "close_reason": RESTART}]
        journal.state["cc_boot_id"] += 1
        opening = recorder._segment(last["index"] + 1, px4_boot_id, None)
        journal.add({"cc_boot_id": journal.state["cc_boot_id"], "segments": [*closing, opening]})
        at("resumed")
        recorder._manifest()
        return recorder
    number = int(missions[-1][8:]) + 1 if missions else 1
    while True:
        folder = f"{root}/mission_{number:06d}"
        journal = Journal(files, folder)
        journal.state = {"cc_boot_id": 1}
        recorder = Recorder(spark, files, folder, journal, caps, clock, at)
        files.make(journal.folder)
        first = {"head": {"vehicle_id": vehicle_id, "mission_id": number, "created_wall_unix_ns": clock(), **head}, "cc_boot_id": 1}
        try:
            journal.add(first | {"segments": [recorder._segment(0, px4_boot_id, None)]})
        except Superseded:  # another recorder took the number
            number += 1
            continue
        at("opened")
        recorder._manifest()
        return recorder


def recorded(spark: SparkSession, mission: str, stream: str) -> DataFrame:
    """The rows of one stream that the log of a mission folder tells, whatever else lies in it; a batch is seen whole or not at all."""
    from tidemark.sources.streams import schema

    entries = spark.read.schema("files array<struct<to: string, stream: string>>").option("multiLine", True).option("pathGlobFilter", "*.entry.json").json(f"{mission}/_log")
    told = [r.to for r in entries.select(F.inline("files")).filter(F.col("stream") == stream).select("to").collect()]  # one row a part
    return spark.read.schema(schema(stream)).parquet(*told) if told else spark.createDataFrame([], schema(stream))
