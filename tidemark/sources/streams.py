"""Recorded missions: schemas, sealed parts, manifests, raw captures."""

from __future__ import annotations

import struct
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ingest import STREAMS
from tidemark.sources.captures import RANGE, byte_ranges
from tidemark.sources.shared import stored
from tidemark.sources.stitch import entered

_F3, _F4, _F8 = (T.ArrayType(T.FloatType()) for _ in range(3))
_L, _I, _S, _F = T.LongType(), T.IntegerType(), T.ShortType(), T.FloatType()

#: Columns that every stream has, and those of each stream. Unsigned types are read one size up.
ENVELOPE = [
    ("vehicle_id", _L), ("mission_id", _L), ("px4_boot_id", _L), ("cc_boot_id", _L), ("stream_id", _S), ("sequence", _L),
    ("fc_timestamp_us", T.DecimalType(20, 0)), ("cc_receive_time_ns", _L), ("seq_gap", _L), ("age_ns", _L), ("age_locked", T.BooleanType()), ("schema_version", _S),
]
PAYLOAD = {
    "state": [("failsafe_flags", _L), ("q", _F4), ("angular_velocity", _F3), ("position_ned", _F3), ("velocity_ned", _F3), ("heading", _F), ("nav_state", _S), ("arming_state", _S), ("vehicle_type", _S), ("estimator_valid", _S), ("control_mode_flags", _S)],
    "imu": [("clipping_count", _L), ("accel", _F3), ("gyro", _F3), ("delta_angle", _F3), ("delta_velocity", _F3), ("vibration_metric", _F3), ("temperature", _F)],
    "power": [("voltage", _F), ("current", _F), ("power", _F), ("consumed_mah", _F), ("remaining", _F), ("temperature", _F), ("cell_count", _S), ("warning", _S), ("connected", _S)],
    "gps": [("lat", _I), ("lon", _I), ("alt", _I), ("eph", _F), ("epv", _F), ("ground_speed", _F), ("heading", _F), ("noise_per_ms", _I), ("jamming_indicator", _I), ("fix_type", _S), ("satellites_used", _S)],
    "estimator": [("status_flags", _L), ("velocity_test_ratio", _F), ("position_test_ratio", _F), ("height_test_ratio", _F), ("mag_test_ratio", _F), ("airspeed_test_ratio", _F), ("innovation_check_flags", _I), ("solution_status_flags", _I)],
    "actuator": [("actuator_output", _F8), ("motor_count", _S)],
    "event": [("event_id", _L), ("argument0", _L), ("argument1", _L), ("severity", _S), ("subsystem", _S)],
    "safety_status": [("last_report_sequence", _L), ("active_health_flags", _L), ("report_age_ms", _L), ("missed_reports", _L), ("companion_state", _S), ("action_taken", _S), ("reject_reason", _S)],
}
OPERATIONS = [("cc_receive_time_ns", _L), ("kind", T.StringType()), ("stream_id", _S), ("reason", T.StringType()), ("shed_stage", _S), ("free_bytes", T.DecimalType(20, 0)), ("count", T.DecimalType(20, 0))]
PERIODIC = ["state", "imu", "power", "gps", "estimator", "actuator"]


def schema(stream: str) -> T.StructType:
    """The columns of a stream's parts; only sequence and age_ns may be null in valid data."""
    return T.StructType([T.StructField(n, t) for n, t in [*ENVELOPE, *PAYLOAD[stream]]])


def read_stream(spark: SparkSession, root: str, stream: str, segments: str = "segment_*") -> DataFrame:
    """The sealed parts of one stream of a mission folder, with the segment each row came from. Parts still being written are left out."""
    read = spark.read.schema(schema(stream)).option("pathGlobFilter", "*.parquet")
    df = read.parquet(f"{root}/{segments}/{stream}")
    widened = {n: F.col(n).cast("long") for n, t in [*ENVELOPE, *PAYLOAD[stream]] if isinstance(t, T.DecimalType)}
    return df.withColumns(widened).withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"/(segment_[^/]*)/", 1))


def read_mission(spark: SparkSession, root: str, streams: list[str] | None = None) -> DataFrame:
    """The periodic streams of a mission in one wide table; columns of the same name and type are shared between streams."""
    frames = [read_stream(spark, root, s) for s in streams or PERIODIC]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each segment and stream of a mission's manifest."""
    stream = "struct<sealed_parts:long,rows:long,dropped:long,first_cc_ns:long,last_cc_ns:long,seq_gap_total:long,bytes:long>"
    segment = f"array<struct<index:long,dir:string,cc_boot_id:long,px4_boot_id:long,closed_wall_unix_ns:long,close_reason:string,streams:map<string,{stream}>>>"
    head = spark.read.schema(f"complete boolean, vehicle_id long, mission_id long, dialect_hash string, schema_version long, segments {segment}")
    rows = head.option("multiLine", True).json(f"{root}/manifest.json").select("*", F.explode_outer("segments").alias("s")).drop("segments")
    rows = rows.select("*", F.explode_outer("s.streams").alias("stream", "e"))
    closed = F.col("s.closed_wall_unix_ns").isNotNull() & F.col("s.close_reason").isNotNull()
    return rows.select("vehicle_id", "mission_id", "complete", "dialect_hash", "schema_version", F.col("s.dir").alias("segment"), "s.cc_boot_id", "s.px4_boot_id", closed.alias("closed"), "stream", "e.*")


def unfinished_mission(manifests: DataFrame) -> DataFrame:
    """The newest mission of each vehicle that isn't complete."""
    return manifests.filter("not complete").groupBy("vehicle_id").agg(F.max("mission_id").alias("mission_id"))


def in_progress(spark: SparkSession, root: str) -> DataFrame:
    """How many parts of each segment are still being written (or were when the recorder died)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.inprogress").option("recursiveFileLookup", True).load(root)
    segment = F.regexp_extract("path", r"/(segment_[^/]*)/", 1)
    return files.select(segment.alias("segment")).groupBy("segment").agg(F.count("*").alias("parts"))


def _prefix_maps(size: int, longest: int):
    """Ranges -> (path, range, low, high, leaves, into, frames, end): for each entry, how many records begin in the range and where the chain leaves it, or ends
    (``end``: the place after the last whole record)."""

    def walk(data: bytes, at: int, left: int, whole: int, known: dict[int, tuple]) -> tuple:
        """Where the chain from ``at`` gets, with frames counted; every place on the way is remembered."""
        way = []
        while at not in known:
            if at >= left:
                known[at] = (at, 0, None)
            elif at + 4 > whole or at + 4 + (n := struct.unpack_from("<I", data, at)[0]) > whole:
                known[at] = (None, 0, at)
            else:
                way.append(at)
                at += 4 + n
        leaves, frames, end = known[at]
        for back in reversed(way):
            frames += 1
            known[back] = (leaves, frames, end)
        return leaves, frames, end

    def maps(batches):
        for batch in batches:
            out = []
            asked = batch.column("asked").to_pylist() if "asked" in batch.schema.names else [None] * batch.num_rows
            for path, number, at, total, data, more in zip(*(batch.column(c).to_pylist() for c in ("path", "range", "at", "size", "data")), asked):
                left, whole, known = min(size, total - at), total - at, {}
                entries = range(min(left, longest + 4 if number else 1)) if more is None else more
                for e in entries:
                    leaves, frames, end = walk(data, e, left, whole, known)
                    over = leaves is not None and at + leaves >= total
                    out.append((path, number, e, e, None if leaves is None or over else (at + leaves) % size, None if leaves is None or over else (at + leaves) // size, frames, total if over else None if end is None else at + end))
            columns = list(zip(*out)) or [()] * 8
            names = ["path", "range", "low", "high", "leaves", "into", "frames", "end"]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(names, columns)})

    return maps


def raw_frames(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE, longest: int = 508) -> DataFrame:
    """Length-prefixed captures under a path -> path, frames, bytes, torn: records that are whole, their bytes with prefixes, and whether bytes are left over.

    Ranges of ``size`` bytes are walked apart from one another, each from all entries that a record of up to ``longest`` bytes may lead to, and then stitched;
    a longer record costs one more round for its file, which walks only the range it leads to. Empty files have no row.
    """
    ranges = byte_ranges(spark, path, pattern, size, 4)
    kinds = "path string, range long, low long, high long, leaves long, into long, frames long, end long"
    maps = stored(ranges.mapInArrow(_prefix_maps(size, longest), kinds), "record-maps")
    while True:
        way = stored(entered(maps), "record-way")
        own = maps.join(way.select("path", "range", "low"), ["path", "range", "low"])
        known = maps.select("path", F.col("range").alias("into"), F.col("low").alias("leaves"))
        asked = own.filter("into is not null").join(known, ["path", "into", "leaves"], "left_anti").groupBy("path", F.col("into").alias("range")).agg(F.collect_set("leaves").alias("asked"))  # one entry a file
        asked = stored(asked, "record-asked")
        if asked.isEmpty():
            return own.groupBy("path").agg(F.sum("frames").alias("frames"), F.max("end").alias("bytes")).join(ranges.select("path", "size").distinct(), "path").select("path", "frames", "bytes", (F.col("bytes") < F.col("size")).alias("torn"))
        more = ranges.join(F.broadcast(asked), ["path", "range"]).mapInArrow(_prefix_maps(size, longest), kinds)
        maps = stored(maps.unionByName(more), "record-maps")


def stream_id(name: str) -> int:
    return STREAMS[name]


def raw_captures(spark: SparkSession, root: str, size: int = RANGE) -> DataFrame:
    """Whole frames of each segment's raw captures, their bytes, and whether bytes are left over; no row for a segment without one."""
    segment = F.regexp_extract("path", r"/(segment_[^/]*)/", 1)
    found = raw_frames(spark, root, "raw_*.bin", size)
    return found.groupBy(segment.alias("segment")).agg(F.sum("frames").alias("frames"), F.sum("bytes").alias("bytes"), F.bool_or("torn").alias("torn"))


def read_operations(spark: SparkSession, root: str, segments: str = "segment_*") -> DataFrame:
    """The operational log of a mission folder (openings, drops, shed stages), with the segment each row came from; no rows where there is no log."""
    fields = T.StructType([T.StructField(n, t) for n, t in OPERATIONS])
    try:
        df = spark.read.schema(fields).option("pathGlobFilter", "*.parquet").parquet(f"{root}/{segments}/events")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields.add("segment", "string"))
    return df.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"/(segment_[^/]*)/", 1))
