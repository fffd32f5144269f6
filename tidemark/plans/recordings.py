"""Queries of recording and of reading captures back, over missions and captures that are written from the table events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import STREAMS
from tidemark.plans.adapters import signals
from tidemark.plans.queries import query
from tidemark.sources import captures, frames, recorder, streams
from tidemark.sources.shared import folder

#: Ten days, a third of the events' month.
PERIOD = 864_000_000_000
_PERIOD = f"(t - epoch_us(TIMESTAMP '2024-01-01')) // {PERIOD}"
#: Streams by the events' types, in their order.
KINDS = {"click": "state", "error": "imu", "purchase": "power", "signup": "gps", "view": "actuator"}
#: Messages of the made frames, with the extra bytes of their checks; 77 isn't told.
EXTRAS = {54000: 17, 30: 39}


def _periods(spark, sf_dir: str) -> DataFrame:
    period = F.floor((F.col("t") - F.unix_micros(F.lit("2024-01-01 00:00:00 UTC").cast("timestamp"))) / PERIOD)
    return signals(spark, sf_dir).withColumn("period", period.cast("int"))


class _Dead(Exception):
    pass


_STREAM = "CASE stream " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


@query(f"""SELECT printf('segment_%02d', period) AS segment, ['px4_reboot', 'cc_restart', 'clean'][period + 1] AS close_reason, {_STREAM} AS stream, count(*) AS n, count(*) AS told,
  min(t) * 1000 AS first, max(t) * 1000 AS last, CAST(sum(seq % 3) AS BIGINT) AS gap_total FROM (SELECT *, CAST({_PERIOD} AS INTEGER) AS period FROM sig) GROUP BY ALL""".replace("printf('segment_%02d', period)", "printf('segment_%02d', period + CASE WHEN period = 2 THEN 1 ELSE 0 END)"))
def mission_record(spark, sf_dir):
    """The events as a mission of three batches, each after another boot of the vehicle. The recorder dies while it moves the second one's parts; the next one goes on from there."""
    root = folder(spark, "missions")
    stream = F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, STREAMS[v]))), F.col("stream"))
    rows = _periods(spark, sf_dir).select(
        F.lit(1).cast("long").alias("vehicle_id"), F.lit(1).cast("long").alias("mission_id"), F.col("period").cast("long").alias("px4_boot_id"), F.lit(1).cast("long").alias("cc_boot_id"), stream.cast("short").alias("stream_id"),
        F.col("seq").alias("sequence"), (F.col("t") * 1000).alias("cc_receive_time_ns"), (F.col("seq") % 3).alias("seq_gap"), F.lit(1).cast("short").alias("schema_version"), F.col("value").cast("float").alias("temperature"),
    )
    moves = []

    def dies(step: str) -> None:
        moves.append(step)
        if moves.count("planned") == 2 and step == "moved":
            raise _Dead

    head = {"dialect_hash": "0x1", "schema_version": 1}
    open_ = lambda boot, at: recorder.open_mission(spark, root, 1, boot, head, seconds=PERIOD // 1_000_000, at=at)
    first = open_(0, dies)
    first.append("link", 0, rows.filter("px4_boot_id = 0"))
    try:
        first.append("link", 1, rows.filter("px4_boot_id = 1"))
    except _Dead:
        pass
    second = open_(1, lambda step: None)
    for batch in (0, 1, 2):
        second.append("link", batch, rows.filter(F.col("px4_boot_id") == batch))
    second.finalize()
    segments = second.journal.state["segments"]
    reasons = spark.createDataFrame([(s["dir"], s["close_reason"]) for s in segments], "segment string, close_reason string")
    told = streams.read_manifest(spark, second.folder).filter("rows > 0").select("segment", "stream", F.col("rows").alias("told"))
    disk = None
    for name in KINDS.values():
        df = streams.read_stream(spark, second.folder, name).withColumn("stream", F.lit(name))
        df = df.groupBy("segment", "stream").agg(F.count("*").alias("n"), F.min("cc_receive_time_ns").alias("first"), F.max("cc_receive_time_ns").alias("last"), F.sum("seq_gap").alias("gap_total"))
        disk = df if disk is None else disk.unionByName(df)
    return disk.join(told, ["segment", "stream"], "full").join(F.broadcast(reasons), "segment").select("segment", "close_reason", "stream", "n", "told", "first", "last", "gap_total")


@query(f"""SELECT 'segment_0' || CAST({_PERIOD} AS INTEGER) AS segment, count(*) AS frames, CAST(sum(4 + length(vehicle || ':' || seq) + seq % 40) AS BIGINT) AS bytes, false AS torn FROM sig GROUP BY 1""")
def raw_capture_scan(spark, sf_dir):
    """The events written as length-prefixed records by the tasks that read them, and counted back in byte ranges."""
    path = folder(spark, "raw")
    record = F.concat("vehicle", F.lit(":"), "seq", F.repeat(F.lit("x"), (F.col("seq") % 40).cast("int"))).cast("binary")
    captures.append_raw(_periods(spark, sf_dir).select(F.concat(F.lit("segment_0"), "period").alias("segment"), record.alias("record")), path)
    return streams.raw_captures(spark, path)


_FRAME = "12 + length(CAST(seq AS VARCHAR))"


@query(f"""SELECT 'segment_0' || CAST({_PERIOD} AS INTEGER) AS segment, count(*) FILTER (seq % 11 > 0) AS frames_ok, count(*) FILTER (seq % 11 = 0) AS unknown_frames, CAST(sum({_FRAME}) FILTER (seq % 11 > 0) AS BIGINT) AS ok,
  CAST(sum({_FRAME}) FILTER (seq % 11 = 0) AS BIGINT) AS unknown, CAST(sum(CASE WHEN seq % 11 > 0 THEN seq % 3 ELSE 0 END) AS BIGINT) AS garbage, CAST(sum(seq) FILTER (seq % 11 > 0) AS BIGINT) AS total,
  CAST(sum(vehicle % 200) FILTER (seq % 11 > 0) AS BIGINT) AS systems FROM sig GROUP BY 1""")
def frame_decode(spark, sf_dir):
    """The events as frames of a link, with noise after some and messages that nobody told, decoded in byte ranges with every byte accounted for."""
    path = folder(spark, "wire")
    seq = F.col("seq")
    message = F.when(seq % 11 == 0, 77).when(seq % 2 == 0, 30).otherwise(54000)
    rows = _periods(spark, sf_dir).select(F.concat(F.lit("segment_0"), "period").alias("segment"), message.cast("long").alias("message"), (F.col("vehicle") % 200).cast("int").alias("system"), F.lit(1).alias("component"), seq.alias("sequence"), seq.cast("string").cast("binary").alias("payload"))
    noise = F.repeat(F.lit("~"), F.when(F.col("message") == 77, 0).otherwise(F.col("sequence") % 3).cast("int")).cast("binary")
    captures.append_raw(frames.encode(rows, EXTRAS).withColumn("record", F.concat("record", noise)), path, prefixed=False)
    found, accounts = frames.decode(spark, path, EXTRAS)
    segment = F.regexp_extract("path", r"/(segment_[^/]*)/", 1).alias("segment")
    sums = found.groupBy(segment).agg(F.sum(F.col("payload").cast("string").cast("long")).alias("total"), F.sum(F.col("system").cast("long")).alias("systems"))
    counts = accounts.groupBy(segment).agg(*(F.sum(c).alias(c) for c in ("frames_ok", "unknown_frames", "ok", "unknown", "garbage")))
    return counts.join(sums, "segment")
