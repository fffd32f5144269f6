"""Lanes on made flights, replay, integrity and the streaming path."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregates import timeline_diff
from tidemark.plans import integrity, replay, traces
from tidemark.sources import streams
from tidemark.streaming import live


@pytest.fixture(scope="module")
def timeline(spark):
    return replay.replay(traces.fault_flights(spark)).cache()


def worst(timeline, mission):
    rows = timeline.filter((F.col("mission_id") == mission) & (F.col("severity") != "ok")).select("severity", "action", "detail_code").distinct().collect()
    return {tuple(r) for r in rows}


def test_a_calm_flight_has_no_finding(timeline):
    assert worst(timeline, 0) == set()
    assert timeline.filter("mission_id = 0").count() == 449


@pytest.mark.parametrize(
    "mission, want",
    [
        (1, ("critical", "land", 6001)), (2, ("warn", "warn_only", 4003)), (3, ("critical", "land", 5008)), (4, ("critical", "land", 3005)), (5, ("warn", "warn_only", 2005)), (6, ("warn", "warn_only", 7001)), (7, ("warn", "warn_only", 6003)),
    ],
)
def test_each_fault_is_found(timeline, mission, want):
    assert want in worst(timeline, mission)


def test_warm_up_lasts_twenty_seconds(timeline):
    first = timeline.filter("mission_id = 0 and health_flags = 0").agg(F.min("tick")).first()[0]
    assert first == 20_000_000_000


def test_replay_repeats_itself(spark):
    hashes = [{tuple(r) for r in replay.timeline_hash(replay.replay(traces.flights(spark, 2, 20))).collect()} for _ in range(2)]
    assert hashes[0] == hashes[1] and len(hashes[0]) == 2


def test_a_boot_begins_anew(spark):
    boot = F.when(F.col("t") < 25_000_000_000, 7).otherwise(8)
    found = replay.lane_findings(traces.flights(spark, 1, 40, boot=boot)).filter("lane = 'battery'")
    by_tick = {r.tick // 100_000_000: (r.availability, r.detail_code) for r in found.collect()}
    assert by_tick[240] == ("available", 0) and by_tick[260] == ("degraded", 9001)


def test_a_missing_stream_is_stale_and_an_unlocked_clock_is_flagged(spark):
    df = traces.flights(spark, 1, 30).filter("not (stream_id = 3 and cc_receive_time_ns > 10000000000)").withColumn("age_locked", F.lit(False))
    last = replay.lane_findings(df).filter("lane = 'gps'").orderBy(F.desc("tick")).first()
    assert (last.availability, last.detail_code) == ("unavailable", 9002)
    assert replay.replay(df).orderBy(F.desc("tick")).first().health_flags == 512 + 1024


def test_timelines_differ_where_they_do(spark, timeline):
    a = timeline.filter("mission_id = 0").withColumn("ordinal", F.floor(F.col("tick") / 100_000_000))
    b = a.withColumn("severity", F.when(F.col("ordinal") == 7, "warn").otherwise(F.col("severity"))).filter("ordinal < 449")
    got = timeline_diff(a, b, ["mission_id"], "ordinal").collect()
    assert sorted(r.ordinal for r in got) == [7, 449]


def write_mission(spark, root, rows_in_manifest=None, complete=True):
    df = traces.flights(spark, 1, 2)
    entries = {}
    for name in streams.PERIODIC:
        part = df.filter(F.col("stream_id") == streams.stream_id(name)).select([f.name for f in streams.schema(name).fields])
        part.coalesce(1).write.parquet(f"{root}/segment_00/{name}")
        n = part.count()
        entries[name] = {"sealed_parts": 1, "rows": (rows_in_manifest or {}).get(name, n), "dropped": 0, "seq_gap_total": 0, "bytes": 1}
    manifest = {"complete": complete, "vehicle_id": 1, "mission_id": 5, "dialect_hash": "0xabc", "schema_version": 1,
                "segments": [{"index": 0, "dir": "segment_00", "cc_boot_id": 1, "px4_boot_id": 7, "closed_wall_unix_ns": 1, "close_reason": "clean", "streams": entries}]}
    (root / "manifest.json").write_text(json.dumps(manifest))


def test_missions_read_back_and_replay_alike(spark, tmp_path):
    write_mission(spark, tmp_path)
    read = streams.read_mission(spark, str(tmp_path))
    assert read.count() == traces.flights(spark, 1, 2).count()
    a, b = (replay.timeline_hash(replay.replay(x)).first().sha256 for x in (read.drop("segment"), traces.flights(spark, 1, 2)))
    assert a == b


@pytest.mark.parametrize(
    "change, want", [({}, ("clean", "")), ({"rows_in_manifest": {"imu": 3}}, ("dirty", "segment_00/imu/rows")), ({"complete": False}, ("dirty", "not complete"))]
)
def test_inspection(spark, tmp_path, change, want):
    write_mission(spark, tmp_path, **change)
    got = integrity.inspect(spark, str(tmp_path), streams.PERIODIC, "0xabc", 1).first()
    assert (got.verdict, got.reasons) == want
    assert integrity.inspect(spark, str(tmp_path), streams.PERIODIC, "0xdef", 1).first().verdict == "corrupt"


def test_parts_in_progress_make_a_mission_dirty(spark, tmp_path):
    write_mission(spark, tmp_path)
    (tmp_path / "segment_00/imu/000009.parquet.inprogress").write_bytes(b"x")
    assert integrity.inspect(spark, str(tmp_path), streams.PERIODIC, "0xabc", 1).first().reasons == "segment_00/in progress"


def test_raw_captures(spark, tmp_path):
    frame = lambda b: len(b).to_bytes(4, "little") + b
    (tmp_path / "a.bin").write_bytes(frame(b"abc") + frame(b""))
    (tmp_path / "b.bin").write_bytes(frame(b"abc") + b"\x09\x00")
    got = {r.path.rpartition("/")[2]: (r.frames, r.torn) for r in streams.raw_frames(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (2, False), "b.bin": (1, True)}


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streaming_counters_and_watchdog(spark, tmp_path):
    rows = [("a", 0.1), ("b", 0.5), ("a", 1.0), ("a", 1.5), ("a", 30.0), ("c", 60.0)]
    schema = "stream string, ts timestamp, seq_gap long"
    for i, (s, t) in enumerate(rows):
        spark.createDataFrame([(s, t)], "stream string, s double").select("stream", F.timestamp_seconds("s").alias("ts"), F.lit(1).cast("long").alias("seq_gap")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run_stream(live.counters(source, ["stream"], every="10 seconds", late="0 seconds"), "counted")
    got = {(r.stream, r.at.timestamp()): r.rows for r in spark.table("counted").collect()}
    assert got[("a", 0.0)] == 3 and got[("b", 0.0)] == 1
    run_stream(live.watchdog(source, ["stream"], 1000), "watched")
    got = [(r.stream, r.state, r.at_ms) for r in spark.table("watched").collect()]
    assert ("b", "stale", 4500) in got and ("a", "stale", 5500) in got and ("a", "fresh", 30000) in got


def test_streaming_ewma_equals_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, 10 * i + j, float(j * i)) for j in range(4)], "k long, i long, x double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("k long, i long, x double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run_stream(live.running_ewma(source, ["k"], "i", "x", 0.3), "smoothed")
    from tidemark.operators.scans import ewma

    batch = {r.i: r.ewma for r in ewma(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), ["k"], ["i"], "x", 0.3).collect()}
    assert {r.i: r.ewma for r in spark.table("smoothed").collect()} == batch


def test_lanes_carry_what_they_read_and_ticks_need_no_second_pass(spark):
    from tidemark.operators import align
    from tidemark.operators.scans import ewma
    from tidemark.plans import lanes

    df = lanes.prepared(traces.flights(spark, 1, 2))
    assert not {"q", "accel", "gyro", "angular_velocity", "velocity_ned"} & set(df.columns)
    scanned = ewma(df.select("mission_id", "t", F.col("throttle").alias("x")), ["mission_id"], ["t"], "x", 0.1)
    once, twice = (align.at_ticks(scanned, ["mission_id"], "t", ["t"], ["ewma"], span=span) for span in (df, None))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert once.orderBy("tick").collect() == twice.orderBy("tick").collect()
