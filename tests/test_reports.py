"""Operational logs, health counters, integrity and timeline reports, parameters, branches of one stream."""

import json
import struct

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import aggregates, ingest
from tidemark.plans import integrity, replay, traces
from tidemark.sources import sinks, streams
from tidemark.streaming import live

LOG = [("segment_00", 1, "open", None, None, 0, 900, 0), ("segment_00", 2, "drop", 1, "queue", 0, None, 7), ("segment_00", 3, "drop", None, "raw", 0, None, 2), ("segment_00", 4, "shed", None, "low", 2, 40, 0)]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(LOG, "segment string, cc_receive_time_ns long, kind string, stream_id short, reason string, shed_stage short, free_bytes long, count long")


@pytest.fixture(scope="module")
def mission(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("mission"))
    sinks.write_parts(traces.flights(spark, 1, 2).withColumn("segment", F.lit("segment_00")), root, rows_per_part=20)
    head = {"complete": True, "vehicle_id": 1, "mission_id": 9, "dialect_hash": "0x1", "schema_version": 1}
    sinks.write_manifest(integrity.part_rollup(spark, root, streams.PERIODIC), f"{root}/manifest.json", head)
    return root


def test_operations_come_back_in_small_parts_and_none_without_a_log(spark, log, tmp_path):
    (tmp_path / "segment_00").mkdir()
    assert streams.read_operations(spark, str(tmp_path)).count() == 0
    sinks.write_operations(log.coalesce(1), str(tmp_path), rows_per_part=0)  # one row a part at least
    back = streams.read_operations(spark, str(tmp_path))
    assert sorted(r.kind for r in back.collect()) == ["drop", "drop", "open", "shed"] and {r.segment for r in back.collect()} == {"segment_00"}
    assert len(list((tmp_path / "segment_00" / "events").glob("*.parquet"))) == 4
    assert back.agg(F.sum("count")).first()[0] == 9


def test_health_counters_are_observed_on_the_way(log):
    seen = Observation("health")
    live.observed(log, seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    assert got["dropped_imu"] + got["dropped_state"] == 7 and got["raw_dropped"] == 2 and got["shed_stage"] == 2 and got["free_bytes"] == 40 and got["warn"] is True
    calm = log.filter("kind = 'open'").agg(*aggregates.log_health()).first()
    assert calm.warn is False and calm.raw_dropped == 0 and calm.free_bytes == 900
    assert log.filter("false").agg(*aggregates.log_health()).first().shed_stage is None


def test_report_of_a_mission_tells_rows_drops_and_torn_captures(spark, log, mission, tmp_path):
    rows = json.loads(integrity.report(spark, mission, streams.PERIODIC, "0x1", 1).first().report)
    assert rows["verdict"] == "clean" and rows["issues"] == [] and rows["dialect_hash_ok"] and rows["total_drops"] == 0 and rows["segments"][0]["raw_present"] is False
    assert {s["name"]: s["rows"] for s in rows["segments"][0]["streams"]}["imu"] == 100 and rows["total_rows"] == sum(s["rows"] for s in rows["segments"][0]["streams"])
    sinks.write_operations(log, mission)
    with open(f"{mission}/segment_00/raw_link.bin", "wb") as file:
        file.write(struct.pack("<I", 3) + b"abc" + struct.pack("<I", 9) + b"torn")
    rows = json.loads(integrity.report(spark, mission, streams.PERIODIC, "0x2", 1).first().report)
    one = rows["segments"][0]
    assert rows["verdict"] == "corrupt" and rows["issues"] == ["dialect hash"] and not rows["dialect_hash_ok"] and rows["schema_version_ok"]
    assert (one["drops"], one["raw_frames"], one["raw_torn"]) == (9, 1, True)


def test_unfinished_mission_is_the_newest_open_one_of_each_vehicle(spark):
    df = spark.createDataFrame([(1, 3, False), (1, 5, False), (1, 9, True), (2, 4, True)], "vehicle_id long, mission_id long, complete boolean")
    assert [tuple(r) for r in streams.unfinished_mission(df).collect()] == [(1, 5)]


def test_timeline_report_has_hash_ticks_and_findings(spark, tmp_path):
    rows = [(1, t * 100, "warn" if t == 2 else "ok", "none", 0, 0, 0.0, 0.0, 100) for t in range(4)] + [(2, 100, "ok", "none", 0, 0, 0.0, 0.0, 100)]
    timeline = spark.createDataFrame(rows, "mission_id long, tick long, severity string, action string, health_flags int, detail_code int, value float, limit float, confidence int")
    heads = {r.mission_id: r for r in replay.summary(timeline).collect()}
    assert (heads[1].ticks, heads[1].findings, heads[2].findings) == (4, 1, 0) and len(heads[1].hash) == 64 and heads[1].hash != heads[2].hash
    sinks.write_timeline(timeline, replay.summary(timeline), f"{tmp_path}/all")
    assert [r.tick for r in spark.read.json(f"{tmp_path}/all/rows").filter("mission_id = 1").collect()] == [0, 100, 200, 300]
    assert spark.read.json(f"{tmp_path}/all/summary").count() == 2
    sinks.write_timeline(timeline, replay.summary(timeline), f"{tmp_path}/found", findings_only=True)
    assert [(r.mission_id, r.tick) for r in spark.read.json(f"{tmp_path}/found/rows").collect()] == [(1, 200)]


def test_parameters_are_written_by_index(spark, tmp_path):
    df = spark.createDataFrame([("B", 1, 6, 2.0), ("A", 0, 6, 1.0)], "id string, index int, type int, value double")
    sinks.write_parameters(df, f"{tmp_path}/p.json", {"mode": "download", "expected_count": 3})
    got = json.loads((tmp_path / "p.json").read_text())
    assert [p["id"] for p in got["params"]] == ["A", "B"] and got["received_count"] == 2 and got["complete"] is False


def test_branches_of_one_stream_and_its_status(spark, tmp_path):
    rows = [(5, 0, b"request"), (5, 8, b"reply"), (6, 0, b"safety"), (7, 0, b"other"), (None, 0, b"unknown")]
    frames = spark.createDataFrame(rows, "message int, sent long, payload binary")
    frames.coalesce(1).write.parquet(f"{tmp_path}/in")
    split = [lambda df, i=i: ingest.demux(df, "message", "sent", 5, 6)[i] for i in range(3)]
    branches = {"raw": lambda df: df.select("payload"), **dict(zip(("replies", "telemetry", "acknowledgements"), split))}
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
    query = live.tee(stream, f"{tmp_path}/out", f"{tmp_path}/state", branches)
    query.awaitTermination()
    got = {name: sorted(bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect()) for name in branches}
    assert len(got["raw"]) == 5 and got["replies"] == [b"reply"] and got["acknowledgements"] == [b"safety"] and got["telemetry"] == [b"other", b"safety", b"unknown"]
    assert json.loads(live.status(query))["active"] is False
    live.record(stream, f"{tmp_path}/parts", f"{tmp_path}/state2", ["message"]).awaitTermination()
    live.record(stream, f"{tmp_path}/parts", f"{tmp_path}/state2", ["message"]).awaitTermination()  # a restart repeats nothing
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 5


def test_logarithm_of_what_has_none_is_null(spark):
    got = [r.x for r in spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "v double").select(scalars.ln(F.col("v")).alias("x")).collect()]
    assert got[0] == 0.0 and all(x is None or x != x or x < -100 for x in got[1:])


def test_the_rollup_reads_footers_and_scans_gaps_alone(spark, mission):
    rolled = integrity.part_rollup(spark, mission, streams.PERIODIC)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "part_footers" in plan and "seq_gap" in plan and "ReadSchema: struct<seq_gap:bigint>" in plan and "ReadSchema: struct<cc_receive_time_ns" not in plan
    for name in streams.PERIODIC:
        df = streams.read_stream(spark, mission, name)
        want = df.agg(F.count("*"), F.min("cc_receive_time_ns"), F.max("cc_receive_time_ns"), F.sum("seq_gap"), F.count_distinct(F.col("_metadata.file_path"))).first()
        r = rolled.filter(F.col("stream") == name).first()
        assert (r.rows, r["first"], r["last"], r.gap_total, r.parts) == tuple(want)


def test_parts_without_extremes_in_their_footers_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "segment_00/imu").mkdir(parents=True)
    pq.write_table(pa.table({"cc_receive_time_ns": [5, 3], "seq_gap": [1, 2]}), tmp_path / "segment_00/imu/a.parquet", write_statistics=False)
    pq.write_table(pa.table({"cc_receive_time_ns": [9], "seq_gap": [4]}), tmp_path / "segment_00/imu/b.parquet")
    r = integrity.part_rollup(spark, str(tmp_path), ["imu"]).first()
    assert (r.rows, r["first"], r["last"], r.gap_total, r.parts) == (3, 3, 9, 7, 2)
