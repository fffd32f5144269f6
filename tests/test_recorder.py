"""Missions recorded in batches by recorders that die at any step."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.plans import integrity, traces
from tidemark.sources import files, recorder, streams

HEAD = {"dialect_hash": "0x1", "schema_version": 1}
STEPS = ["opened", "staged", "planned", "moved", "told", "manifest", "recovered", "resumed", "completed"]


class Killed(Exception):
    pass


def killing(step, times):
    """Raises at a step, that often."""
    left = [times]

    def at(name):
        if name == step and left[0]:
            left[0] -= 1
            raise Killed(name)

    return at


@pytest.fixture(scope="module")
def flight(spark, tmp_path_factory):
    """Four seconds of one flight in two batches, the second with another boot; read from files, as a source that sends batches again would."""
    path = str(tmp_path_factory.mktemp("flight") / "rows")
    boot = F.when(F.col("t") < 3_000_000_000, 7).otherwise(8)
    traces.flights(spark, 1, 4, boot=boot).coalesce(2).write.parquet(path)
    df = spark.read.parquet(path)
    return [df.filter("cc_receive_time_ns < 2000000000"), df.filter("cc_receive_time_ns >= 2000000000")]


def told(spark, mission):
    return sorted(tuple(r) for s in streams.PERIODIC for r in recorder.recorded(spark, mission, s).select("stream_id", "cc_receive_time_ns", "px4_boot_id").collect())


def sent(flight):
    return sorted(tuple(r) for f in flight for r in f.select("stream_id", "cc_receive_time_ns", "px4_boot_id").collect())


def record(spark, root, flight, at, tries):
    """As a supervisor would: open, send all batches, finalize; again from the start after each death."""
    for n in range(tries):
        try:
            r = recorder.open_mission(spark, root, 1, 7, HEAD, at=at)
            for i, f in enumerate(flight):
                r.append("link", i, f)
            r.finalize()
            return n
        except Killed:
            pass
    raise AssertionError("never done")


@pytest.mark.parametrize("step", STEPS)
def test_no_row_is_lost_or_repeated_wherever_a_recorder_dies(spark, tmp_path, flight, step):
    at = killing(step, 1 if step == "completed" else 2)
    if step in ("recovered", "resumed"):
        with pytest.raises(Killed):
            r = recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD, at=killing("moved", 1))
            r.append("link", 0, flight[0])
    deaths = record(spark, str(tmp_path), flight, at, 4)
    assert deaths == (1 if step in ("opened", "completed") else 2)
    missions = sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("mission_"))
    assert missions == (["mission_000001", "mission_000002"] if step == "completed" else ["mission_000001"])
    mission = f"{tmp_path}/mission_000001"
    assert told(spark, mission) == sent(flight)
    read = streams.read_mission(spark, mission)
    assert read.count() == len(sent(flight)) and not list(tmp_path.glob("mission_*/_staged/*"))
    for mission in missions:
        assert tuple(integrity.inspect(spark, f"{tmp_path}/{mission}", streams.PERIODIC, "0x1", 1).select("verdict", "reasons").first()) == ("clean", "")


def test_a_restart_closes_the_segment_that_was_open(spark, tmp_path, flight):
    first = recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD)
    first.append("link", 0, flight[0])
    mission = f"{tmp_path}/mission_000001"
    before = integrity.inspect(spark, mission, streams.PERIODIC, "0x1", 1).first()
    assert before.verdict == "dirty" and "not complete" in before.reasons
    second = recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD)
    assert second.mission_id == first.mission_id == 1
    assert not second.append("link", 0, flight[0]) and second.append("link", 1, flight[1])
    second.finalize()
    reasons = [s["close_reason"] for s in second.journal.state["segments"]]
    assert reasons == ["cc_restart", "px4_reboot", "clean"] and [s["cc_boot_id"] for s in second.journal.state["segments"]] == [1, 2, 2]
    with pytest.raises(recorder.Superseded):
        first.append("link", 1, flight[1])
    assert told(spark, mission) == sent(flight)
    assert recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD).mission_id == 2


def test_other_vehicles_and_the_floor(spark, tmp_path):
    assert recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD).mission_id == 1
    assert recorder.open_mission(spark, str(tmp_path), 2, 7, HEAD).mission_id == 2
    assert recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD).mission_id == 1
    with pytest.raises(recorder.BelowFloor):
        recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD, free=9, floor=10)


def test_segments_close_by_time_and_by_size(spark, tmp_path, flight):
    r = recorder.open_mission(spark, str(tmp_path / "time"), 1, 7, HEAD, seconds=1)
    for i, f in enumerate(flight):
        r.append("link", i, f)
    r.finalize()
    assert [s["close_reason"] for s in r.journal.state["segments"]] == ["rotation_cap", "rotation_cap", "px4_reboot", "clean"]
    rows = streams.read_stream(spark, f"{tmp_path}/time/mission_000001", "imu").groupBy("segment").agg(F.min("cc_receive_time_ns").alias("a"), F.max("cc_receive_time_ns").alias("b"))
    assert {x.segment: (x.a // 10**9, x.b // 10**9) for x in rows.collect()} == {f"segment_{i:02d}": (i, i) for i in range(4)}
    r = recorder.open_mission(spark, str(tmp_path / "size"), 1, 7, HEAD, size=1)
    assert [r.append("link", i, f) for i, f in enumerate(flight)] == [True, True]
    r.finalize()
    assert [s["close_reason"] for s in r.journal.state["segments"]] == ["rotation_cap", "px4_reboot", "rotation_cap", "clean"]


def test_the_log_reads_the_same_with_and_without_its_summaries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recorder, "SUMMARY", 3)
    r = recorder.open_mission(spark, str(tmp_path), 1, 7, HEAD)
    none = traces.flights(spark, 1, 1).limit(0)
    for i in range(7):
        r.append("link", i, none)
    again = recorder.Journal(r.files, r.folder).read()
    assert (again.next, again.state) == (r.journal.next, r.journal.state) and again.state["batches"] == {"link": 6}
    for p in tmp_path.glob("mission_000001/_log/*.summary.json"):
        p.unlink()
    assert recorder.Journal(r.files, r.folder).read().state == r.journal.state


def test_an_entry_is_put_once(spark, tmp_path):
    store = files.Files(spark, str(tmp_path))
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if store.put(f"{tmp_path}/a.json", {"i": i}) else None) for i in range(2)]
    for t in threads:
        t.start()
        t.join()
    assert len(won) == 1 and store.read(f"{tmp_path}/a.json") == {"i": won[0]} and store.names(str(tmp_path)) == ["a.json"]


def test_a_stream_is_recorded_once(spark, tmp_path, flight):
    source = spark.readStream.schema(flight[0].schema).option("maxFilesPerTrigger", 1).parquet(flight[0].inputFiles()[0].rpartition("/")[0])
    r = recorder.open_mission(spark, str(tmp_path / "m"), 1, 7, HEAD, at=killing("told", 1))
    start = lambda r: source.writeStream.foreachBatch(r.sink("link")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="Killed"):
        start(r).awaitTermination()
    r = recorder.open_mission(spark, str(tmp_path / "m"), 1, 7, HEAD)
    start(r).awaitTermination()
    r.finalize()
    assert told(spark, f"{tmp_path}/m/mission_000001") == sent(flight)
