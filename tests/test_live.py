"""The live grid and clock filter over shuffled micro-batches, beside their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.align import at_ticks
from tidemark.operators.ingest import boot_epoch
from tidemark.streaming import live, ordered

SCHEMA = "vehicle long, seq long, t long, boot long, x double, y double"


def made(n=400):
    rnd = random.Random(6)
    rows, t = [], {1: 7_000_123, 2: 50_000}
    for seq in range(n):
        v = rnd.choice([1, 1, 1, 2])
        t[v] += rnd.choice([0, 1, 100_000, rnd.randrange(300_000)])
        t[v] = t[v] - t[v] % 100_000 if rnd.random() < 0.1 else t[v]
        rows.append((v, seq, t[v], 3 + (t[v] > 20_000_000), rnd.choice([None, float(seq)]), float(seq % 7)))
    return rows


def source(spark, path, rows, size):
    """Micro-batches of ``size`` rows, out of order by half a second at most."""
    rnd = random.Random(size)
    late = sorted(rows, key=lambda r: r[2] + rnd.randrange(500_000))
    for i in range(0, len(late), size):
        spark.createDataFrame(late[i : i + size], SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i:06d}")
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")
    return df.withColumn("ts", F.timestamp_micros("t"))


@pytest.mark.parametrize("size", [60, 1000])
def test_ticks_equal_the_batch_grid_up_to_the_watermark(spark, tmp_path, size):
    rows = made()
    with ordered.state_store(spark):
        found = live.drained(ordered.live_grid(source(spark, tmp_path, rows, size), ["vehicle"], ["x", "y"], boot="boot", late="1 second"))
    passed = (max(r[2] for r in rows) // 1000 - 1000) * 1000
    df = spark.createDataFrame([r for r in rows if r[2] <= passed], SCHEMA)
    batch = at_ticks(boot_epoch(df, ["vehicle"], ["t", "seq"]), ["vehicle", "epoch"], "t", ["t", "seq"], ["x", "y"], 100_000)
    want = sorted((tuple(r) for r in batch.select("vehicle", F.col("epoch") + 3, "tick", "x", "y").collect()), key=str)
    assert len(want) > 100 and sorted((tuple(r) for r in found.collect()), key=str) == want


@pytest.mark.parametrize("size", [60, 1000])
def test_the_clock_filter_equals_its_batch_twin(spark, tmp_path, size):
    rows = made()
    trip = (F.col("seq") * 7919 % 1000) * 1000 - 2000
    exchanges = lambda df: df.withColumns({"sent": F.col("t") * 1000, "received": F.col("t") * 1000 + trip, "remote": F.col("t") * 1000 + F.col("seq")})
    with ordered.state_store(spark):
        found = live.drained(ordered.live_time_sync(exchanges(source(spark, tmp_path, rows, size)), ["vehicle"], "remote", "sent", "received", late="1 second"))
    passed = (max(r[2] for r in rows) // 1000 - 1000) * 1000
    df = exchanges(spark.createDataFrame([r for r in rows if r[2] <= passed], SCHEMA))
    batch = scans.time_sync(df, ["vehicle"], ["t", "seq"], "remote", "sent", "received").select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect())) and found.count() > 300


def test_waiting_rows_are_a_few_values_of_state():
    class Held(list):
        def get(self):
            return iter(self)

        def put(self, values):
            self[:] = values

        appendList = list.extend

    class Handle:
        timers, states = [], {}
        registerTimer = timers.append

        def getListState(self, name, schema):
            return self.states.setdefault(name, Held())

    at = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    handle, n = Handle(), 2 * ordered.PACK + 5
    made = ordered._Ordered([0, 1, 2, 3, 4], [0, 1, 2, 3, 4], ordered.Clock, ["vehicle", "seq", "accepted", "offset_ns", "rtt_ns", "quality", "rejected"])
    made.init(handle)
    rows = [(1000 * i, i, 5 * i, 1000 * i, 1000 * i + 9) for i in range(1, n + 1)]
    random.Random(1).shuffle(rows)
    assert list(made.handleInputRows((7,), [(7, None, list(r)) for r in rows], at(0))) == []
    assert len(handle.states["buffer"]) == 3 and handle.timers == [1]
    found = list(made.handleExpiredTimer((7,), at(n - 1), None)) + list(made.handleExpiredTimer((7,), at(n), None))
    fold = ordered.Clock()
    assert [tuple(r) for r in found] == [(7, *x) for r in sorted(rows) for x in fold.step(*r)]
    assert handle.states["buffer"] == [] and len(handle.states["kept"]) == 1 and handle.timers == [1, n]


def test_results_leave_as_columns():
    class Nothing:
        get, put, clear = (lambda self: iter(())), (lambda self, values: None), lambda self: None

    class Handle:
        getListState, registerTimer = (lambda self, name, schema: Nothing()), lambda self, ms: None

    at = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 10**6})()
    made = ordered._Ordered([0, 1, 2, 3, 4], [0, 1, 2, 3, 4], ordered.Clock, ["vehicle", "seq", "accepted", "offset_ns", "rtt_ns", "quality", "rejected"], wide=100)
    made.init(Handle())
    rows = [(1000 * i, i, 5 * i, 1000 * i, 1000 * i + 9) for i in range(250)]
    found = list(made.handleInputRows((None,), [(None, None, list(r)) for r in reversed(rows)], at))
    fold = ordered.Clock()
    assert [(r[0], len(r.seq)) for r in found] == [(None, 100), (None, 100), (None, 50)]
    assert [x for r in found for x in zip(*r[1:])] == [x for r in rows for x in fold.step(*r)]


def test_the_clock_filter_of_no_vehicle_and_of_rows_that_come_twice(spark, tmp_path):
    rows = [(None if v == 2 else v, *r) for v, *r in made(200) for _ in range(2)]
    exchanges = lambda df: df.withColumns({"sent": F.col("t") * 1000, "received": F.col("t") * 1000 + F.col("seq") * 7919 % 1000, "remote": F.col("t") * 1000 + F.col("seq")})
    with ordered.state_store(spark):
        stream = ordered.live_time_sync(exchanges(source(spark, tmp_path, rows, 90)), ["vehicle"], "remote", "sent", "received", late="1 second")
        found = live.drained(stream)
    passed = (max(r[2] for r in rows) // 1000 - 1000) * 1000
    df = exchanges(spark.createDataFrame([r for r in rows if r[2] <= passed], SCHEMA))
    batch = scans.time_sync(df, ["vehicle"], ["t", "seq"], "remote", "sent", "received").select(*found.columns)
    assert found.schema.simpleString() == "struct<vehicle:bigint,seq:bigint,accepted:boolean,offset_ns:bigint,rtt_ns:bigint,quality:string,rejected:bigint>"
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect())) and found.filter("vehicle IS NULL").count() > 50


def test_the_running_ewma_takes_only_what_it_needs(spark, tmp_path):
    rnd, folds, want, rows = random.Random(3), {}, [], []
    for seq in range(300):
        v, x = rnd.choice([1, 1, 2, None]), rnd.choice([None, float("nan"), *([rnd.gauss(5, 2)] * 8)])
        for _ in range(1 + (seq % 50 == 0)):  # some rows come twice
            fold = folds.setdefault(v, scans.Ewma(0.05))
            fold.update(x)
            want.append((v, seq, fold.mean))
            rows.append((v, seq, seq * 1000, None, x, 0.0))
    for i in range(0, len(rows), 120):
        batch = rows[i : i + 120]
        rnd.shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:06d}")
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    told = live.running_ewma(df.withColumn("held", F.expr("make_interval(0, 0, 0, 1)")), ["vehicle"], "seq", "x", 0.05)  # Python has no such type
    shown = told._jdf.queryExecution().analyzed().toString().splitlines()
    below = next(line for i, line in enumerate(shown) if "FlatMapGroupsInPandasWithState" in shown[i - 1])
    assert "Project" in below and not any(f"{c}#" in below for c in ("t", "boot", "y", "held"))
    found = [tuple(r) for r in live.drained(told).collect()]
    plain = lambda rows: sorted(((str(v), s, "none" if x is None or x != x else x) for v, s, x in rows), key=str)
    assert plain(found) == plain(want) and any(v is None for v, _, _ in found)
