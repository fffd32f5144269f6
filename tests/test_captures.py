"""Raw captures that are written by tasks and streams and read in byte ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import captures, streams


def records(spark, n=200, parts=4):
    df = spark.range(n, numPartitions=parts)
    return df.select(F.concat(F.lit("segment_0"), (F.col("id") % 2).cast("string")).alias("segment"), F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).cast("binary")).alias("record"))


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_records_written_by_tasks_are_read_back(spark, tmp_path):
    captures.append_raw(records(spark), str(tmp_path))
    assert len(files(tmp_path)) == 8 and all(f.endswith(".bin") for f in files(tmp_path))
    got = {r.segment: (r.frames, r.torn) for r in streams.raw_captures(spark, str(tmp_path)).collect()}
    assert got == {"segment_00": (100, False), "segment_01": (99, False)}
    captures.append_raw(records(spark), f"file://{tmp_path}")
    assert {r.segment: r.frames for r in streams.raw_captures(spark, str(tmp_path)).collect()} == {"segment_00": 200, "segment_01": 198}


def test_nothing_stays_of_a_write_that_fails(spark, tmp_path):
    bad = records(spark).withColumn("record", F.when(F.monotonically_increasing_id() < 3 * 2**33 + 20, F.col("record")).otherwise(F.raise_error("dead").cast("binary")))
    with pytest.raises(Exception, match="dead"):
        captures.append_raw(bad, str(tmp_path))
    assert files(tmp_path) == []


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    for i in range(3):
        records(spark, 60, 1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("segment string, record binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    captures.stream_raw(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {"segment_00": 90, "segment_01": 87}
    read = lambda: {r.segment: r.frames for r in streams.raw_captures(spark, str(tmp_path / "out")).collect()}
    assert read() == want
    for p in [p for p in (tmp_path / "state/commits").iterdir() if p.name in ("2", ".2.crc")]:  # as if the query had died before the last batch was noted
        p.unlink()
    captures.stream_raw(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert read() == want and not [f for f in files(tmp_path / "out") if "inprogress" in f]


def sequential(data):
    at = n = 0
    while at + 4 <= len(data) and at + 4 + int.from_bytes(data[at : at + 4], "little") <= len(data):
        at, n = at + 4 + int.from_bytes(data[at : at + 4], "little"), n + 1
    return n, at, at < len(data)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_a_capture_counts_the_same_for_every_size_of_range(spark, tmp_path, size):
    rnd = random.Random(size)
    frame = lambda n: n.to_bytes(4, "little") + rnd.randbytes(n)
    made = {
        "whole": b"".join(frame(rnd.randrange(60)) for _ in range(100)), "zeros": bytes(4) * 300, "long": frame(900) + frame(3) + frame(700) + b"".join(frame(9) for _ in range(30)),
        "torn": b"".join(frame(rnd.randrange(60)) for _ in range(50)) + (40).to_bytes(4, "little") + b"x", "prefix": frame(5) + b"\x09\x00", "one": b"\x00", "noise": rnd.randbytes(400),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    got = {r.path.rpartition("/")[2][:-4]: (r.frames, r.bytes, r.torn) for r in streams.raw_frames(spark, str(tmp_path), size=size, longest=50).collect()}
    assert got == {name: sequential(data) for name, data in made.items()}
