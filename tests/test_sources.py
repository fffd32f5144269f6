"""Frames, parts, manifests and scenarios."""

import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tidemark.plans import integrity, traces
from tidemark.sources import frames, sinks, streams

EXTRAS = {54000: 17, 30: 39}


def frame(message, payload, sequence=0, extra=None):
    head = bytes([len(payload), 0, 0, sequence, 3, 1]) + message.to_bytes(3, "little")
    body = head + payload
    return b"\xfd" + body + frames.checksum(body, EXTRAS[message] if extra is None else extra).to_bytes(2, "little")


def test_checksum_of_the_standard_text():
    assert frames.checksum(b"12345678", ord("9")) == 0x6F91


def bitwise(data, extra):
    crc = 0xFFFF
    for byte in (*data, extra):
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ 0x8408 if crc & 1 else crc >> 1
    return crc


def sequential(data):
    """A reader that takes a whole capture byte by byte: frames, and the account."""
    out, n, at = [], dict.fromkeys(["ok", "unknown", "garbage", "frames_ok", "unknown_frames", "bad_flags", "bad_checks", "suspects"], 0), 0
    while at < len(data):
        left, fault = len(data) - at, None
        if data[at] in (0xFD, 0xFE):
            head = 10 if data[at] == 0xFD else 6
            if left < head:
                break
            flags = data[at + 2] if head == 10 else 0
            size = head + data[at + 1] + 2 + 13 * (flags & 1)
            if flags > 1:
                fault = "bad_flags"
            elif left < size:
                break
            else:
                message = int.from_bytes(data[at + 7 : at + 10], "little") if head == 10 else data[at + 5]
                end = at + head + data[at + 1]
                if message not in EXTRAS:
                    if at + size == len(data) or data[at + size] in (0xFD, 0xFE):
                        n["unknown"] += size
                        n["unknown_frames"] += 1
                        at += size
                        continue
                    fault = "suspects"
                elif bitwise(data[at + 1 : end], EXTRAS[message]) == int.from_bytes(data[end : end + 2], "little"):
                    i = at + (4 if head == 10 else 2)
                    out.append((at, message, data[i + 1], data[i + 2], data[i], data[at + head : end]))
                    n["ok"] += size
                    n["frames_ok"] += 1
                    at += size
                    continue
                else:
                    fault = "bad_checks"
        if fault:
            n[fault] += 1
        n["garbage"] += 1
        at += 1
    return out, n | {"pending": len(data) - at}


def captures(rnd):
    v1 = lambda body: b"\xfe" + body + bitwise(body, EXTRAS[30]).to_bytes(2, "little")
    good = [frame(54000, rnd.randbytes(rnd.randrange(256)), i % 256) for i in range(60)] + [v1(bytes([5, i, 1, 2, 30]) + rnd.randbytes(5)) for i in range(20)]
    inner = frame(54000, frame(54000, b"abc", 7) + b"\xfd" * 9 + frame(30, b"x"), 8)  # frames within the payload of a frame
    pieces = [*good, inner, inner[:-1] + b"?", frame(77, b"abc", extra=5), frame(77, b"\xfe\xfd", extra=5) + b"\x00", b"\xfd\x03\x08\x00", rnd.randbytes(40), b"\xfd" * 300, b"", b"\x00" * 700]
    mixed = [rnd.choice(pieces) + rnd.choice([b"", b"\xfe", rnd.randbytes(3)]) for _ in range(120)]
    return {"clean": b"".join(good), "mixed": b"".join(mixed), "noise": rnd.randbytes(6000), "starts": b"\xfd\xfe" * 900, "short": good[0][:9], "one": b"\xfe", "tail": b"".join(good[:9]) + good[9][:-1], "none": b"\x01" * 2000}


@pytest.mark.parametrize("size", [16, 333, 4096, 1 << 20])
def test_frames_and_accounts_are_the_same_for_every_size_of_range(spark, tmp_path, size):
    made = captures(random.Random(size))
    if size == 16:
        made = {k: v[:1500] for k, v in made.items()}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    found, accounts = frames.decode(spark, str(tmp_path), EXTRAS, size=size)
    got = {}
    for r in found.orderBy("path", "offset").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.offset, r.message, r.system, r.component, r.sequence, bytes(r.payload)))
    rows = {r.path.rpartition("/")[2]: r.asDict() for r in accounts.collect()}
    assert set(rows) == set(made) and all(r["balanced"] for r in rows.values())
    for name, data in made.items():
        want, account = sequential(data)
        assert got.get(name, []) == want, name
        assert {k: rows[name][k] for k in account} == account, name


def test_a_task_holds_one_range_however_many_it_reads(tmp_path):
    rnd = random.Random(3)
    data = b"".join(frame(54000, rnd.randbytes(9), i % 256) for i in range(2000))
    (tmp_path / "a").write_bytes(data * 16)
    size, peaks = len(data), []
    reader = frames.FrameReader({"path": str(tmp_path), "range": size, "beyond": frames.LONGEST + 1, "task": 16 * size, "extras": json.dumps(EXTRAS)})
    (part,) = reader.partitions()
    for last in (2, 2, 16):
        part.last, n = last, 0
        tracemalloc.start()
        for batch in reader.read(part):
            n += batch.num_rows - batch.column("offset").null_count
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == 2000 * last
    assert peaks[2] < 1.2 * peaks[1]


def test_many_checks_at_once_equal_each_by_itself():
    rnd = random.Random(2)
    data = rnd.randbytes(3000)
    begins, lengths, extras = ([rnd.randrange(n) for _ in range(200)] for n in (2700, 270, 256))
    got = frames.checksums(frames.np.frombuffer(data, frames.np.uint8), *map(frames.np.array, (begins, lengths, extras)))
    assert got.tolist() == [bitwise(data[b : b + n], x) for b, n, x in zip(begins, lengths, extras)]


def test_parts_and_manifest_written_are_clean_when_inspected(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_parts(traces.flights(spark, 1, 2).withColumn("segment", F.lit("segment_00")), root, rows_per_part=20)
    rolled = integrity.part_rollup(spark, root, streams.PERIODIC)
    assert rolled.filter("stream = 'imu'").first().rows == 100
    sinks.write_manifest(rolled, f"{root}/manifest.json", {"complete": True, "vehicle_id": 1, "mission_id": 9, "dialect_hash": "0x1", "schema_version": 1})
    assert integrity.inspect(spark, root, streams.PERIODIC, "0x1", 1).first().verdict == "clean"
    assert streams.unfinished_mission(streams.read_manifest(spark, root)).count() == 0


def test_scenarios(tmp_path):
    (tmp_path / "s.toml").write_text('[[event]]\nt = 2.5\nseverity = "WARN"\n[[event]]\nt = 0\n')
    assert sinks.read_scenario(tmp_path / "s.toml") == [(0, "ok"), (2_500_000_000, "warn")]


def test_conclusions_of_a_scenario(tmp_path):
    (tmp_path / "s.toml").write_text('[[event]]\nt_s = 2.5\nseverity = "Critical"\naction = "WARN"\nflags = ["GPS", "link"]\nconfidence = 70\n[[event]]\nt_s = 0\nseverity = "ok"\n')
    first, second = sinks.read_conclusions(tmp_path / "s.toml")
    assert first == {"time_ns": 0, "severity": "ok", "action": "none", "health_flags": 0, "confidence": 100}
    assert second == {"time_ns": 2_500_000_000, "severity": "critical", "action": "warn_only", "health_flags": 72, "confidence": 70}
    for wrong in ('severity = "bad"', 'severity = "ok"\naction = "fly"', 'severity = "ok"\nflags = ["x"]'):
        (tmp_path / "s.toml").write_text(f"[[event]]\nt_s = 1\n{wrong}\n")
        with pytest.raises(ValueError, match="bad"):
            sinks.read_conclusions(tmp_path / "s.toml")


def test_names(spark):
    from tidemark.functions import scalars as S

    got = spark.range(7, 8).select(S.segment_name(F.col("id")), S.mission_name(F.col("id")), S.part_name(F.col("id"))).first()
    assert tuple(got) == ("segment_07", "mission_000007", "000007.parquet")
