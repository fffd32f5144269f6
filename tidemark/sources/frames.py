"""Binary link captures: finding the frames in byte streams of any length, with every byte accounted for.

A frame may begin at any byte, so a range can't know by itself where it is entered. Each range tells what it finds from every place where the range before may leave
it; which of these were right follows by stitching (``stitch.entered``). Frames and accounts come from that one pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceReader, InputPartition

from tidemark.sources.captures import RANGE, RangeReader, RangeSource
from tidemark.sources.shared import stored
from tidemark.sources.stitch import entered

#: Fixed values of the wire format: start bytes, header lengths, the flag of signed frames and their signature's length, the check's reversed polynomial.
START_V1, START_V2, HEADER_V1, HEADER_V2, SIGNED, SIGNATURE, POLYNOMIAL = 0xFE, 0xFD, 6, 10, 0x01, 13, 0x8408
LONGEST = HEADER_V2 + 255 + 2 + SIGNATURE
#: What a chain adds up, besides bytes of garbage: bytes and numbers of valid and of unknown frames, and start bytes that began none, by why.
SUMS = ["ok", "unknown", "frames_ok", "unknown_frames", "bad_flags", "bad_checks", "suspects"]


def _remainders() -> np.ndarray:
    """What each byte does to the check, bit by bit."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ POLYNOMIAL, table >> 1)
    return table


_TABLE = _remainders()


def checksums(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, extras: np.ndarray) -> np.ndarray:
    """CRC-16/MCRF4XX of many runs of bytes, each followed by one extra byte of its message's definition; all runs take their next byte at once."""
    order = np.argsort(-lengths, kind="stable")
    begins, ends, crc = begins[order], np.sort(lengths), np.full(len(order), 0xFFFF, np.uint32)
    for i in range(int(lengths.max(initial=0))):
        n = len(ends) - int(np.searchsorted(ends, i, "right"))  # runs longer than i
        crc[:n] = crc[:n] >> 8 ^ _TABLE[(crc[:n] ^ data[begins[:n] + i]) & 0xFF]
    crc = crc >> 8 ^ _TABLE[(crc ^ extras[order]) & 0xFF]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def checksum(data: bytes, extra: int) -> int:
    """The check of one run of bytes."""
    return int(checksums(np.frombuffer(data, np.uint8), np.zeros(1, int), np.array([len(data)]), np.array([extra]))[0])


class _Range:
    """All that may be a frame in the first ``left`` bytes of ``data``; ``rest`` bytes are left of the file from there."""

    def __init__(self, data: bytes | pa.Buffer, left: int, rest: int, extras: dict[int, int]):
        self.left = left
        bytes_ = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(LONGEST + 2, np.uint8)])
        start = (bytes_ == START_V1) | (bytes_ == START_V2)
        self.at = at = np.flatnonzero(start[:left])
        second = bytes_[at] == START_V2
        self.head = head = np.where(second, HEADER_V2, HEADER_V1)
        self.payload = payload = bytes_[at + 1].astype(np.int64)
        flags = np.where(second, bytes_[at + 2], 0).astype(np.int64)
        wide = bytes_[at + 7].astype(np.int64) | bytes_[at + 8].astype(np.int64) << 8 | bytes_[at + 9].astype(np.int64) << 16
        self.message = np.where(second, wide, bytes_[at + 5])
        size = head + payload + 2 + np.where(flags & SIGNED, SIGNATURE, 0)
        bad = (rest - at >= head) & (flags & ~SIGNED != 0)
        self.pending = (rest - at < head) | ~bad & (rest - at < size)
        whole = ~bad & ~self.pending
        ids = np.array(sorted(extras), np.int64)
        known = whole & np.isin(self.message, ids)
        i = np.flatnonzero(known)
        extra = np.array([extras[k] for k in ids.tolist()], np.uint32)[np.searchsorted(ids, self.message[i])] if len(i) else np.zeros(0, np.uint32)
        end = at[i] + head[i] + payload[i]
        self.ok = np.zeros(len(at), bool)
        self.ok[i] = checksums(bytes_, at[i] + 1, head[i] - 1 + payload[i], extra) == bytes_[end].astype(np.uint32) | bytes_[end + 1].astype(np.uint32) << 8
        ends = (at + size == rest) | start[np.minimum(at + size, len(bytes_) - 1)]
        unknown = whole & ~known & ends
        self.step = np.where(self.ok | unknown, size, 1)
        n = len(at)
        self.next = np.where(self.pending, n, np.searchsorted(at, at + self.step))
        one = np.ones(n, np.int64)
        self.sums = np.array([size * self.ok, size * unknown, one * self.ok, one * unknown, one * bad, one * (known & ~self.ok), one * (whole & ~known & ~unknown)]).T.reshape(n, len(SUMS))
        self.bytes = bytes_

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the chain from each start byte: its sums and the last start byte it comes to, by doubling jumps."""
        n, jump, sums, last = len(self.at), self.next.copy(), self.sums.copy(), np.arange(len(self.at))
        while (on := np.flatnonzero(jump < n)).size:
            to = jump[on]
            sums[on], last[on], jump[on] = sums[on] + sums[to], last[to], jump[to]
        return sums, last

    def entries(self, most: int) -> Iterator[tuple]:
        """(low, high, until, pending, sums) for entries that come to the same start byte first; ``until``: where the chain leaves the range, or what is pending begins."""
        sums, last = self.chains()
        first = np.searchsorted(self.at, np.arange(most))
        for node in np.unique(first).tolist():
            low, high = np.searchsorted(first, node), np.searchsorted(first, node, "right") - 1
            if node == len(self.at):
                yield int(low), int(high), self.left, False, [0] * len(SUMS)
                continue
            end = last[node]
            until = self.at[end] if self.pending[end] else max(self.at[end] + self.step[end], self.left)
            yield int(low), int(high), int(until), bool(self.pending[end]), sums[node].tolist()

    def frames(self, lows: dict[int, int]) -> Iterator[tuple[int, list[int] | None]]:
        """(which start byte, entries) of each valid frame that is on a chain; entries: None where it is on all.

        lows: first start byte of a chain -> the entry that names it.
        """
        on, every = [0] * (len(self.at) + 1), (1 << len(lows)) - 1
        for bit, node in enumerate(lows):
            on[node] |= 1 << bit
        names, next_ = list(lows.values()), self.next.tolist()
        for i, valid in enumerate(self.ok.tolist()):
            if not on[i]:
                continue
            on[next_[i]] |= on[i]
            if valid:
                yield i, None if on[i] == every else [x for b, x in enumerate(names) if on[i] >> b & 1]

    def columns(self, i: np.ndarray) -> dict[str, pa.Array]:
        """Offset, message, system, component, sequence and payload of frames, by which start bytes they have."""
        begin, head, length = self.at[i], self.head[i], self.payload[i]
        field = begin + np.where(head == HEADER_V2, 4, 2)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        payload = self.bytes[np.repeat(begin + head - ends[:-1], length) + np.arange(ends[-1])]
        numbers = {"offset": begin, "message": self.message[i], **{c: self.bytes[field + at].astype(np.int32) for at, c in enumerate(("sequence", "system", "component"))}}
        return {c: pa.array(x) for c, x in numbers.items()} | {"payload": pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(payload)])}


_MAPS = "path string, range long, low long, high long, leaves long, into long, until long, size long, " + ", ".join(f"{s} long" for s in SUMS)
_FRAMES = "offset long, message long, system int, component int, sequence int, payload binary, entries array<long>"


_KINDS = {"path": pa.string(), **dict.fromkeys(["range", "low", "high", "leaves", "into", "until", "size", *SUMS, "offset", "message"], pa.int64())}
_KINDS |= dict.fromkeys(["system", "component", "sequence"], pa.int32()) | {"payload": pa.binary(), "entries": pa.list_(pa.int64())}


def _batch(rows: int, **columns: pa.Array | object) -> pa.RecordBatch:
    """A batch of these columns, or of one value in all rows; columns that aren't told are null."""
    full = {c: x if isinstance(x, pa.Array) else pa.repeat(pa.scalar(x, _KINDS[c]), rows) for c, x in columns.items()}
    return pa.RecordBatch.from_pydict({c: full[c].cast(kind) if c in full else pa.nulls(rows, kind) for c, kind in _KINDS.items()})


class FrameReader(RangeReader):
    """Reads a range and tells its maps and frames before it reads the next, so that a task holds one range, whatever it reads in all."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.extras = {int(k): v for k, v in json.loads(options["extras"]).items()}

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        size = self.range
        for batch in super().read(part):
            path, number, at, total = (batch.column(c)[0].as_py() for c in ("path", "range", "at", "size"))
            left = min(size, total - at)
            found = _Range(batch.column("data")[0].as_buffer(), left, total - at, self.extras)
            rows, lows = [], {}
            for low, high, until, pending, sums in found.entries(min(left, LONGEST) if number else 1):
                lows.setdefault(int(np.searchsorted(found.at, low)), low)
                over = pending or at + until >= total
                rows.append((low, high, None if over else (at + until) % size, None if over else (at + until) // size, at + until, *sums))
            names = ("low", "high", "leaves", "into", "until", *SUMS)
            yield _batch(len(rows), path=path, range=number, size=total, **{c: pa.array(x, _KINDS[c]) for c, x in zip(names, zip(*rows))})
            which, entries = np.empty(int(found.ok.sum()), np.int64), []
            for i, names in found.frames(lows):
                which[len(entries)] = i
                entries.append(names)
            told = found.columns(which[: len(entries)])
            told["offset"] = pa.array(told["offset"].to_numpy() + at)
            yield _batch(len(entries), path=path, range=number, entries=pa.array(entries, _KINDS["entries"]), **told)


class FrameSource(RangeSource):
    """Format link_frames: the ranges of ``byte_ranges``, decoded where they are read; ``extras`` is JSON of the extra bytes by message."""

    @classmethod
    def name(cls) -> str:
        return "link_frames"

    def schema(self) -> str:
        return f"{_MAPS}, {_FRAMES}"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))


def decode(spark: SparkSession, path: str, extras: dict[int, int], pattern: str = "*", size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The captures under a path -> the valid frames, and the account of each file. ``extras``: message id -> the extra byte of its check.

    Frames: path, offset, message, system, component, sequence, payload. Accounts: path, bytes, those in valid and unknown frames, garbage and pending, ``balanced`` (they
    add up), numbers of frames, and start bytes that began none: unknown flags, failed checks, unknown messages that no start byte follows. Reading resumes at the byte
    after a start byte whose frame fails; a well-delimited frame of an unknown message is passed over whole. An empty file has no row.
    """
    spark.dataSource.register(FrameSource)
    told = {"pattern": pattern, "range": size, "beyond": LONGEST + 1, "task": 32 * max(size, RANGE), "extras": json.dumps(extras)}
    seen = stored(spark.read.format("link_frames").options(**told).load(path), "frames")
    maps = seen.filter("low is not null")
    way = stored(entered(maps.select("path", "range", "low", "high", "leaves", "into")), "frame-ways")
    used = way.select("path", "range", F.col("low").alias("by"))
    frames = seen.filter("offset is not null").join(used, ["path", "range"]).filter("entries is null or array_contains(entries, by)")
    own = maps.join(way, ["path", "range", "low"]).withColumn("garbage", F.col("until") - F.col("range") * size - F.col("entry") - F.col("ok") - F.col("unknown"))
    accounts = own.groupBy("path").agg(F.first("size").alias("bytes"), *(F.sum(c).alias(c) for c in [*SUMS[:2], "garbage"]), (F.first("size") - F.max("until")).alias("pending"), *(F.sum(c).alias(c) for c in SUMS[2:]))
    balanced = F.col("bytes") == F.col("ok") + F.col("unknown") + F.col("garbage") + F.col("pending")
    return frames.select("path", "offset", "message", "system", "component", "sequence", "payload"), accounts.withColumn("balanced", balanced)


def encode(rows: DataFrame, extras: dict[int, int], others: int = 0) -> DataFrame:
    """Rows with message, system, component, sequence (modulo 256) and payload (255 bytes at most) -> the same with ``record``, the frame of each.

    A message that ``extras`` doesn't have is checked with ``others``; null payloads are empty.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("message", "system", "component", "sequence", "payload")]
            bodies = [bytes([len(p or b""), 0, 0, q % 256, s, c]) + m.to_bytes(3, "little") + (p or b"") for m, s, c, q, p in zip(*columns)]
            lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
            checks = checksums(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lengths) - lengths, lengths, np.array([extras.get(m, others) for m in columns[0]], np.uint32))
            made = [bytes([START_V2]) + b + k.to_bytes(2, "little") for b, k in zip(bodies, checks.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "record"])

    return rows.mapInArrow(frames, T.StructType([*rows.schema, T.StructField("record", T.BinaryType())]))
