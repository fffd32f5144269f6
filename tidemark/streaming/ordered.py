"""Ordered work on a live stream: rows wait in a sort buffer until the watermark has passed them, then each key's fold takes them in order.

What comes out of a stream is what the batch operators give over the same rows, whatever micro-batches they came in, if they come no later than the watermark allows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import chain
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.align import TICK_NS
from tidemark.operators.scans import TimeSync

#: Rows that one value of a key's state holds: each value costs a call's conversion on both sides, rows within it next to nothing.
PACK = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Grid:
    """Ticks of one key: on each grid point the last values of the rows strictly before it; a new boot begins a new grid without values."""

    def __init__(self, values: int, step: int):
        self.width, self.grid, self.tick, self.boot, self.now = values, step, None, None, [None] * values

    def restore(self, kept: list[tuple]) -> None:
        for tick, boot, at, value in kept:
            self.tick, self.boot, self.now[at] = tick, boot, value

    def kept(self) -> list[tuple]:
        return [(self.tick, self.boot, i, v) for i, v in enumerate(self.now)]

    def step(self, time: int, boot: int | None, *values: float | None) -> list[tuple]:
        if self.tick is None or boot != self.boot:
            self.tick, self.boot, self.now = time - time % self.grid + self.grid, boot, [None] * self.width
        out = []
        while self.tick <= time:
            out.append((boot, self.tick, *self.now))
            self.tick += self.grid
        self.now = [old if v is None else v for old, v in zip(self.now, values)]
        return out


class Clock:
    """The clock filter of one key; the rings of accepted exchanges and of outcomes are rows of what it keeps."""

    def __init__(self):
        self.fold = TimeSync()

    def restore(self, kept: list[tuple]) -> None:
        for kind, a, b in kept:
            if kind == "accepted":
                self.fold.accept(a, b)
            elif kind == "outcome":
                self.fold.judge(bool(a))
            else:
                self.fold.refused = a

    def kept(self) -> list[tuple]:
        return [*(("accepted", *x) for x in self.fold.accepted), *(("outcome", int(x), 0) for x in self.fold.outcomes), ("refused", self.fold.refused, 0)]

    def step(self, time: int, seq: int, remote: int, sent: int, received: int) -> list[tuple]:
        return [(seq, *self.fold.step(remote, sent, received))]


def packed(rows: list[tuple]) -> list[tuple[bytes]]:
    """Rows as values of a list state, PACK of them in one."""
    return [(pickle.dumps(rows[i : i + PACK], protocol=4),) for i in range(0, len(rows), PACK)]


def unpacked(values: Iterator[tuple[bytes]]) -> list[tuple]:
    return [row for (pack,) in values for row in pickle.loads(pack)]


class _Ordered(StatefulProcessor):
    """The sort buffer of a key and its fold. Rows are (microseconds, tie breaker, ...); ``takes``: where they have what the fold takes.

    They come as arrays, one for each type, since each column of a row costs a conversion; ``places``: where the arrays on end have what is in the row.
    For the same reason what the fold gives can leave as columns: with ``wide``, a row is a key and an array a column, of up to so many results.
    """

    def __init__(self, places: list[int], takes: list[int], make: Callable[[], Grid | Clock], names: list[str], wide: int | None = None):
        self.places, self.takes, self.make, self.names, self.wide = places, takes, make, names, wide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "pack binary")
        self.state = handle.getListState("kept", "pack binary")

    def _pass(self, key: tuple, new: list[tuple], timers: TimerValues) -> Iterator[Row]:
        passed = max(timers.getCurrentWatermarkInMs(), 0) * 1000
        ready = [r for r in new if r[0] <= passed]
        wait = [r for r in new if r[0] > passed]
        if ready or not new:
            held = unpacked(self.buffer.get())
            ready += [r for r in held if r[0] <= passed]
            wait += [r for r in held if r[0] > passed]
            self.buffer.put(packed(wait)) if wait else self.buffer.clear()
        elif wait:
            self.buffer.appendList(packed(wait))
        if wait:
            self.handle.registerTimer(min(r[0] for r in wait) // 1000)
        if ready:
            fold, taken, row = self.make(), itemgetter(*self.takes), Row(*self.names)
            fold.restore(unpacked(self.state.get()))
            out = [x for r in sorted(ready, key=itemgetter(0, 1)) for x in fold.step(*taken(r))]
            self.state.put(packed(fold.kept()))
            told = out if self.wide is None else (zip(*out[i : i + self.wide]) for i in range(0, len(out), self.wide))
            for x in told:
                yield row(*key, *x)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        row, first = itemgetter(*self.places), len(key) + 1
        return self._pass(key, [row([*chain.from_iterable(tuple(r)[first:])]) for r in rows], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._pass(key, [], timerValues)

    def close(self) -> None:
        pass


def _folded(rows: DataFrame, keys: list[str], time: str, late: str, order: list[str], taken: list[str], make: Callable[[], Grid | Clock], out: str) -> DataFrame:
    """rows: the event time ``time``, and as ``order`` microseconds and a tie breaker."""
    names = list(dict.fromkeys([*order, *taken]))
    alike: dict[str, list[str]] = {}
    for n in names:
        alike.setdefault(rows.schema[n].dataType.simpleString(), []).append(n)
    bare = rows.withWatermark(time, late).select(*keys, time, *(F.array(*(rows[n] for n in found)).alias(f"_{i}") for i, found in enumerate(alike.values())))
    end_on = [n for found in alike.values() for n in found]
    told = T.StructType.fromDDL(out)
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in told)])
    folds = _Ordered([end_on.index(n) for n in names], [names.index(n) for n in taken], make, schema.names, PACK)
    found = bare.groupBy(*keys).transformWithState(folds, schema, "append", "EventTime")
    return found.select(*keys, F.inline(F.arrays_zip(*told.names)))


def live_grid(
    rows: DataFrame, keys: list[str], values: list[str], time: str = "ts", micros: str = "t", seq: str = "seq", boot: str | None = None, late: str = "10 seconds", step: int = TICK_NS // 1000
) -> DataFrame:
    """(keys, boot, tick, values): the evaluation grid of ``align.at_ticks`` on a stream, in microseconds; a tick comes once a row at or after it is final.

    ``time``: the event time, ``micros`` the same in microseconds, ``seq`` orders rows of one time. Rows may come up to ``late`` late in any order; later ones are dropped by the
    watermark. Another value of ``boot`` begins a new grid, as for a new key; a null value changes nothing. State is the rows that wait and one value a column.
    """
    boots = rows.withColumn("_boot", F.lit(0).cast("long") if boot is None else F.col(boot).cast("long")).withColumns({v: F.col(v).cast("double") for v in values})
    out = ", ".join(["boot long", "tick long", *(f"{v} double" for v in values)])
    return _folded(boots, keys, time, late, [micros, seq], [micros, "_boot", *values], partial(Grid, len(values), step), out)


def live_time_sync(rows: DataFrame, keys: list[str], remote: str, sent: str, received: str, time: str = "ts", micros: str = "t", seq: str = "seq", late: str = "10 seconds") -> DataFrame:
    """(keys, seq, accepted, offset_ns, rtt_ns, quality, rejected): the clock filter of ``scans.time_sync`` on a stream, its windows of 32 as rings in list state."""
    kind = rows.schema[seq].dataType.simpleString()
    out = f"seq {kind}, accepted boolean, offset_ns long, rtt_ns long, quality string, rejected long"
    return _folded(rows, keys, time, late, [micros, seq], [micros, seq, remote, sent, received], Clock, out)
