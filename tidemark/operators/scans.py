"""Recursions that need an ordered pass: each row's result depends on the state that the rows before left.

``ordered_scan`` streams sorted partitions through small folds and keeps one state at a time, so a long key needs no more
memory than a short one. Keys run in parallel; within a key the order of operations is fixed, so a rerun repeats every bit.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAN = float("nan")


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[], object], inputs: list[str], outputs: str) -> DataFrame:
    """``df`` with the columns ``outputs`` (a DDL schema): what ``fold()``'s method step(*inputs) returns for each row in order.

    One shuffle by key and one sort; a new fold begins with each key. Ties in ``order`` keep no promise, so order by enough columns.
    """
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        key, state = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            found = []
            for k, *x in zip(own, *(batch.column(c).to_pylist() for c in inputs)):
                if state is None or k != key:
                    key, state = k, fold()
                found.append(state.step(*x))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Ewma:
    """Exponentially weighted mean and variance; the first value seeds the mean, missing ones are passed over."""

    def __init__(self, alpha: float):
        self.alpha, self.mean, self.var, self.n = alpha, NAN, 0.0, 0

    def update(self, x: float) -> None:
        if x is None or x != x:
            return
        if self.n == 0:
            self.mean = x
        else:
            d = x - self.mean
            self.mean += self.alpha * d
            self.var = (1 - self.alpha) * (self.var + d * self.alpha * d)
        self.n += 1

    def step(self, x):
        self.update(x)
        return (None if self.n == 0 else self.mean), self.var


class Drift:
    """Two-sided CUSUM; the upper side goes first."""

    def __init__(self, slack: float, limit: float):
        self.slack, self.limit, self.up, self.down = slack, limit, 0.0, 0.0

    def update(self, x: float, target: float) -> str | None:
        if x == x and target == target:
            d = x - target
            self.up, self.down = max(0.0, self.up + d - self.slack), max(0.0, self.down - d - self.slack)
        return self.trip()

    def trip(self) -> str | None:
        return "up" if self.up > self.limit else "down" if self.down > self.limit else None

    def reset(self) -> None:
        self.up = self.down = 0.0

    def excess(self) -> float:
        return max(self.up, self.down) - self.limit


class PageHinkley:
    """Drift from the running mean in one direction (+1 up, -1 down) by more than delta."""

    def __init__(self, sign: int, delta: float, limit: float):
        self.sign, self.delta, self.limit = sign, delta, limit
        self.n, self.mean, self.sum, self.edge = 0, 0.0, 0.0, 0.0

    def update(self, x: float) -> bool:
        if x == x:
            self.n += 1
            self.mean += (x - self.mean) / self.n
            self.sum += x - self.mean - self.sign * self.delta
            self.edge = min(self.edge, self.sum) if self.sign > 0 else max(self.edge, self.sum)
        return self.value() > self.limit

    def value(self) -> float:
        return self.sign * (self.sum - self.edge)

    def excess(self) -> float:
        return self.value() - self.limit


class Robust:
    """Median and MAD of the last ``size`` admitted values, kept sorted."""

    def __init__(self, size: int, floor: float):
        self.size, self.floor, self.values, self.order = size, floor, deque(), []

    def update(self, x: float) -> None:
        if x != x:
            return
        if len(self.values) == self.size:
            self.order.remove(self.values.popleft())
        self.values.append(x)
        insort(self.order, x)

    def __len__(self) -> int:
        return len(self.values)

    @staticmethod
    def _middle(v: list[float]) -> float:
        n = len(v)
        return v[n // 2] if n % 2 else 0.5 * (v[n // 2 - 1] + v[n // 2])

    def z(self, x: float) -> float:
        if not self.values:
            return NAN
        median = self._middle(self.order)
        mad = self._middle(sorted(abs(v - median) for v in self.order))
        return (x - median) / max(1.4826 * mad, self.floor)


class LinkState:
    """Weighted means of gaps and of times between messages, and the variance of the latter."""

    def __init__(self, alpha: float):
        self.gap, self.interval = Ewma(alpha), Ewma(alpha)

    def step(self, gap, interval):
        self.gap.update(gap)
        self.interval.update(interval)
        return self.gap.mean if self.gap.n else None, self.interval.mean if self.interval.n else None, self.interval.var


class Rls:
    """Recursive least squares on [1, u, u * u] with forgetting."""

    def __init__(self, forget: float = 0.999, start: float = 100.0):
        self.forget, self.theta = forget, [0.0, 0.0, 0.0]
        self.p = [[start if i == j else 0.0 for j in range(3)] for i in range(3)]

    def update(self, u: float, y: float) -> float:
        """Takes a sample in; the residual before it (NaN if it doesn't count)."""
        phi = (1.0, u, u * u)
        if y != y or u != u:
            return NAN
        moved = [sum(row[j] * phi[j] for j in range(3)) for row in self.p]
        weight = self.forget + sum(a * b for a, b in zip(phi, moved))
        if not weight > 0:
            return NAN
        gain = [m / weight for m in moved]
        residual = y - sum(a * b for a, b in zip(phi, self.theta))
        self.theta = [t + g * residual for t, g in zip(self.theta, gain)]
        self.p = [[(self.p[i][j] - gain[i] * moved[j]) / self.forget for j in range(3)] for i in range(3)]
        return residual

    def step(self, u, y):
        residual = self.update(NAN if u is None else u, NAN if y is None else y)
        return (None if residual != residual else residual), *self.theta


class Hysteresis:
    """Severity that rises at once and falls only after the same lower value has held for a time. Ranks as in HOLD_RANK."""

    def __init__(self, debounce: int, ranks: dict[str, int]):
        self.debounce, self.ranks, self.now, self.pending = debounce, ranks, "ok", None

    def step(self, raw, time):
        if self.ranks[raw] >= self.ranks[self.now]:
            self.now, self.pending = raw, None
        elif self.pending is not None and self.pending[0] == raw:
            if time - self.pending[1] >= self.debounce:
                self.now, self.pending = raw, None
        else:
            self.pending = (raw, time)
        return (self.now,)


class TimeSync:
    """Clock offset from the last 32 accepted exchanges; one whose round trip is over 1.5 times the 90th percentile is refused. Offsets and trips are kept sorted."""

    SIZE, LEAST = 32, 8

    def __init__(self):
        self.accepted, self.refused, self.outcomes = deque(), 0, deque()
        self.offsets, self.trips, self.failed = [], [], 0

    def accept(self, offset: int, trip: int) -> None:
        if len(self.accepted) == self.SIZE:
            first = self.accepted.popleft()
            self.offsets.remove(first[0])
            self.trips.remove(first[1])
        self.accepted.append((offset, trip))
        insort(self.offsets, offset)
        insort(self.trips, trip)

    def judge(self, bad: bool) -> None:
        if len(self.outcomes) == self.SIZE:
            self.failed -= self.outcomes.popleft()
        self.outcomes.append(bad)
        self.failed += bad

    @staticmethod
    def _rank(values: list[int], percent: int) -> int:
        """percent is below 100, so there is such a value."""
        return values[len(values) * percent // 100]

    def step(self, remote, sent, received):
        trip, trips = received - sent, self.trips
        bad = trip < 0 or (len(trips) >= self.LEAST and trip > self._rank(trips, 90) * 3 // 2)
        self.judge(bad)
        if bad:
            self.refused += 1
        else:
            self.accept(remote - (sent + trip // 2), trip)
        if not trips:
            return False, None, None, "unlocked", self.refused
        n, jitter = len(trips), self._rank(trips, 90) - self._rank(trips, 10)
        locked = n >= self.LEAST and jitter <= 20_000_000 and self.failed / len(self.outcomes) < 0.30
        return not bad, self.offsets[n // 2], self._rank(trips, 50), "locked" if locked else "degraded" if n >= 4 else "unlocked", self.refused


class Shedding:
    """Shedding stage 0 to 3 by free space: rises at once, even over stages, and falls a stage a row at its resume mark."""

    def __init__(self, low: tuple[int, int, int], resume: tuple[int, int, int]):
        self.low, self.resume, self.stage = low, resume, 0

    def step(self, free):
        worst = max((i + 1 for i, mark in enumerate(self.low) if free < mark), default=0)
        if worst > self.stage:
            self.stage = worst
        elif self.stage and free >= self.resume[self.stage - 1]:
            self.stage -= 1
        return (self.stage,)


class Pacing:
    """Whether a report goes out with a row: on a change of severity, or once the interval for it is over."""

    def __init__(self, interval: Callable[[str, bool], int]):
        self.interval, self.last, self.sent = interval, None, None

    def step(self, severity, acked, time):
        send = self.last is None or severity != self.sent or time - self.last >= self.interval(severity, acked)
        if send:
            self.last, self.sent = time, severity
        return (send,)


def report_interval(severity: str, acked: bool) -> int:
    if severity == "critical":
        return 1_000_000_000 if acked else 200_000_000
    return 250_000_000 if severity == "warn" else 1_000_000_000


class Rotation:
    """The segment of a row: a new one when the size or age cap is reached before it, or with a new boot."""

    def __init__(self, most_bytes: int, most_age: int):
        self.most_bytes, self.most_age = most_bytes, most_age
        self.segment, self.size, self.opened, self.boot = 0, 0, None, None

    def step(self, boot, size, time):
        if self.opened is not None and (self.size >= self.most_bytes or time - self.opened >= self.most_age or boot != self.boot):
            self.segment, self.size, self.opened = self.segment + 1, 0, None
        if self.opened is None:
            self.opened, self.boot = time, boot
        self.size += size
        return (self.segment,)


def ewma(df: DataFrame, keys, order, value: str, alpha: float) -> DataFrame:
    return ordered_scan(df, keys, order, lambda: Ewma(alpha), [value], "ewma double, ewma_var double")


def link_quality(df: DataFrame, keys, order, gap: str, interval: str, nominal: int, alpha: float) -> DataFrame:
    """``df`` with lost_share (of messages), rate (nominal interval over the mean one) and jitter (deviation over the nominal interval) after each row.

    A row without an interval leaves rate and jitter as they are; rate is null until the first interval.
    """
    df = ordered_scan(df, keys, order, lambda: LinkState(alpha), [gap, interval], "_gap double, _interval double, _var double")
    g = F.greatest("_gap", F.lit(0.0))
    rate = F.when(F.col("_interval") > 0, nominal / F.col("_interval"))
    return df.withColumns({"lost_share": g / (1 + g), "rate": rate, "jitter": F.sqrt("_var") / nominal}).drop("_gap", "_interval", "_var")


def rls(df: DataFrame, keys, order, u: str, y: str) -> DataFrame:
    return ordered_scan(df, keys, order, Rls, [u, y], "residual double, theta0 double, theta1 double, theta2 double")


def held_severity(df: DataFrame, keys, order, severity: str, time: str, debounce: int, ranks: dict[str, int]) -> DataFrame:
    return ordered_scan(df, keys, order, lambda: Hysteresis(debounce, ranks), [severity, time], "held string")


def time_sync(df: DataFrame, keys, order, remote: str, sent: str, received: str) -> DataFrame:
    return ordered_scan(df, keys, order, TimeSync, [remote, sent, received], "accepted boolean, offset_ns long, rtt_ns long, quality string, rejected long")


def shedding(df: DataFrame, keys, order, free: str, low, resume) -> DataFrame:
    return ordered_scan(df, keys, order, lambda: Shedding(low, resume), [free], "stage int")


def pacing(df: DataFrame, keys, order, severity: str, acked: str, time: str) -> DataFrame:
    return ordered_scan(df, keys, order, lambda: Pacing(report_interval), [severity, acked, time], "send boolean")


def rotation(df: DataFrame, keys, order, boot: str, size: str, time: str, most_bytes: int, most_age: int) -> DataFrame:
    return ordered_scan(df, keys, order, lambda: Rotation(most_bytes, most_age), [boot, size, time], "segment int")


def final_ewma(df: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """The EWMA mean after a key's last row, without Python: values weighted by their place from the end, which sorts spill and sums combine."""
    w = Window.partitionBy(*keys)
    rows = df.filter(~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("x"), F.row_number().over(w.orderBy(order)).alias("nth"), F.count(F.lit(1)).over(w).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("nth")) * F.when(F.col("nth") == 1, 1.0).otherwise(alpha)
    return rows.groupBy(*keys).agg(F.sum(weight * F.col("x")).alias("ewma"))
