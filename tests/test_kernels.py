"""Detectors against plain recursions, scalars against plain arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import align, ingest, scans, windows


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k long, i long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.fixture(scope="module")
def noise():
    rnd = random.Random(5)
    return [rnd.gauss(0, 1) + (1.5 if i > 150 else 0) for i in range(300)]


def test_cusum_windows_equal_the_recursion(spark, noise):
    got = windows.cusum(series(spark, noise), ["k"], ["i"], "x", 0.0, 0.5, 4.0).orderBy("i").collect()
    fold = scans.Drift(0.5, 4.0)
    for row, x in zip(got, noise):
        trip = fold.update(x, 0.0)
        assert row.cusum_up == pytest.approx(fold.up, abs=1e-9) and row.cusum_down == pytest.approx(fold.down, abs=1e-9)
        assert row.trip == trip


def test_page_hinkley_windows_equal_the_recursion(spark, noise):
    got = windows.page_hinkley(series(spark, noise), ["k"], ["i"], "x", 0.5, 6.0).orderBy("i").collect()
    up, down = scans.PageHinkley(1, 0.5, 6.0), scans.PageHinkley(-1, 0.5, 6.0)
    for row, x in zip(got, noise):
        up.update(x), down.update(x)
        assert row.ph_up == pytest.approx(up.value(), abs=1e-8) and row.ph_down == pytest.approx(down.value(), abs=1e-8)
        assert row.trip_up == (up.value() > 6.0)


def test_rows_that_tie_in_order_are_one_step_of_the_drift_sums(spark):
    rows = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (1, 1, -2.0), (1, 2, 1.0)], "k long, i long, x double")
    got = windows.cusum(rows, ["k"], ["i"], "x", 0.0, 0.5, 4.0).orderBy("i").collect()
    assert [(r.cusum_up, r.cusum_down, r.trip) for r in got] == [(2.5, 0.0, None), (3.5, 0.0, None), (3.5, 0.0, None), (4.0, 0.0, None)]
    got = windows.page_hinkley(rows, ["k"], ["i"], "x", 0.5, 2.5).orderBy("i").collect()
    want = {0: (0.0, 0.0), 1: (0.0, 1 / 3), 2: (0.0, 1 / 3)}  # means 3, 5/3 and 1.5; sums down 1/2, 1/6 and 1/6
    for r in got:
        assert (r.ph_up, r.ph_down) == pytest.approx(want[r.i])


def test_rolling_z_equals_the_fold(spark, noise):
    got = column(windows.rolling_z(series(spark, noise), ["k"], ["i"], "x", 32, 0.01), "z")
    fold = scans.Robust(32, 0.01)
    for z, x in zip(got, noise):
        fold.update(x)
        assert z == pytest.approx(fold.z(x), abs=1e-9)


def test_flight_phase_equals_a_state_machine(spark):
    rnd = random.Random(7)
    rows = [(1, i, i * 40_000_000, rnd.choice([2] * 60 + [1]), rnd.choice([0.1, 0.3, 0.5, math.nan]) if rnd.random() < 0.3 else [0.1, 0.6][i // 25 % 2]) for i in range(1500)]
    got = column(windows.flight_phase(spark.createDataFrame(rows, "k long, i long, t long, arming int, omega double"), ["k"], ["i"], "t", "arming", "omega"), "phase")
    since, over, under, inside, want = None, 0, 0, False, []
    for _, _, t, arming, omega in rows:
        if arming != 2:
            since, over, under, inside = None, 0, 0, False
            want.append("disarmed")
            continue
        since = t if since is None else since
        omega = math.inf if omega != omega else omega
        over, under = (over + 1, 0) if omega > 0.35 else (0, under + 1) if omega < 0.25 else (0, 0)
        inside = True if over >= 5 else False if under >= 5 else inside
        want.append("transient" if t - since < 3_000_000_000 else "maneuver" if inside else "steady")
    assert got == want


def test_streak_holds_between_bad_and_reset(spark):
    values = [1.2, 1.2, 0.95, 1.2, 0.5, 1.2]
    got = column(windows.streak(series(spark, values), ["k"], ["i"], F.col("x") > 1, F.col("x") < 0.9), "streak")
    assert got == [1, 2, 2, 3, 0, 1]


def test_latch_keeps_the_first_of_the_highest_rank(spark):
    got = column(windows.latch(series(spark, [0, 1, 1.5, 3, 3.5, 2]), ["k"], ["i"], F.floor("x"), ["x"]), "latched")
    assert [None if g is None else (g.rank, g.x) for g in got] == [None, (1, 1.0), (1, 1.0), (3, 3.0), (3, 3.0), (3, 3.0)]


def test_ewma_passes_over_missing_values_and_keys_are_apart(spark):
    df = series(spark, [1, math.nan, 3], 1).unionByName(series(spark, [10, 20], 2))
    got = {(r.k, r.i): r.ewma for r in scans.ewma(df, ["k"], ["i"], "x", 0.5).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 2.0, (2, 0): 10.0, (2, 1): 15.0}


def test_rls_finds_a_parabola(spark):
    rows = [(1, i, u := (i % 20) / 20, 2 + 3 * u - u * u) for i in range(400)]
    last = scans.rls(spark.createDataFrame(rows, "k long, i long, u double, y double"), ["k"], ["i"], "u", "y").orderBy(F.desc("i")).first()
    assert (last.theta0, last.theta1, last.theta2) == pytest.approx((2, 3, -1), abs=2e-2)


def test_time_sync_refuses_slow_exchanges():
    fold = scans.TimeSync()
    for i in range(10):
        ok, offset, _, quality, _ = fold.step(i * 1000 + 500 + 7, i * 1000, i * 1000 + 1000)
    assert ok and offset == 7 and quality == "locked"
    assert fold.step(0, 0, 5000)[0] is False and fold.step(0, 100, 0)[4] == 2


@pytest.mark.parametrize("spread", [3, 1000, 10**8])
def test_time_sync_keeps_its_windows_sorted(spread):
    rnd, fold, accepted, outcomes = random.Random(spread), scans.TimeSync(), [], []
    rank = lambda v, percent: sorted(v)[min(len(v) * percent // 100, len(v) - 1)]
    for i in range(600):
        sent, trip, late = 1000 * i, rnd.randrange(-spread // 10 - 1, spread), rnd.randrange(9)
        trips = [r for _, r in accepted]
        bad = trip < 0 or (len(trips) >= 8 and trip > rank(trips, 90) * 3 // 2)
        accepted, outcomes = accepted if bad else [*accepted, (late - trip // 2, trip)][-32:], [*outcomes, bad][-32:]
        ok, offset, rtt, _, _ = fold.step(sent + late, sent, sent + trip)
        assert (ok, offset, rtt) == ((not bad, rank([o for o, _ in accepted], 50), rank([r for _, r in accepted], 50)) if accepted else (False, None, None))
        assert list(zip(fold.offsets, fold.trips)) == list(zip(sorted(o for o, _ in accepted), sorted(r for _, r in accepted)))
        assert fold.failed == sum(outcomes) and list(fold.accepted) == accepted and list(fold.outcomes) == outcomes


def test_hysteresis_rises_at_once_and_falls_after_a_time():
    fold = scans.Hysteresis(10, S.HOLD_RANK)
    assert [fold.step(s, t)[0] for s, t in [("critical", 0), ("ok", 1), ("warn", 5), ("ok", 8), ("ok", 17), ("ok", 18)]] == ["critical"] * 5 + ["ok"]


def test_shedding_skips_up_and_steps_down():
    fold = scans.Shedding((400, 200, 50), (600, 300, 100))
    assert [fold.step(x)[0] for x in (1000, 30, 90, 100, 350, 350, 700)] == [0, 3, 3, 2, 1, 1, 0]


def test_sequence_gaps(spark):
    rows = [(1, i, s) for i, s in enumerate([10, 11, 15, 15, 14, 2**32 - 1, 0, 2])]
    got = [r.seq_gap for r in ingest.seq_gap(spark.createDataFrame(rows, "k long, i long, sequence long"), ["k"], ["i"]).orderBy("i").collect()]
    assert got == [0, 0, 3, 0, 0, 0, 0, 1]


def test_ticks_see_only_what_came_before(spark):
    df = spark.createDataFrame([(1, 50, 1), (1, 100, 2), (1, 250, 3), (1, 250, None)], "k long, t long, v long")
    got = align.at_ticks(df, ["k"], "t", ["t"], ["v"], 100).orderBy("tick").collect()
    assert [(r.tick, r.v) for r in got] == [(100, 1), (200, 2)]


@pytest.mark.parametrize("x, want", [(0.0, 0), (1.0, 100), (0.125, 12), (0.135, 14), (0.5, 50), (float("nan"), 0), (2.0, 100), (0.8451, 85)])
def test_confidence_rounds_half_to_even(spark, x, want):
    assert spark.range(1).select(S.confidence_percent(F.lit(x)).alias("p")).first().p == want


def test_ocv_interpolates_and_clamps(spark):
    got = [r.v for r in spark.createDataFrame([(1.5,), (0.95,), (0.05,), (0.025,), (-1.0,), (math.nan,)], "s double").select(S.ocv(F.col("s")).alias("v")).collect()]
    assert got == pytest.approx([4.20, 4.125, 3.40, 3.35, 3.30, 3.30])


def test_empty_tables_and_nulls_pass(spark):
    empty = spark.createDataFrame([], "k long, i long, x double")
    assert windows.cusum(empty, ["k"], ["i"], "x", 0.0, 0.5, 4.0).count() == 0
    assert scans.ewma(empty, ["k"], ["i"], "x", 0.5).count() == 0
    assert align.at_ticks(empty.withColumn("t", F.col("i")), ["k"], "t", ["t"], ["x"], 10).count() == 0
