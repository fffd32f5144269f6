"""All lanes and conclusions on random faulty flights, tick by tick, against the sequential interpreter."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.sequential import concluded, fly
from tidemark.operators.aggregates import merge_findings
from tidemark.plans import replay, traces

MISSIONS, SECONDS = 8, 60
S = 1_000_000_000


def chance(name):
    """A number in [0, 1) that hangs on mission, row and name alone."""
    return F.pmod(F.xxhash64("mission_id", "seq", F.lit(name)), F.lit(100_000)) / 100_000.0


def faulty(spark):
    m, t = F.col("mission_id"), F.col("t")
    nan = F.lit(float("nan"))
    between = lambda a, b: (t >= a * S) & (t < b * S)

    def noise(name, scale, *cases):
        def made(calm):
            out = calm + (chance(name) - 0.5) * scale
            for mission, when, value in cases:
                out = F.when((m == mission) & when, value(calm) if callable(value) else value).otherwise(out)
            return out

        return made

    def only(*cases):
        return noise("", 0.0, *cases)

    def vector(name, scale, *cases, calm):
        def made(_):
            out = F.array(*(F.lit(x) + (chance(f"{name}{i}") - 0.5) * scale * (abs(x) + 0.02) for i, x in enumerate(calm)))
            for mission, when, value in cases:
                out = F.when((m == mission) & when, F.array(*(F.lit(v) if not hasattr(v, "alias") else v for v in value))).otherwise(out)
            return out

        return made

    late = t > 35 * S
    rare = lambda name, share: chance(name + "?") < share
    out = [0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0]
    faults = {
        ("state", "angular_velocity"): vector("w", 0.4, (3, between(15, 20) & rare("w", 0.9), (0.5, 0.0, 0.0)), (3, between(30, 31), (nan, 0.0, 0.0)), (3, between(40, 45) & rare("w", 0.5), (0.3, 0.0, 0.0)), calm=[0.02, 0.01, 0.0]),
        ("state", "velocity_ned"): vector("v", 1.0, (1, between(30, 45), (nan, 0.0, 0.0)), (7, late, (9.0, 1.0, 0.0)), calm=[0.1, 0.0, 0.0]),
        ("state", "position_ned"): vector("p", 0.1, (1, rare("p", 0.1), (nan, 0.0, 0.0)), (7, late, ((t - 35 * S) / 1e9 * 400.0, F.lit(3.0), F.lit(-10.0))), calm=[1.0, 1.0, -10.0]),
        ("state", "heading"): only((5, t > 40 * S, F.pmod(t / 1e9, F.lit(6.0)) - 3.0), (1, rare("h", 0.1), nan)),
        ("state", "arming_state"): only((2, between(44, 46), F.lit(1)), (7, t < 2 * S, F.lit(1))),
        ("imu", "vibration_metric"): vector("m", 0.6, (1, rare("m", 0.05), (nan, 0.05, 0.0005)), (4, t > 45 * S, (14.0, 0.2, 0.0005)), (3, between(50, 50.1), (35.0, 0.05, 0.0005)), (0, t > 55 * S, (8.0, 0.3, 0.0005)), calm=[8.0, 0.05, 0.0005]),
        ("imu", "clipping_count"): only((6, between(20, 40), (F.col("seq") * 0.1).cast("long")), (2, late, F.col("seq"))),
        ("imu", "temperature"): noise("it", 0.5, (1, rare("it", 0.1), nan), (2, late, lambda c: c + (t - 35 * S) / 1e9 * 1.2)),
        ("power", "voltage"): noise("u", 0.1, (4, late, lambda c: c - (t - 35 * S) / 1e9 * 0.08), (6, t > 55 * S, F.lit(13.0)), (1, rare("u", 0.01), nan)),
        ("power", "current"): noise("i", 4.0, (3, t < 60 * S, F.lit(10.0)), (1, rare("i", 0.01), nan)),
        ("power", "consumed_mah"): only((1, rare("c", 0.1), nan), (2, between(40, 41), F.lit(1.0))),
        ("power", "remaining"): only((1, rare("r", 0.02), nan), (7, t > 1 * S, F.lit(0.3)), (5, between(50, 51), F.lit(0.95))),
        ("power", "temperature"): noise("pt", 0.5, (1, rare("pt", 0.05), nan), (7, late, lambda c: c + (t - 35 * S) / 1e9 * 1.8)),
        ("power", "warning"): only((0, between(50, 52), F.lit(1)), (0, between(53, 54), F.lit(2))),
        ("power", "connected"): only((5, between(40, 41), F.lit(0)), (7, between(48, 49), F.lit(0))),
        ("gps", "eph"): noise("eph", 0.2, (4, between(40, 48), F.lit(7.0)), (4, t >= 48 * S, F.when(rare("e2", 0.5), nan).otherwise(F.lit(2.5))), (1, rare("e", 0.1), nan)),
        ("gps", "epv"): noise("epv", 0.2, (0, between(30, 35), F.lit(6.0)), (1, rare("ev", 0.2), nan)),
        ("gps", "ground_speed"): noise("gs", 0.1, (4, between(50, 55), F.lit(6.0)), (3, late, F.lit(5.0)), (1, rare("g", 0.1), nan)),
        ("gps", "noise_per_ms"): only((5, t > 0, (80 + chance("n") * 5).cast("int")), (5, between(52, 54), F.lit(200))),
        ("gps", "jamming_indicator"): only((6, between(50, 52), F.lit(90)), (4, between(50, 52), F.lit(90))),
        ("gps", "fix_type"): only((2, between(20, 23), F.lit(1))),
        ("gps", "satellites_used"): only((0, between(40, 45), F.lit(6)), (6, between(20, 30), F.lit(10))),
        ("estimator", "velocity_test_ratio"): noise("vr", 0.2, (3, between(50, 55), F.lit(1.3)), (1, rare("vr", 0.1), nan)),
        ("estimator", "position_test_ratio"): noise("pr", 0.2, (3, between(52, 56), F.lit(1.5)), (0, between(20, 25), F.lit(0.95))),
        ("estimator", "mag_test_ratio"): noise("mr", 0.2, (3, between(53, 55), F.lit(1.4)), (5, between(40, 50), F.lit(0.85))),
        ("estimator", "innovation_check_flags"): only((5, between(30, 33), F.lit(4))),
        ("actuator", "actuator_output"): vector("o", 0.1, (5, between(25, 45), (0.6, 0.5, 0.97, 0.5, 0.0, 0.0, 0.0, 0.0)), (5, between(45, 47), (nan, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0)), (1, rare("o", 0.1), (nan, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0)), (6, t > 20 * S, (0.4, 0.5, 0.6, 0.8, 0.0, 0.0, 0.0, 0.0)), calm=out),
        ("actuator", "motor_count"): only((5, between(45, 50), F.lit(2)), (6, t > 45 * S, F.lit(3)), (3, t > 0, F.lit(0))),
        ("imu", "seq_gap"): only((6, between(30, 36), (chance("gap") * 4).cast("int"))),
    }
    boot = F.when((m == 2) & (t > 30 * S), 8).otherwise(7)
    df = traces.flights(spark, MISSIONS, SECONDS, faults, boot)
    at, k, seq = F.col("cc_receive_time_ns"), F.col("stream_id"), F.col("sequence")
    lost = ((F.col("mission_id") == 6) & (k == 4) & (at > 40 * S)) | ((F.col("mission_id") == 0) & (k == 1) & (at > 57 * S)) | ((F.col("mission_id") == 5) & (k == 3) & (seq % 3 > 0) & (at < 25 * S))
    # Rows come up to 30 ms late, some at equal times.
    moved = at + F.pmod(F.xxhash64("mission_id", "stream_id", "sequence"), F.lit(4)) * 10_000_000 + 1
    return df.filter(~lost).withColumn("cc_receive_time_ns", moved).withColumn("age_locked", F.pmod(F.xxhash64("sequence"), F.lit(7)) > 0)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flights") / "events")
    faulty(spark).repartition(4, "mission_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def expected(events):
    rows = {}
    for r in events.withColumn("t", F.col("cc_receive_time_ns")).orderBy("mission_id", "t", "stream_id", "sequence").collect():
        rows.setdefault(r.mission_id, []).append(SimpleNamespace(**r.asDict()))
    return {mission: fly(flown) for mission, flown in rows.items()}


@pytest.fixture(scope="module")
def findings(events):
    return replay.lane_findings(events).cache()


def same(a, b):
    """Texts and whole numbers are equal, and other numbers to the last bits of 32."""
    return all((x != x and y != y) or x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-6)) for x, y in zip(a, b, strict=True))


COLUMNS = ["severity", "action", "detail_code", "value", "limit", "confidence"]


def test_every_lane_on_every_tick(findings, expected):
    found = {(r.mission_id, r.tick, r.lane): tuple(r[c] for c in ["availability", *COLUMNS]) for r in findings.collect()}
    wanted = {(mission, tick, lane): f for mission, flown in expected.items() for tick, said, _ in flown for lane, f in said.items()}
    assert found.keys() == wanted.keys()
    wrong = {k: (found[k], wanted[k]) for k in wanted if not same(wanted[k], found[k])}
    assert not wrong, (len(wrong), sorted({(k[0], k[2]) for k in wrong}), sorted(wrong.items())[:4])
    # The flights reach most of what the lanes can say.
    assert len({f[3] for f in wanted.values()}) >= 25


def test_conclusions(findings, expected):
    found = {(r.mission_id, r.tick): tuple(r[c] for c in ["severity", "action", "health_flags", *COLUMNS[2:]]) for r in merge_findings(findings, ["mission_id", "tick"]).collect()}
    wanted = {(mission, tick): concluded(said, locked) for mission, flown in expected.items() for tick, said, locked in flown}
    assert found.keys() == wanted.keys()
    wrong = {k: (found[k], wanted[k]) for k in wanted if not same(wanted[k], found[k])}
    assert not wrong, (len(wrong), sorted(wrong.items())[:4])


def test_missions_of_the_events_table(spark, tmp_path):
    """The replay queries' own missions, whole, against the interpreter."""
    from tidemark.plans.adapters import missions

    missions(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "m"))
    events = spark.read.parquet(str(tmp_path / "m"))
    rows = {}
    for r in events.withColumn("t", F.col("cc_receive_time_ns")).orderBy("mission_id", "t", "stream_id", "sequence").collect():
        rows.setdefault(r.mission_id, []).append(SimpleNamespace(**r.asDict()))
    wanted = {(m, tick): concluded(said, locked) for m, flown in rows.items() for tick, said, locked in fly(flown)}
    found = {(r.mission_id, r.tick): tuple(r[c] for c in ["severity", "action", "health_flags", *COLUMNS[2:]]) for r in replay.replay(events).collect()}
    assert found.keys() == wanted.keys() and len({w[3] for w in wanted.values()}) >= 3
    wrong = {k: (found[k], wanted[k]) for k in wanted if not same(wanted[k], found[k])}
    assert not wrong, (len(wrong), sorted(wrong.items())[:4])
