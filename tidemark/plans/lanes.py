"""The eight health lanes: each folds its streams into states by event and judges them on ticks.

``lane_states`` adds what windows can compute and leaves true recursions (drift detectors with admission or freezing) to
small folds in ordered scans. States are structs; ``at`` a tick the last one before it counts. The ``judge_*`` functions
turn a state into (availability, severity, action, detail_code, value, limit, confidence) by column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import align, ingest, windows
from tidemark.operators.folds import Cruise, MotorOffsets, Reception, SagAndGrowth, StreamLink, TestRatios, Vibration, Warming
from tidemark.operators.scans import ordered_scan

KEYS = ["mission_id", "epoch"]
ORDER = ["t", "stream_id", "seq"]
LANES = ["battery", "vibration", "estimator", "gps", "motor", "link", "thermal", "mission"]
_FINDING = "struct<availability:string,severity:string,action:string,detail_code:int,value:float,limit:float,confidence:int>"


def _so_far():
    return Window.partitionBy(*KEYS).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


#: Columns of telemetry rows that a lane reads.
_READ = [
    "mission_id", "px4_boot_id", "stream_id", "cc_receive_time_ns", "sequence", "seq_gap", "age_locked", "angular_velocity", "position_ned", "velocity_ned", "heading", "arming_state", "estimator_valid",
    "clipping_count", "vibration_metric", "temperature", "voltage", "current", "consumed_mah", "remaining", "cell_count", "warning", "connected", "eph", "epv", "ground_speed", "noise_per_ms", "jamming_indicator",
    "fix_type", "satellites_used", "velocity_test_ratio", "position_test_ratio", "height_test_ratio", "mag_test_ratio", "innovation_check_flags", "actuator_output", "motor_count",
]


def prepared(events: DataFrame) -> DataFrame:
    """Telemetry rows, in the columns that lanes read, with t, seq (null as 0), epoch (boots so far, told by state rows), phase and speed as of each row.

    State rows alone go through the windows of boots and phases. All rows together are sorted once, by mission: a boot begins
    with a state row, so a value of an earlier boot is told by its epoch.
    """
    df = events.select(*_READ).withColumnsRenamed({"cc_receive_time_ns": "t"}).withColumn("seq", F.coalesce("sequence", F.lit(0))).drop("sequence")
    state = F.col("stream_id") == 0
    told = df.filter(state).withColumn("omega", S.norm(*(F.get("angular_velocity", i) for i in range(3)))).withColumn("hspeed", S.norm(*(F.get("velocity_ned", i) for i in range(2))))
    told = ingest.boot_epoch(told.drop("angular_velocity", "velocity_ned"), ["mission_id"], ORDER, "px4_boot_id")
    flown = windows.flight_phase(told, KEYS, ORDER, "t", "arming_state", "omega").drop("omega")
    both = flown.unionByName(df.filter(~state).drop("angular_velocity", "velocity_ned"), allowMissingColumns=True)
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.col("motor_count").cast("int")))
    throttle = F.aggregate(F.slice("actuator_output", 1, n), F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    values = {
        "phase": F.col("phase"), "throttle": F.when((F.col("stream_id") == 5) & S.finite(throttle), throttle), "ekf_speed": F.col("hspeed"), "ekf_valid": F.when(state, F.col("estimator_valid") != 0),
    }
    out = align.latest(both, ["mission_id"], ORDER, {"epoch": F.col("epoch")}).withColumn("epoch", F.coalesce("epoch", F.lit(0).cast("long"))).withColumns(values)
    out = align.latest(out, ["mission_id"], ORDER, {name: F.when(F.col(name).isNotNull(), F.struct("epoch", name)) for name in values})
    out = out.withColumns({name: F.when(F.col(f"{name}.epoch") == F.col("epoch"), F.col(f"{name}.{name}")) for name in values})
    out = out.withColumn("phase", F.coalesce("phase", F.lit("disarmed"))).withColumn("throttle", F.coalesce("throttle", F.lit(0.0)))
    return out.withColumn("steady", F.col("phase") == "steady")


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _scan(df: DataFrame, keys: list[str], order: list[str], fold, inputs: list[str], outputs: str, kept: list[str] = ()) -> DataFrame:
    """An ordered scan of no more than its keys, its inputs and what is ``kept``: rows of all streams are wide, and each column goes to Python and back."""
    return ordered_scan(df.select(*dict.fromkeys([*KEYS, *ORDER, *keys, *inputs, *kept])), keys, order, fold, inputs, outputs)


def _state(df: DataFrame, lane: str, *columns) -> DataFrame:
    return df.select("mission_id", *ORDER, F.struct("epoch", *columns).alias(lane))


# --- Battery --------------------------------------------------------------------------------------------------------


def battery_states(df: DataFrame) -> DataFrame:
    power = df.filter("stream_id = 2")
    on = F.col("connected") != 0
    missing = F.isnan("remaining") | F.isnan("voltage") | F.isnan("current")
    rows = power.withColumn("on", on).withColumn("valid", on & ~missing)
    good = rows.filter("valid").withColumn("v_cell", _d("voltage") / F.greatest(F.col("cell_count"), F.lit(1)).cast("double")).withColumn("i", _d("current"))
    good = good.withColumn("soc", S.clamp01(_d("remaining"))).withColumn("ocv", S.ocv(F.col("soc"))).withColumn("r_model", S.internal_resistance(F.col("soc"), _d("temperature")))
    good = good.withColumn("v_pred", F.col("ocv") - F.col("i") * F.col("r_model")).withColumn("residual", F.col("v_cell") - F.col("v_pred"))
    good = good.withColumn("r_hat", (F.col("ocv") - F.col("v_cell")) / F.col("i")).withColumn("ratio", F.col("r_hat") / F.col("r_model"))
    loaded = F.col("i") > 2.0
    good = windows.warm(good, KEYS, ORDER, "t", loaded, 20_000_000_000, 50).withColumn("loaded", F.col("warm") & loaded)
    good = windows.gauge_faults(good, KEYS, ORDER, "consumed_mah", "remaining")
    good = good.withColumn("first_ns", F.first("t").over(_so_far())).withColumn("hi", F.sum(loaded.cast("int")).over(_so_far()))
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    good = good.withColumn("before", F.struct(F.lag("consumed_mah").over(w).alias("c"), F.lag("remaining").over(w).alias("r")))
    kept = ["on", "consumed_mah", "remaining", "warning", "before", "gauge_fault", "v_cell", "v_pred", "ocv", "r_hat", "r_model", "first_ns", "hi"]
    good = _scan(good, KEYS, ORDER, SagAndGrowth, ["i", "residual", "ratio", "loaded"], "i_mean double, i_var double, active boolean, sagged double, grown double", kept)
    v_hover = F.col("ocv") - F.col("i_mean") * F.greatest("r_hat", "r_model")
    one = F.lit(1.0).cast("float")
    fell = ((F.col("consumed_mah") + one).cast("float") < F.col("before.c")) & ~F.isnan("before.c")
    conf = lambda e: S.confidence_percent(S.clamp01(0.7 + 0.3 * S.logistic(e)))

    def raised(when, rank, value, limit, confidence):
        made = F.struct(F.lit(rank).alias("rank"), value.cast("float").alias("value"), limit.cast("float").alias("limit"), confidence.cast("int").alias("conf"))
        return F.when(F.coalesce(when, F.lit(False)), made)

    gauge_value, gauge_limit = F.when(fell, F.col("consumed_mah")).otherwise(F.col("remaining")), F.when(fell, F.col("before.c")).otherwise(F.col("before.r"))
    floor = F.lit(3.30)
    best = F.greatest(
        raised(F.col("warning") >= 2, 7, F.col("warning"), F.lit(2.0), F.lit(98)), raised(F.col("warning") == 1, 2, F.col("warning"), F.lit(1.0), F.lit(90)),
        raised(loaded & (F.col("v_cell") < floor), 5, F.col("v_cell"), floor, F.lit(97)), raised(F.col("gauge_fault"), 1, gauge_value, gauge_limit, F.lit(85)),
        raised(F.col("sagged").isNotNull(), 4, F.col("v_cell"), F.col("v_pred"), conf(F.col("sagged"))), raised(F.col("grown").isNotNull(), 3, F.col("r_hat"), F.col("r_model"), conf(F.col("grown"))),
        raised(F.col("active") & S.finite(F.col("r_hat")) & (v_hover < floor), 6, v_hover, floor, F.lit(90)),
    )
    good = good.withColumn("best", best).withColumn("rank", F.coalesce("best.rank", F.lit(0)))
    good = windows.latch(good.withColumns({n: F.col(f"best.{n}") for n in ("value", "limit", "conf")}), KEYS, ORDER, F.col("rank"), ["value", "limit", "conf"])
    # All power rows again, with the state that the valid ones left.
    known = good.select("mission_id", "epoch", *ORDER, "on", F.struct("first_ns", "hi", (F.col("i_var") < 0.25).alias("low"), F.coalesce("latched.rank", F.lit(0)).alias("rank"), "latched.value", "latched.limit", "latched.conf").alias("s"), F.lit(False).alias("nan"))
    others = rows.filter("not valid").select("mission_id", "epoch", *ORDER, "on", F.when(F.col("on"), F.lit(True)).alias("nan"))
    both = align.latest(known.unionByName(others, allowMissingColumns=True), KEYS, ORDER, {"s": F.col("s"), "nan": F.col("nan")})
    return _state(both, "battery", "on", F.coalesce("nan", F.lit(False)).alias("nan"), "s.*")


# --- Vibration ------------------------------------------------------------------------------------------------------


def vibration_states(df: DataFrame) -> DataFrame:
    imu = df.filter("stream_id = 1").withColumn("armed", F.col("phase") != "disarmed").withColumn("metrics", F.transform("vibration_metric", lambda x: x.cast("double")))
    accel = F.get("metrics", F.lit(0))
    counted = F.col("steady") & S.finite(accel)
    imu = imu.withColumns(
        {
            "samples": F.sum(F.col("steady").cast("int")).over(_so_far()), "crit": F.max(counted & (accel >= 60)).over(_so_far()), "warn": F.max(counted & (accel >= 30) & (accel < 60)).over(_so_far()),
            "accel": F.last(F.when(counted, accel), ignorenulls=True).over(_so_far()),
        }
    )
    inputs = ["t", "armed", "steady", "clipping_count", "throttle", "metrics"]
    imu = _scan(imu, KEYS, ORDER, Vibration, inputs, "clip_rate double, n_tripped int, worst int, z double, excess double", ["samples", "crit", "warn", "accel"])
    return _state(imu, "vibration", "clip_rate", "n_tripped", "worst", "z", "excess", "samples", "crit", "warn", "accel")


# --- Estimator ------------------------------------------------------------------------------------------------------


def estimator_states(df: DataFrame) -> DataFrame:
    names = ["velocity_test_ratio", "position_test_ratio", "height_test_ratio", "mag_test_ratio"]
    rows = df.filter("stream_id = 4 and steady").withColumns({n: _d(n) for n in names})
    rows = windows.streak(rows, KEYS, ORDER, F.col("innovation_check_flags") != 0, F.col("innovation_check_flags") == 0, "flagged")
    rows = rows.withColumn("samples", F.count(F.lit(1)).over(_so_far()))
    rows = _scan(rows, KEYS, ORDER, TestRatios, names, "groups int, worst int, ratio double", ["flagged", "samples"])
    return _state(rows, "estimator", "groups", "worst", "ratio", "flagged", "samples")


# --- Position -------------------------------------------------------------------------------------------------------


def gps_states(df: DataFrame) -> DataFrame:
    rows = df.filter("stream_id = 3 and phase != 'disarmed'").withColumns({n: _d(n) for n in ("eph", "epv", "ground_speed", "satellites_used", "noise_per_ms", "jamming_indicator")})
    usable = F.coalesce("ekf_valid", F.lit(False)) & S.finite(F.col("ground_speed"))
    rows = rows.withColumn("apart", F.when(usable, F.abs(F.col("ground_speed") - F.coalesce("ekf_speed", F.lit(0.0)))))
    rows = rows.withColumn("log_eph", F.when(S.finite(F.col("eph")) & (F.col("eph") > 0), F.log("eph")))
    over = lambda c, most: (F.col(c) > most) & ~F.isnan(c)
    for name, bad in {
        "fix": F.col("fix_type") < 3, "few": F.col("satellites_used") < 7, "eph_high": over("eph", 3.0), "epv_high": over("epv", 5.0), "diverged": F.coalesce(over("apart", 3.0), F.lit(False)),
    }.items():
        rows = windows.streak(rows, KEYS, ORDER, bad, ~bad, name)
    rows = rows.withColumns({"apart": F.last("apart", ignorenulls=True).over(_so_far()), "samples": F.count(F.lit(1)).over(_so_far())})
    kept = ["fix", "few", "eph_high", "epv_high", "diverged", "eph", "epv", "apart", "samples"]
    rows = _scan(rows, KEYS, ORDER, Reception, ["steady", "satellites_used", "log_eph", "noise_per_ms", "jamming_indicator"], "sats_down boolean, eph_drift boolean, noise_z double, jam_z double", kept)
    return _state(rows, "gps", "fix", "few", "eph_high", "epv_high", "diverged", "sats_down", "eph_drift", "noise_z", "jam_z", "eph", "epv", F.col("satellites_used").alias("sats"), "apart", "samples")


# --- Motors ---------------------------------------------------------------------------------------------------------


def motor_states(df: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.least(F.lit(4), F.col("motor_count").cast("int")))
    heading = _d("heading")
    turned = F.when((F.col("stream_id") == 0) & F.col("steady") & S.finite(heading), F.call_function("shiftleft", F.lit(1), S.heading_sector(heading)))
    rows = df.filter("stream_id in (0, 5)").withColumn("outputs", F.when((F.col("stream_id") == 5) & F.col("steady"), F.transform(F.slice("actuator_output", 1, n), lambda x: x.cast("double"))))
    rows = rows.withColumn("sectors", F.bit_count(F.bit_or(turned).over(_so_far())))
    # A frame with a missing output tells how many motors count, and nothing else.
    rows = rows.filter(F.col("outputs").isNotNull()).withColumn("motors", F.size("outputs")).withColumn("outputs", F.when(F.forall("outputs", S.finite), F.col("outputs")))
    for i in range(4):
        o = F.get("outputs", F.lit(i))
        rows = windows.streak(rows, KEYS, ORDER, F.coalesce(o >= 0.95, F.lit(False)), F.coalesce(o < 0.95, F.lit(False)), f"full{i}")
    rows = rows.withColumn("samples", F.count("outputs").over(_so_far()))
    rows = _scan(rows, KEYS, ORDER, MotorOffsets, ["outputs", "motors"], "offset double", ["sectors", "samples", *(f"full{i}" for i in range(4))])
    full = reduce(lambda a, b: a | b, [(F.col(f"full{i}") >= 20) & (F.col("motors") > i) for i in range(4)])
    return _state(rows, "motor", "offset", full.alias("full"), F.coalesce("sectors", F.lit(0)).alias("sectors"), "samples")


# --- Link -----------------------------------------------------------------------------------------------------------


def link_states(df: DataFrame) -> DataFrame:
    keys = [*KEYS, "stream_id"]
    rows = df.filter("stream_id < 6").select("mission_id", "epoch", *ORDER, _d("seq_gap").alias("gap"))
    rows = ingest.inter_arrival(rows, keys, ["t", "seq"], "t").withColumn("dt", _d("dt"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "seq")))
    rows = _scan(rows, keys, ["t", "seq"], StreamLink, ["gap", "dt"], "gap_mean double, interval double, spread double, lossy boolean", ["n"])
    period = S.lookup(ingest.PERIOD_NS, F.col("stream_id").cast("int")).cast("double")
    g = F.greatest("gap_mean", F.lit(0.0))
    share = g / (1 + g)
    counted = F.when(
        F.col("n") >= 20,
        F.struct(F.when(F.col("lossy"), F.greatest(share, F.lit(0.10))).otherwise(share).alias("drop"), F.when(F.col("interval") > 0, period / F.col("interval")).alias("rate"), (F.col("spread") / period).alias("jitter")),
    )
    rows = rows.withColumn("judged", counted)
    rows = align.latest(rows, KEYS, ORDER, {f"s{k}": F.when(F.col("stream_id") == k, F.col("judged")) for k in range(6)})
    each = F.filter(F.array(*(f"s{k}" for k in range(6))), lambda s: s.isNotNull())
    top = lambda f, start: F.aggregate(each, F.lit(start), f)
    return _state(
        rows, "link", F.count(F.lit(1)).over(_so_far()).alias("messages"), top(lambda a, s: F.greatest(a, s["drop"]), 0.0).alias("drop"), top(lambda a, s: F.least(a, F.coalesce(s["rate"], a)), 1.0).alias("rate"),
        top(lambda a, s: F.greatest(a, s["jitter"]), 0.0).alias("jitter"),
    )


# --- Temperature ----------------------------------------------------------------------------------------------------


def thermal_states(df: DataFrame, stream: int, lane: str) -> DataFrame:
    rows = df.filter(F.col("stream_id") == stream).select("mission_id", "epoch", *ORDER, _d("temperature").alias("value"))
    good = windows.despiked(rows.filter(S.finite(F.col("value"))), KEYS, ORDER, "value")
    good = good.withColumn("n", F.count(F.lit(1)).over(_so_far()))
    good = _scan(good, KEYS, ORDER, Warming, ["t", "despiked"], "level double, rate double", ["n"])
    known = good.select("mission_id", "epoch", *ORDER, F.struct("level", "rate", "n").alias("s"), F.lit(False).alias("nan"))
    others = rows.filter(~S.finite(F.col("value"))).select("mission_id", "epoch", *ORDER, F.lit(True).alias("nan"))
    both = align.latest(known.unionByName(others, allowMissingColumns=True), KEYS, ORDER, {"s": F.col("s")})
    return _state(both, lane, "nan", "s.*")


# --- Mission --------------------------------------------------------------------------------------------------------


def mission_states(df: DataFrame) -> DataFrame:
    rows = df.filter("stream_id in (0, 2) and phase != 'disarmed'")
    north, east = F.col("n"), F.col("e")
    rows = rows.withColumn("n", F.get("position_ned", F.lit(0)).cast("double")).withColumn("e", F.get("position_ned", F.lit(1)).cast("double"))
    placed = (F.col("stream_id") == 0) & S.finite(north) & S.finite(east)
    home = F.first(F.when(placed, F.struct("n", "e")), ignorenulls=True).over(_so_far())
    rows = rows.withColumn("home", home).withColumn("away", F.when(placed, S.norm(F.col("n") - F.col("home.n"), F.col("e") - F.col("home.e"))))
    power = F.col("stream_id") == 2
    rows = rows.withColumn("amps", F.when(power & F.col("steady") & S.finite(_d("current")), _d("current")))
    rows = rows.withColumn("fast", F.when((F.col("stream_id") == 0) & F.col("steady") & (F.col("hspeed") > 2.0) & S.finite(F.col("hspeed")), F.col("hspeed")))
    rest = F.when(power & S.finite(_d("remaining")), S.clamp01(_d("remaining")))
    rows = align.latest(rows, KEYS, ORDER, {"rest": rest, "on": F.when(power, F.col("connected") != 0), "away": F.col("away")})
    rows = _scan(rows, KEYS, ORDER, Cruise, ["amps", "fast"], "amps_mean double, amps_n int, speed_mean double, speed_n int", ["rest", "on", "away"])
    return _state(rows, "mission", F.coalesce("away", F.lit(0.0)).alias("away"), "rest", F.coalesce("on", F.lit(False)).alias("on"), "amps_mean", "amps_n", "speed_mean", "speed_n")


# --- Judging on ticks -----------------------------------------------------------------------------------------------


def _made(severity: str, action: str, code, value, limit, confidence) -> Column:
    cast = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        F.lit("available").alias("availability"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), cast(code, "int").alias("detail_code"),
        cast(value, "float").alias("value"), cast(limit, "float").alias("limit"), cast(confidence, "int").alias("confidence"),
    )


def _warn(code, value, limit, confidence, action="warn_only"):
    return _made("warn", action, code, value, limit, confidence)


def _crit(code, value, limit, confidence, action="land"):
    return _made("critical", action, code, value, limit, confidence)


def _ok() -> Column:
    return _made("ok", "none", 0, 0.0, 0.0, 100)


def _away(availability: str, code: int) -> Column:
    return F.struct(
        F.lit(availability).alias("availability"), F.lit("ok").alias("severity"), F.lit("none").alias("action"), F.lit(code).cast("int").alias("detail_code"),
        F.lit(0.0).cast("float").alias("value"), F.lit(0.0).cast("float").alias("limit"), F.lit(0).cast("int").alias("confidence"),
    )


def _pct(x: Column) -> Column:
    return S.confidence_percent(S.clamp01(x))


def _cases(*pairs, otherwise: Column) -> Column:
    out = None
    for when, then in pairs:
        when = F.coalesce(when, F.lit(False))
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def judged(seen: Column, tick: Column, phase: Column) -> dict[str, Column]:
    """The finding of each lane on a tick from its state column; ``seen`` (array) has the last receive time of each stream."""
    stale, no_data = _away("unavailable", 9002), _away("unavailable", 9005)
    warmup, nan_input, low_excitation = _away("degraded", 9001), _away("degraded", 9003), _away("degraded", 9004)
    fresh = lambda k: ingest.fresh(tick, F.coalesce(F.get(seen, F.lit(k)), F.lit(0)), ingest.PERIOD_NS[k])
    c = F.col
    few = lambda column, n: F.coalesce(c(column), F.lit(0)) < n
    rank, ev = F.coalesce(c("battery.rank"), F.lit(0)), (c("battery.value"), c("battery.limit"), c("battery.conf"))
    warm = (tick - c("battery.first_ns") >= 20_000_000_000) & (c("battery.hi") >= 50)
    out = {
        "battery": _cases(
            (~fresh(2), stale), (~c("battery.on"), no_data), (c("battery.nan"), nan_input), (~F.coalesce(warm, F.lit(False)), warmup), ((rank == 0) & c("battery.low"), low_excitation), (rank == 0, _ok()),
            (rank >= 5, _crit(F.when(rank == 7, 1010).otherwise(1005), *ev)), otherwise=_warn(S.lookup({1: 1004, 2: 1010, 3: 1002, 4: 1001}, rank), *ev),
        ),
        "vibration": _cases(
            (~fresh(1), stale), (few("vibration.samples", 150), warmup), (c("vibration.crit"), _crit(3006, c("vibration.accel"), 60.0, 95)), (c("vibration.clip_rate") >= 20, _crit(3005, c("vibration.clip_rate"), 20.0, 90)),
            (c("vibration.n_tripped") >= 2, _crit(3004, c("vibration.z"), 0.0, _pct(0.75 + 0.25 * S.logistic(c("vibration.excess"))))), (c("vibration.clip_rate") >= 2, _warn(3005, c("vibration.clip_rate"), 2.0, 85)),
            (c("vibration.warn"), _warn(3006, c("vibration.accel"), 30.0, 80)), (c("vibration.n_tripped") == 1, _warn(c("vibration.worst") + 3001, c("vibration.z"), 0.0, _pct(0.7 + 0.3 * S.logistic(c("vibration.excess"))))),
            otherwise=_ok(),
        ),
    }
    ratio = c("estimator.ratio")
    conf = S.clamp01(0.7 + 0.3 * S.logistic(ratio - 1.0))
    out["estimator"] = _cases(
        (~fresh(4), stale), (few("estimator.samples", 50), warmup), (c("estimator.worst").isNull() & (c("estimator.flagged") >= 10), _warn(5006, c("estimator.flagged"), 10.0, 70, "block_offboard")), (c("estimator.worst").isNull(), _ok()),
        (c("estimator.groups") >= 2, _crit(5008, ratio, 1.0, _pct(conf + 0.1), "hold")), otherwise=_warn(c("estimator.worst") + 5001, ratio, 1.0, S.confidence_percent(conf), "block_offboard"),
    )
    high, drift = c("gps.eph_high") >= 5, c("gps.eph_drift")
    tall = c("gps.epv_high") >= 5
    g = (c("gps.few") >= 5) | c("gps.sats_down") | high | drift | tall
    noisy, jammed = F.coalesce(c("gps.noise_z") >= 4.0, F.lit(False)), F.coalesce(c("gps.jam_z") >= 4.0, F.lit(False))
    r, d = noisy | jammed, c("gps.diverged") >= 5
    pick = lambda *v: F.when(g & (high | drift), v[0]).when(g & tall, v[1]).when(g, v[2]).when(jammed, v[3]).when(noisy, v[4]).otherwise(v[5])
    code = pick(*(F.lit(x) for x in (4003, 4004, 4002, 4005, 4006, 4007)))
    value = pick(c("gps.eph"), c("gps.epv"), c("gps.sats"), c("gps.jam_z"), c("gps.noise_z"), c("gps.apart"))
    limit = pick(F.when((c("gps.eph") > 6.0) & ~F.isnan("gps.eph"), 6.0).otherwise(3.0), F.lit(5.0), F.lit(7.0), F.lit(4.0), F.lit(4.0), F.lit(3.0))
    groups = g.cast("int") + r.cast("int") + d.cast("int")
    out["gps"] = _cases(
        (~fresh(3), stale), (few("gps.samples", 30), warmup), (c("gps.fix") >= 5, _crit(4001, 0.0, 3.0, 95, "hold")), (groups >= 2, _crit(code, value, limit, _pct(0.8 + 0.15 * S.logistic(c("gps.eph") - 3.0)), "hold")),
        (groups == 1, _warn(code, value, limit, 75)), otherwise=_ok(),
    )
    e = F.abs("motor.offset")
    off = F.coalesce(e > 0.08, F.lit(False))
    turning = F.least(F.lit(70), S.confidence_percent(S.clamp01(0.4 + 3.0 * (e - 0.08))))
    out["motor"] = _cases(
        (~fresh(5), stale), (few("motor.samples", 100), warmup), (off & c("motor.full"), _warn(2005, e, 0.08, 70)), (off & (c("motor.sectors") >= 3), _warn(2001, e, 0.08, turning)), (off, _warn(2003, e, 0.08, 45)),
        (c("motor.full"), _warn(2002, 1.0, 0.95, 60)), otherwise=_ok(),
    )
    drop, rate, jitter = c("link.drop"), c("link.rate"), c("link.jitter")
    out["link"] = _cases(
        (c("link").isNull(), no_data), (c("link.messages") < 150, warmup), (drop >= 0.10, _warn(7001, drop, 0.10, _pct(0.6 + 0.4 * S.logistic((drop - 0.10) * 20.0)))),
        (rate <= 0.60, _warn(7002, rate, 0.60, _pct(0.6 + 0.4 * S.logistic((0.60 - rate) * 5.0)))), (jitter >= 1.0, _warn(7006, jitter, 1.0, 70)), otherwise=_ok(),
    )
    out["thermal"] = _thermal(fresh)
    soc = S.soc_at_home(c("mission.rest"), c("mission.away"), F.when(c("mission.speed_n") >= 20, F.greatest(c("mission.speed_mean"), F.lit(2.0))).otherwise(8.0), c("mission.amps_mean"))
    known = c("mission.on") & c("mission.rest").isNotNull() & (c("mission.amps_n") >= 20)
    out["mission"] = _cases(
        (~fresh(2) | ~fresh(0), stale), (phase == "disarmed", _ok()), (few("mission.amps_n", 30), warmup), (c("mission.away") < 20.0, _ok()), (~F.coalesce(known, F.lit(False)), low_excitation),
        (soc < 0.10, _crit(8002, soc, 0.10, _pct(0.85 + 0.15 * S.logistic((0.10 - soc) * 30.0)), "rtl")), (soc < 0.20, _warn(8001, soc, 0.20, 80)), otherwise=_ok(),
    )
    return out


def _thermal(fresh) -> Column:
    """The hotter verdict of battery and IMU; the battery's counts first at equal severity."""
    c = F.col
    conf = lambda base, value, limit: _pct(base + 0.1 * S.logistic(value - limit))
    ready = lambda n: F.coalesce(~c(f"{n}.nan") & (c(f"{n}.n") >= 15), F.lit(False))
    b, br = c("warm_battery.level"), c("warm_battery.rate")
    none = F.lit(None).cast(_FINDING)
    battery = _cases(
        (~fresh(2) | ~ready("warm_battery"), none), (b >= 65, _crit(6001, b, 65.0, conf(0.95, b, 65.0))), ((b >= 50) & (br >= 1.5), _crit(6002, br, 1.5, conf(0.9, br, 1.5))),
        (b >= 55, _warn(6001, b, 55.0, conf(0.8, b, 55.0))), ((b >= 50) & (br >= 0.5), _warn(6002, br, 0.5, conf(0.75, br, 0.5))), otherwise=none,
    )
    i, ir = c("warm_imu.level"), c("warm_imu.rate")
    imu = _cases(
        (~fresh(1) | ~ready("warm_imu"), none), (i >= 85, _warn(6003, i, 85.0, conf(0.85, i, 85.0))), (i >= 70, _warn(6003, i, 70.0, conf(0.75, i, 70.0))), ((i >= 65) & (ir >= 1.0), _warn(6004, ir, 1.0, conf(0.7, ir, 1.0))),
        otherwise=none,
    )
    return _cases((~fresh(2) & ~fresh(1), _away("unavailable", 9002)), (fresh(2) & c("warm_battery.nan"), _away("degraded", 9003)), otherwise=F.coalesce(battery, imu, _ok()))


def lane_states(df: DataFrame) -> list[DataFrame]:
    return [
        battery_states(df), vibration_states(df), estimator_states(df), gps_states(df), motor_states(df), link_states(df), thermal_states(df, 2, "warm_battery"), thermal_states(df, 1, "warm_imu"), mission_states(df),
    ]


STATES = ["battery", "vibration", "estimator", "gps", "motor", "link", "warm_battery", "warm_imu", "mission"]
