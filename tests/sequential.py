"""A plain interpreter of the eight lanes, one row after another, that windows and scans are held against.

It shares only the small kernels (means, drift sums, robust scales, least squares) with the library; those have oracles of their own.
"""

import math
from collections import defaultdict

import numpy as np

from tidemark.functions.scalars import FLAG, OCV, PRIORITY
from tidemark.operators.ingest import PERIOD_NS
from tidemark.operators.scans import NAN, Drift, Ewma, PageHinkley, Rls, Robust

STEP = 100_000_000
f32 = np.float32


def finite(x):
    return x is not None and math.isfinite(x)


def clamp(x):
    return 0.0 if x != x else min(1.0, max(0.0, x))


def sigmoid(x):
    return 1.0 if x >= 40 else 0.0 if x <= -40 else 1 / (1 + math.exp(-x))


def percent(x):
    whole, rest = divmod(math.floor(clamp(x) * 100 * 1000 + 0.5), 1000)
    return min(100, whole + (rest > 500 or (rest == 500 and whole % 2 == 1)))


def rest_voltage(soc):
    for (hi, v_hi), (lo, v_lo) in zip(OCV, OCV[1:]):
        if soc >= lo:
            return v_lo + (soc - lo) / (hi - lo) * (v_hi - v_lo)


def resistance(soc, celsius):
    kelvin = (25.0 if celsius != celsius else celsius) + 273.15
    return 0.020 * math.exp(2000.0 * (1.0 / kelvin - 1.0 / 298.15)) * (1.0 + 0.5 * max(0.0, 0.2 - soc) / 0.2)


OK = ("available", "ok", "none", 0, 0.0, 0.0, 100)


def away(kind, code):
    return (kind, "ok", "none", code, 0.0, 0.0, 0)


STALE, NO_DATA = away("unavailable", 9002), away("unavailable", 9005)
WARMUP, NAN_INPUT, UNEXCITED = away("degraded", 9001), away("degraded", 9003), away("degraded", 9004)


def warn(code, value, limit, confidence, action="warn_only"):
    return ("available", "warn", action, code, value, limit, confidence)


def crit(code, value, limit, confidence, action="land"):
    return ("available", "critical", action, code, value, limit, confidence)


class Heat:
    def __init__(self):
        self.raw, self.level, self.rate, self.last, self.nan, self.n = [], Ewma(0.3), Ewma(0.3), None, False, 0

    def take(self, t, x):
        self.nan = not finite(x)
        if self.nan:
            return
        self.raw = [*self.raw, x][-3:]
        self.level.update(sorted(self.raw)[1] if len(self.raw) == 3 else x)
        if self.last and self.last[0] and t > self.last[0]:
            self.rate.update((self.level.mean - self.last[1]) / ((t - self.last[0]) * 1e-9))
        self.last, self.n = (t, self.level.mean), self.n + 1

    def ready(self):
        return not self.nan and self.n >= 15


class Lanes:
    """What a boot begins anew: the flight phase and all lanes' states."""

    def __init__(self):
        self.phase, self.armed_at, self.turning, self.over, self.under = "disarmed", None, False, 0, 0
        self.streaks = defaultdict(int)
        # battery
        self.on, self.nan, self.first, self.loads, self.low, self.rank, self.evidence, self.frozen, self.gauge = True, False, None, 0, True, 0, None, False, None
        self.amps, self.residuals, self.sag, self.growth = Ewma(0.02), Robust(128, 0.005), PageHinkley(-1, 0.5, 6.0), Drift(0.5, 6.0)
        # vibration
        self.throttle, self.clips, self.clip_rate, self.shaken, self.peak, self.accel = 0.0, None, 0.0, 0, 0, 0.0
        self.fits, self.scales, self.shakes, self.tripped = [Rls() for _ in range(3)], [Robust(128, f) for f in (0.5, 0.02, 1e-3)], [PageHinkley(1, 0.5, 6.0) for _ in range(3)], {}
        # estimator
        self.judged, self.base, self.drifts, self.worst = 0, [Ewma(0.01) for _ in range(4)], [Drift(0.2, 2.0) for _ in range(4)], [0.0] * 4
        # position
        self.fixes, self.sats, self.eph, self.eph_up, self.noise, self.jam, self.z, self.speed, self.valid, self.apart, self.gps = 0, Drift(0.5, 4.0), Robust(64, 0.05), PageHinkley(1, 0.5, 6.0), Robust(64, 1.0), Robust(64, 1.0), (0.0, 0.0), 0.0, False, 0.0, None
        # motors
        self.frames, self.count, self.sectors, self.offsets = 0, 0, set(), [Ewma(0.005) for _ in range(4)]
        # link
        self.messages, self.links = 0, {k: dict(n=0, gap=Ewma(0.05), interval=Ewma(0.05), loss=Drift(0.5, 4.0), last=None) for k in range(6)}
        self.pack, self.die = Heat(), Heat()
        # mission
        self.home, self.away, self.cruise_amps, self.cruise_speed, self.rest, self.powered = None, 0.0, Ewma(0.02), Ewma(0.02), NAN, False

    def count_up(self, name, bad):
        self.streaks[name] = self.streaks[name] + 1 if bad else 0

    def follow_phase(self, r):
        omega = math.sqrt(sum(x * x for x in r.angular_velocity))
        if r.arming_state != 2:
            self.phase, self.armed_at, self.turning, self.over, self.under = "disarmed", None, False, 0, 0
            return
        self.armed_at = r.t if self.armed_at is None else self.armed_at
        fast, slow = not omega <= 0.35, omega < 0.25
        self.over, self.under = self.over + 1 if fast else 0, self.under + 1 if slow else 0
        self.turning = True if self.over >= 5 else False if self.under >= 5 else self.turning
        self.phase = "transient" if r.t - self.armed_at < 3_000_000_000 else "maneuver" if self.turning else "steady"

    def take(self, r):
        if r.stream_id == 0:
            self.follow_phase(r)
        k, steady, armed = r.stream_id, self.phase == "steady", self.phase != "disarmed"
        link = self.links[k]
        link["n"] += 1
        self.messages += 1
        link["gap"].update(float(r.seq_gap))
        link["loss"].update(float(r.seq_gap), 0.0)
        if link["last"] is not None and r.t > link["last"]:
            link["interval"].update(float(r.t - link["last"]))
        link["last"] = r.t
        (self.state, self.imu, self.power, self.position, self.estimator, self.actuator)[k](r, steady, armed)

    def state(self, r, steady, armed):
        self.speed, self.valid = math.sqrt(sum(x * x for x in r.velocity_ned[:2])), r.estimator_valid != 0
        if steady and finite(r.heading):
            self.sectors.add(int((r.heading + math.pi) / (2 * math.pi) * 8) % 8)
        if armed:
            n, e = r.position_ned[:2]
            if finite(n) and finite(e):
                self.home = self.home or (n, e)
                self.away = math.sqrt((n - self.home[0]) ** 2 + (e - self.home[1]) ** 2)
            if steady and finite(self.speed) and self.speed > 2.0:
                self.cruise_speed.update(self.speed)

    def imu(self, r, steady, armed):
        self.die.take(r.t, r.temperature)
        if armed:
            if self.clips is None or r.clipping_count < self.clips[0]:
                self.clips = (r.clipping_count, r.t)
            elif r.t > self.clips[1]:
                self.clip_rate = 0.7 * self.clip_rate + 0.3 * ((r.clipping_count - self.clips[0]) / ((r.t - self.clips[1]) * 1e-9))
                self.clips = (r.clipping_count, r.t)
        if not steady:
            return
        self.shaken += 1
        for k, x in enumerate(r.vibration_metric):
            if not finite(x):
                continue
            if k == 0:
                self.accel, self.peak = x, max(self.peak, 2 if x >= 60 else 1 if x >= 30 else 0)
            if k in self.tripped:
                continue
            residual = self.fits[k].update(self.throttle, x)
            self.scales[k].update(residual)
            if len(self.scales[k]) >= 32:
                z = self.scales[k].z(residual)
                if self.shakes[k].update(z):
                    self.tripped[k] = z

    def power(self, r, steady, armed):
        self.pack.take(r.t, r.temperature)
        if armed:
            self.powered = r.connected != 0
            if finite(r.remaining):
                self.rest = clamp(r.remaining)
            if steady and finite(r.current):
                self.cruise_amps.update(r.current)
        self.on = r.connected != 0
        if not self.on:
            return
        self.nan = any(x != x for x in (r.remaining, r.voltage, r.current))
        if self.nan:
            return
        cell, i, soc = r.voltage / max(1, r.cell_count), r.current, clamp(r.remaining)
        self.first = r.t if self.first is None else self.first
        self.amps.update(i)
        self.loads += i > 2.0
        self.low = self.amps.var < 0.25

        def raised(rank, value, limit, share):
            if rank > self.rank:
                self.rank, self.evidence = rank, (value, limit, percent(share))

        if r.warning == 1:
            raised(2, 1.0, 1.0, 0.9)
        elif r.warning >= 2:
            raised(7, float(r.warning), 2.0, 0.98)
        if i > 2.0 and cell < 3.30:
            raised(5, cell, 3.30, 0.97)
        if self.gauge:
            used, rest = self.gauge
            if f32(r.consumed_mah) + f32(1.0) < used:
                raised(1, r.consumed_mah, float(used), 0.85)
            if f32(r.remaining) > rest + f32(0.05):
                raised(1, r.remaining, float(rest), 0.85)
        self.gauge = f32(r.consumed_mah), f32(r.remaining)
        ocv, modelled = rest_voltage(soc), resistance(soc, r.temperature)
        if not (self.warm(r.t) and i > 2.0 and not self.low and not self.frozen):
            return
        residual = cell - (ocv - i * modelled)
        self.residuals.update(residual)
        if len(self.residuals) >= 32 and self.sag.update(self.residuals.z(residual)):
            raised(4, cell, ocv - i * modelled, clamp(0.7 + 0.3 * sigmoid(self.sag.excess())))
            self.frozen = True
        measured = (ocv - cell) / i
        if finite(measured):
            if not self.frozen and self.growth.update(measured / modelled, 1.0) == "up":
                raised(3, measured, modelled, clamp(0.7 + 0.3 * sigmoid(self.growth.excess())))
                self.frozen = True
            hover = ocv - self.amps.mean * max(measured, modelled)
            if hover < 3.30:
                raised(6, hover, 3.30, 0.9)

    def warm(self, now):
        return self.first is not None and now - self.first >= 20_000_000_000 and self.loads >= 50

    def position(self, r, steady, armed):
        if not armed:
            return
        self.fixes, self.gps = self.fixes + 1, r
        self.count_up("fix", r.fix_type < 3)
        self.count_up("few", r.satellites_used < 7)
        self.sats.update(float(r.satellites_used), 12.0)
        if finite(r.eph) and r.eph > 0:
            x = math.log(r.eph)
            z = self.eph.z(x)
            if len(self.eph) >= 20 and z > 0:
                self.eph_up.update(z)
            if steady:
                self.eph.update(x)
        self.count_up("eph", r.eph > 3.0)
        self.count_up("epv", r.epv > 5.0)
        self.z = self.noise.z(float(r.noise_per_ms)), self.jam.z(float(r.jamming_indicator))
        for scale, z, x in zip((self.noise, self.jam), self.z, (r.noise_per_ms, r.jamming_indicator)):
            if steady and not z >= 4.0:
                scale.update(float(x))
        usable = self.valid and finite(r.ground_speed)
        if usable:
            self.apart = abs(r.ground_speed - self.speed)
        self.count_up("apart", usable and self.apart > 3.0)

    def estimator(self, r, steady, armed):
        if not steady:
            return
        self.judged += 1
        for k, x in enumerate((r.velocity_test_ratio, r.position_test_ratio, r.height_test_ratio, r.mag_test_ratio)):
            if not finite(x):
                continue
            if x > 1.0:
                self.streaks["ratio", k] += 1
                self.worst[k] = max(self.worst[k], x)
            elif x < 0.9:
                self.streaks["ratio", k], self.worst[k] = 0, 0.0
                self.drifts[k].reset()
            if self.drifts[k].update(x, self.base[k].mean if self.base[k].n >= 30 else x) == "up":
                self.worst[k] = max(self.worst[k], x)
            if x < 0.9:
                self.base[k].update(x)
        self.count_up("flags", r.innovation_check_flags != 0)

    def actuator(self, r, steady, armed):
        n = min(8, max(1, r.motor_count))
        mean = sum(r.actuator_output[:n]) / n
        if finite(mean):
            self.throttle = mean
        if not steady:
            return
        self.count = min(4, n)
        outputs = r.actuator_output[: self.count]
        if not all(map(finite, outputs)):
            return
        self.frames += 1
        mean = sum(outputs) / len(outputs)
        for k, x in enumerate(outputs):
            self.offsets[k].update(x - mean)
            self.count_up(("full", k), x >= 0.95)

    # What each lane says on a tick.

    def say(self, now, fresh, phase):
        return {
            "battery": self.say_battery(now, fresh), "vibration": self.say_vibration(fresh), "estimator": self.say_estimator(fresh), "gps": self.say_gps(fresh), "motor": self.say_motor(fresh),
            "link": self.say_link(), "thermal": self.say_thermal(fresh), "mission": self.say_mission(fresh, phase),
        }

    def say_battery(self, now, fresh):
        if not fresh(2):
            return STALE
        if not self.on:
            return NO_DATA
        if self.nan:
            return NAN_INPUT
        if not self.warm(now):
            return WARMUP
        if self.rank == 0:
            return UNEXCITED if self.low else OK
        code = {1: 1004, 2: 1010, 3: 1002, 4: 1001, 5: 1005, 6: 1005, 7: 1010}[self.rank]
        return (crit if self.rank >= 5 else warn)(code, *self.evidence)

    def say_vibration(self, fresh):
        if not fresh(1):
            return STALE
        if self.shaken < 150:
            return WARMUP
        worst = max(self.tripped, key=lambda k: (self.tripped[k], -k), default=None)
        if self.peak == 2:
            return crit(3006, self.accel, 60.0, 95)
        if self.clip_rate >= 20:
            return crit(3005, self.clip_rate, 20.0, 90)
        if len(self.tripped) >= 2:
            return crit(3004, self.tripped[worst], 0.0, percent(0.75 + 0.25 * sigmoid(self.shakes[worst].excess())))
        if self.clip_rate >= 2:
            return warn(3005, self.clip_rate, 2.0, 85)
        if self.peak == 1:
            return warn(3006, self.accel, 30.0, 80)
        if self.tripped:
            return warn(3001 + worst, self.tripped[worst], 0.0, percent(0.7 + 0.3 * sigmoid(self.shakes[worst].excess())))
        return OK

    def say_estimator(self, fresh):
        if not fresh(4):
            return STALE
        if self.judged < 50:
            return WARMUP
        bad = [k for k in range(4) if self.streaks["ratio", k] >= 8 or self.drifts[k].trip() == "up"]
        told = [k for k in bad if self.worst[k] > 0]
        if not told:
            n = self.streaks["flags"]
            return warn(5006, float(n), 10.0, 70, "block_offboard") if n >= 10 else OK
        k = max(told, key=lambda k: (self.worst[k], -k))
        share = clamp(0.7 + 0.3 * sigmoid(self.worst[k] - 1.0))
        if len({(0, 0, 1, 2)[b] for b in bad}) >= 2:
            return crit(5008, self.worst[k], 1.0, percent(share + 0.1), "hold")
        return warn(5001 + k, self.worst[k], 1.0, percent(share), "block_offboard")

    def say_gps(self, fresh):
        if not fresh(3):
            return STALE
        if self.fixes < 30:
            return WARMUP
        s, noise, jam = self.streaks, *self.z
        if s["fix"] >= 5:
            return crit(4001, 0.0, 3.0, 95, "hold")
        wide, tall = s["eph"] >= 5 or self.eph_up.value() > 6.0, s["epv"] >= 5
        sky = wide or tall or s["few"] >= 5 or self.sats.trip() == "down"
        radio, split = noise >= 4 or jam >= 4, s["apart"] >= 5
        if wide:
            told = (4003, self.gps.eph, 6.0 if self.gps.eph > 6.0 else 3.0)
        elif tall:
            told = (4004, self.gps.epv, 5.0)
        elif sky:
            told = (4002, float(self.gps.satellites_used), 7.0)
        elif radio:
            told = (4005, jam, 4.0) if jam >= 4 else (4006, noise, 4.0)
        else:
            told = (4007, self.apart, 3.0)
        causes = sky + radio + split
        return crit(*told, percent(0.8 + 0.15 * sigmoid(self.gps.eph - 3.0)), "hold") if causes >= 2 else warn(*told, 75) if causes else OK

    def say_motor(self, fresh):
        if not fresh(5):
            return STALE
        if self.frames < 100:
            return WARMUP
        e = max((abs(self.offsets[k].mean) for k in range(self.count) if self.offsets[k].n >= 20), default=0.0)
        full = any(self.streaks["full", k] >= 20 for k in range(self.count))
        if e > 0.08:
            if full:
                return warn(2005, e, 0.08, 70)
            return warn(2001, e, 0.08, min(70, percent(0.4 + 3.0 * (e - 0.08)))) if len(self.sectors) >= 3 else warn(2003, e, 0.08, 45)
        return warn(2002, 1.0, 0.95, 60) if full else OK

    def say_link(self):
        if self.messages < 150:
            return WARMUP if self.messages else NO_DATA
        drop, rate, jitter = 0.0, 1.0, 0.0
        for k, link in self.links.items():
            if link["n"] < 20:
                continue
            gap, interval = max(0.0, link["gap"].mean), link["interval"]
            drop = max(drop, gap / (1 + gap), 0.10 if link["loss"].trip() == "up" else 0.0)
            rate = min(rate, PERIOD_NS[k] / interval.mean) if interval.mean > 0 else rate
            jitter = max(jitter, max(interval.var, 0.0) ** 0.5 / PERIOD_NS[k])
        if drop >= 0.10:
            return warn(7001, drop, 0.10, percent(0.6 + 0.4 * sigmoid((drop - 0.10) * 20.0)))
        if rate <= 0.60:
            return warn(7002, rate, 0.60, percent(0.6 + 0.4 * sigmoid((0.60 - rate) * 5.0)))
        return warn(7006, jitter, 1.0, 70) if jitter >= 1.0 else OK

    def say_thermal(self, fresh):
        found = []
        if not fresh(1) and not fresh(2):
            return STALE
        if fresh(2) and self.pack.nan:
            return NAN_INPUT
        if fresh(2) and self.pack.ready():
            t, rate = self.pack.level.mean, self.pack.rate.mean
            rules = [(crit, 6001, t, 65.0, 0.95, True), (crit, 6002, rate, 1.5, 0.9, t >= 50), (warn, 6001, t, 55.0, 0.8, True), (warn, 6002, rate, 0.5, 0.75, t >= 50)]
            found += [x for x in rules if x[5] and x[2] >= x[3]][:1]
        if fresh(1) and self.die.ready():
            t, rate = self.die.level.mean, self.die.rate.mean
            rules = [(warn, 6003, t, 85.0, 0.85, True), (warn, 6003, t, 70.0, 0.75, True), (warn, 6004, rate, 1.0, 0.7, t >= 65)]
            found += [x for x in rules if x[5] and x[2] >= x[3]][:1]
        if not found:
            return OK
        made, code, value, limit, share, _ = found[0]
        return made(code, value, limit, percent(share + 0.1 * sigmoid(value - limit)))

    def say_mission(self, fresh, phase):
        if not fresh(2) or not fresh(0):
            return STALE
        if phase == "disarmed":
            return OK
        if self.cruise_amps.n < 30:
            return WARMUP
        if self.away < 20.0:
            return OK
        if not self.powered or not finite(self.rest):
            return UNEXCITED
        speed = max(self.cruise_speed.mean, 2.0) if self.cruise_speed.n >= 20 else 8.0
        left = (self.rest * 5000.0 - self.cruise_amps.mean * (self.away / speed / 3600.0) * 1000.0) / 5000.0
        if left < 0.10:
            return crit(8002, left, 0.10, percent(0.85 + 0.15 * sigmoid((0.10 - left) * 30.0)), "rtl")
        return warn(8001, left, 0.20, 80) if left < 0.20 else OK


def fly(rows):
    """(tick, findings by lane, clock locked) on every grid point up to the last row; a tick sees the rows strictly before it."""
    lanes, seen, locked, boot, tick, out = Lanes(), {}, False, None, None, []
    for r in rows:
        tick = r.t // STEP * STEP + STEP if tick is None else tick
        while tick <= r.t:
            fresh = lambda k, now=tick: bool(seen.get(k)) and now - seen[k] <= 4 * PERIOD_NS[k]
            out.append((tick, lanes.say(tick, fresh, lanes.phase), locked))
            tick += STEP
        seen[r.stream_id], locked = r.t, r.age_locked
        if r.stream_id == 0:
            if boot is not None and boot != r.px4_boot_id:
                lanes = Lanes()
            boot = r.px4_boot_id
        lanes.take(r)
    return out


def concluded(found, locked):
    """(severity, action, flags, code, value, limit, confidence) of one tick."""
    raised = [lane for lane, f in found.items() if f[1] != "ok"]
    flags = sum(FLAG[lane] for lane in raised) + 512 * any(f[0] != "available" for f in found.values()) + 1024 * (not locked)
    if not raised:
        return ("ok", "none", flags, 0, 0.0, 0.0, 100)
    _, severity, action, *evidence = found[min(raised, key=lambda lane: (found[lane][1] != "critical", PRIORITY[lane]))]
    if action in ("rtl", "hold") and {"gps", "estimator"} & {*raised}:
        action = "land"
    return (severity, action, flags, *evidence)
