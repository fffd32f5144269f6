"""Folds of the health lanes that are true recursions: detectors whose state decides what they admit, or that freeze when they trip.

Each is a few lines over the kernels in ``scans`` and runs inside ``ordered_scan``.
"""

from __future__ import annotations

from tidemark.operators.scans import NAN, Drift, Ewma, PageHinkley, Rls, Robust


class SagAndGrowth:
    """Load mean and spread, downward drift of the voltage residual, upward drift of the resistance ratio; both freeze at the first trip."""

    def __init__(self):
        self.load, self.residuals = Ewma(0.02), Robust(128, 0.005)
        self.sag, self.growth, self.frozen = PageHinkley(-1, 0.5, 6.0), Drift(0.5, 6.0), False

    def step(self, current, residual, ratio, loaded):
        self.load.update(current)
        active = bool(loaded) and self.load.var >= 0.25 and not self.frozen
        sagged = grown = None
        if active:
            self.residuals.update(residual)
            if len(self.residuals) >= 32 and self.sag.update(self.residuals.z(residual)):
                sagged, self.frozen = self.sag.excess(), True
            if not self.frozen and self.growth.update(ratio, 1.0) == "up":
                grown, self.frozen = self.growth.excess(), True
        return self.load.mean, self.load.var, active, sagged, grown


class Vibration:
    """Clipping rate, and for each of three metrics the drift of its residual against throttle; a metric freezes when it trips."""

    def __init__(self):
        self.fits, self.scales = [Rls() for _ in range(3)], [Robust(128, f) for f in (0.5, 0.02, 1.0e-3)]
        self.drifts, self.z = [PageHinkley(1, 0.5, 6.0) for _ in range(3)], [None] * 3
        self.clips, self.clip_time, self.clip_rate = None, 0, 0.0

    def step(self, t, armed, steady, clips, throttle, metrics):
        if armed:
            if self.clips is None or clips < self.clips:
                self.clips, self.clip_time = clips, t
            elif t > self.clip_time:
                self.clip_rate = 0.7 * self.clip_rate + 0.3 * ((clips - self.clips) / ((t - self.clip_time) * 1e-9))
                self.clips, self.clip_time = clips, t
        if steady:
            for k, x in enumerate(metrics):
                if x - x == 0 and self.z[k] is None:
                    residual = self.fits[k].update(throttle, x)
                    self.scales[k].update(residual)
                    if len(self.scales[k]) >= 32:
                        z = self.scales[k].z(residual)
                        if self.drifts[k].update(z):
                            self.z[k] = z
        tripped = [k for k in range(3) if self.z[k] is not None]
        worst = max(tripped, key=lambda k: self.z[k], default=None)
        return self.clip_rate, len(tripped), worst, None if worst is None else self.z[worst], None if worst is None else self.drifts[worst].excess()


class TestRatio:
    """Breach streak, worst ratio and drift above a learned baseline of one innovation test ratio."""

    def __init__(self):
        self.base, self.drift, self.streak, self.worst = Ewma(0.01), Drift(0.20, 2.0), 0, 0.0

    def update(self, r):
        if r is None or r - r != 0:
            return
        if r > 1.0:
            self.streak, self.worst = self.streak + 1, max(self.worst, r)
        elif r < 0.9:
            self.streak, self.worst = 0, 0.0
            self.drift.reset()
        if self.drift.update(r, self.base.mean if self.base.n >= 30 else r) == "up":
            self.worst = max(self.worst, r)
        if r < 0.9:
            self.base.update(r)

    def bad(self) -> bool:
        return self.streak >= 8 or self.drift.trip() == "up"


class TestRatios:
    """Four of them: which are bad, the worst bad one, and how many independent causes (velocity with position, height, heading) are bad."""

    def __init__(self):
        self.channels = [TestRatio() for _ in range(4)]

    def step(self, *ratios):
        for channel, r in zip(self.channels, ratios):
            channel.update(r)
        bad = [k for k in range(4) if self.channels[k].bad()]
        worst = max((k for k in bad if self.channels[k].worst > 0), key=lambda k: self.channels[k].worst, default=None)
        return len({(0, 0, 1, 2)[k] for k in bad}), worst, None if worst is None else self.channels[worst].worst


class Reception:
    """Satellite drift, and robust scales of log accuracy, noise and jamming that learn in steady flight from values that don't stand out."""

    def __init__(self):
        self.satellites = Drift(0.5, 4.0)
        self.accuracy, self.accuracy_drift = Robust(64, 0.05), PageHinkley(1, 0.5, 6.0)
        self.scales = [Robust(64, 1.0), Robust(64, 1.0)]

    def step(self, steady, satellites, log_eph, noise, jam):
        self.satellites.update(satellites, 12.0)
        if log_eph is not None:
            z = self.accuracy.z(log_eph)
            if len(self.accuracy) >= 20 and z > 0:
                self.accuracy_drift.update(z)
            if steady:
                self.accuracy.update(log_eph)
        found = []
        for scale, x in zip(self.scales, (noise, jam)):
            z = scale.z(x)
            if steady and not z >= 4.0:
                scale.update(x)
            found.append(None if z != z else z)
        return self.satellites.trip() == "down", self.accuracy_drift.value() > 6.0, *found


class MotorOffsets:
    """Mean offset of each of up to four motors from the average command; the largest of the first ``motors``."""

    def __init__(self):
        self.offsets = [Ewma(0.005) for _ in range(4)]

    def step(self, outputs, motors):
        if outputs is not None:
            mean = sum(outputs) / len(outputs)
            for offset, x in zip(self.offsets, outputs):
                offset.update(x - mean)
        ready = [o.mean for o in self.offsets[:motors] if o.n >= 20]
        return (max(ready, key=abs, default=None),)


class StreamLink:
    """Mean gap and arrival interval of one stream, and drift of its gaps."""

    def __init__(self):
        self.gap, self.interval, self.drift = Ewma(0.05), Ewma(0.05), Drift(0.5, 4.0)

    def step(self, gap, dt):
        self.gap.update(gap)
        self.drift.update(gap, 0.0)
        self.interval.update(NAN if dt is None else dt)
        return self.gap.mean, None if not self.interval.n else self.interval.mean, max(self.interval.var, 0.0) ** 0.5, self.drift.trip() == "up"


class Warming:
    """Smoothed temperature and its smoothed rate of change."""

    def __init__(self):
        self.level, self.rate, self.last = Ewma(0.3), Ewma(0.3), None

    def step(self, t, value):
        self.level.update(value)
        if self.last is not None and self.last[0] != 0 and t > self.last[0]:
            self.rate.update((self.level.mean - self.last[1]) / ((t - self.last[0]) * 1e-9))
        self.last = (t, self.level.mean)
        return self.level.mean, self.rate.mean if self.rate.n else None


class Cruise:
    """Mean current and horizontal speed in steady flight."""

    def __init__(self):
        self.current, self.speed = Ewma(0.02), Ewma(0.02)

    def step(self, current, speed):
        self.current.update(NAN if current is None else current)
        self.speed.update(NAN if speed is None else speed)
        return self.current.mean, self.current.n, self.speed.mean, self.speed.n
