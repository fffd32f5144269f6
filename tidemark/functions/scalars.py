"""Scalar column functions of the telemetry engine; all stay inside generated code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------------------------
#: Open-circuit voltage of a cell by state of charge.
OCV = [
    (1.00, 4.20), (0.90, 4.05), (0.80, 3.95), (0.70, 3.87), (0.60, 3.81), (0.50, 3.77),
    (0.40, 3.74), (0.30, 3.70), (0.20, 3.64), (0.10, 3.52), (0.05, 3.40), (0.00, 3.30),
]
#: Rank of severities when lane results are merged, and when a report is held back. They differ.
MERGE_RANK = {"ok": 0, "warn": 1, "stale": 2, "critical": 3}
HOLD_RANK = {"ok": 0, "warn": 1, "critical": 2, "stale": 3}
#: Order of subsystems at equal severity, and their flag bits.
PRIORITY = {"battery": 0, "motor": 1, "estimator": 2, "gps": 3, "vibration": 4, "thermal": 5, "link": 6, "mission": 7}
FLAG = {"battery": 1, "motor": 2, "vibration": 4, "gps": 8, "estimator": 16, "thermal": 32, "link": 64, "mission": 128}
FLAG_DEGRADED, FLAG_TIMESYNC = 512, 1024
#: Message ids by direction: telemetry from the flight controller, reports to it.
TO_COMPANION, TO_CONTROLLER = (54000, 54008), (54010, 54013)


def lookup(mapping: dict, key: Column) -> Column:
    """The value of a literal map; null for keys that aren't in it."""
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items())))[key]


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite: NaN and infinities stand for a missing measurement."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN becomes 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ln(x: Column) -> Column:
    """Natural logarithm; NaN for what isn't positive."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("nan")))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)), flat beyond 40 on both sides; NaN stays NaN."""
    return F.when(F.isnan(x), x).when(x >= 40, 1.0).when(x <= -40, 0.0).otherwise(1 / (1 + F.exp(-x)))


def confidence_percent(x: Column) -> Column:
    """A share as whole percents: rounded to thousandths of a percent, ties of those to the even percent."""
    milli = F.floor(clamp01(x) * 100 * 1000 + 0.5).cast("long")
    base, rest = F.expr("0L") + F.floor(milli / 1000), milli % 1000
    up = (rest > 500) | ((rest == 500) & (base % 2 == 1))
    return F.least(F.lit(100), base + F.when(up, 1).otherwise(0)).cast("int")


def norm(*parts: Column) -> Column:
    """Euclidean norm of parts widened to double, added in the given order."""
    squares = [p.cast("double") * p.cast("double") for p in parts]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return F.sqrt(total)


def ocv(soc: Column) -> Column:
    """Open-circuit cell voltage: linear interpolation between the two table rows around a state of charge."""
    s = clamp01(soc)
    out = F.lit(OCV[-1][1])
    for (hi, v_hi), (lo, v_lo) in reversed(list(zip(OCV, OCV[1:]))):
        out = F.when(s >= lo, F.lit(v_lo) + (s - lo) / (hi - lo) * (v_hi - v_lo)).otherwise(out)
    return out


def internal_resistance(soc: Column, celsius: Column) -> Column:
    """Modelled cell resistance in ohm: 20 mohm at 25 degrees, rising in the cold (Arrhenius) and below 20 % charge."""
    kelvin = F.when(F.isnan(celsius), 25.0).otherwise(celsius) + 273.15
    cold = F.exp(2000.0 * (1.0 / kelvin - 1.0 / 298.15))
    return 0.020 * cold * (1.0 + 0.5 * F.greatest(F.lit(0.0), 0.2 - clamp01(soc)) / 0.2)


def heading_sector(heading: Column, sectors: int = 8) -> Column:
    """The sector (0 to sectors - 1) of a heading in radians from -pi."""
    share = (heading + 3.141592653589793) / 6.283185307179586
    return F.pmod((share * sectors).cast("long"), F.lit(sectors)).cast("int")


def soc_at_home(remaining: Column, distance: Column, speed: Column, current: Column, capacity_mah: float = 5000.0) -> Column:
    """The state of charge left on arrival at home."""
    used = current * (distance / speed / 3600.0) * 1000.0
    return (remaining * capacity_mah - used) / capacity_mah


def controller_to_companion_ns(us: Column, offset_ns: Column) -> Column:
    return us * 1000 - offset_ns


def companion_to_controller_us(ns: Column, offset_ns: Column) -> Column:
    return F.call_function("div", ns + offset_ns, F.lit(1000).cast("long"))


def report_interval_ns(severity: Column, acked: Column) -> Column:
    return (
        F.when(severity == "critical", F.when(acked, 1_000_000_000).otherwise(200_000_000))
        .when(severity == "warn", 250_000_000)
        .otherwise(1_000_000_000)
    )


def direction(message_id: Column) -> Column:
    """"to_companion", "to_controller" or null."""
    return F.when(message_id.between(*TO_COMPANION), "to_companion").when(message_id.between(*TO_CONTROLLER), "to_controller")


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def sync_quality(samples: Column, jitter_ns: Column, reject_rate: Column) -> Column:
    return (
        F.when((samples >= 8) & (jitter_ns <= 20_000_000) & (reject_rate < 0.30), "locked").when(samples >= 4, "degraded").otherwise("unlocked")
    )


def dialect_id(text: Column) -> Column:
    """The first four bytes of a text's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def detail_block(code: Column) -> Column:
    """The subsystem block of a detail code: its thousands."""
    return F.floor(code / 1000).cast("int")


def part_name(index: Column) -> Column:
    return F.format_string("%06d.parquet", index)


def segment_name(index: Column) -> Column:
    return F.format_string("segment_%02d", index)


def mission_name(number: Column) -> Column:
    return F.format_string("mission_%06d", number)
