"""Made telemetry: a calm flight, and faults laid over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.align import merged
from tidemark.operators.ingest import PERIOD_NS, STREAMS
from tidemark.sources.streams import PAYLOAD, PERIODIC, schema

MS = 1_000_000
#: Columns of the calm flight; what isn't named is zero.
CALM = {
    "state": {"angular_velocity": [0.02, 0.01, 0.0], "velocity_ned": [0.1, 0.0, 0.0], "position_ned": [1.0, 1.0, -10.0], "heading": 0.3, "arming_state": 2, "estimator_valid": 1},
    "imu": {"accel": [0.0, 0.0, -9.8], "vibration_metric": [8.0, 0.05, 0.0005], "temperature": 45.0},
    "power": {"voltage": 15.8, "remaining": 0.72, "temperature": 32.0, "cell_count": 4, "connected": 1},
    "gps": {"eph": 0.8, "epv": 1.2, "ground_speed": 0.1, "noise_per_ms": 80, "jamming_indicator": 5, "fix_type": 4, "satellites_used": 14},
    "estimator": {"velocity_test_ratio": 0.4, "position_test_ratio": 0.35, "height_test_ratio": 0.3, "mag_test_ratio": 0.25, "airspeed_test_ratio": float("nan")},
    "actuator": {"actuator_output": [0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0], "motor_count": 4},
}
_WIDTH = {"q": 4, "actuator_output": 8}


def _value(name: str, kind: T.DataType, given) -> Column:
    if isinstance(given, Column):
        return given.cast(kind)
    if isinstance(kind, T.ArrayType):
        given = [0.0] * _WIDTH.get(name, 3) if given is None else given
        return F.array(*(F.lit(float(x)) for x in given)).cast(kind)
    return F.lit(0 if given is None else given).cast(kind)


def flights(spark: SparkSession, missions: int, seconds: int, faults: dict[tuple[str, str], Column] | None = None, boot: Column | None = None) -> DataFrame:
    """Six streams of calm flights at their nominal rates from time 0, in one wide table.

    ``faults``: (stream, column) -> what it holds instead, as an expression of t, seq, mission_id and ``calm`` (the calm value).
    """
    parts = []
    for stream in PERIODIC:
        k, period = STREAMS[stream], PERIOD_NS[STREAMS[stream]]
        n = -(-seconds * 1_000_000_000 // period)
        rows = spark.range(missions * n).select((F.col("id") % n).alias("seq"), F.expr(f"id div {n}").alias("mission_id")).withColumn("t", F.col("seq") * period)
        amps = F.when(F.col("seq") % 2 == 0, 10.0).otherwise(14.0)
        calm = dict(CALM[stream]) | ({"current": amps, "power": amps * 15.8, "consumed_mah": (F.col("seq") + 1) * 2.0} if stream == "power" else {})
        columns = {}
        for name, kind in PAYLOAD[stream]:
            own = _value(name, kind, calm.get(name))
            fault = (faults or {}).get((stream, name))
            columns[name] = own if fault is None else fault(own).cast(kind)
        envelope = {
            "vehicle_id": F.lit(1), "mission_id": F.col("mission_id"), "px4_boot_id": F.lit(7) if boot is None else boot, "cc_boot_id": F.lit(1), "stream_id": F.lit(k), "sequence": F.col("seq"),
            "fc_timestamp_us": F.expr("t div 1000"), "cc_receive_time_ns": F.col("t"), "seq_gap": (faults or {}).get((stream, "seq_gap"), lambda c: c)(F.lit(0)), "age_ns": F.lit(0), "age_locked": F.lit(True), "schema_version": F.lit(1),
        }
        kinds = {f.name: f.dataType for f in schema(stream).fields}
        parts.append(rows.select(*(c.cast(kinds[n]).alias(n) for n, c in envelope.items()), *(c.alias(n) for n, c in columns.items())))
    return merged(parts)


def fault_flights(spark: SparkSession, seconds: int = 45) -> DataFrame:
    """Missions 0 to 7: a calm one, then hot battery, position accuracy lost, two estimator channels, clipping, saturated motor, lost link rows, hot IMU."""
    t, m = F.col("t"), F.col("mission_id")
    late = t > (seconds - 10) * 1_000_000_000
    when = lambda mission, value: lambda calm: F.when((m == mission) & late, value).otherwise(calm)
    full = F.array(*(F.lit(x) for x in (0.97, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0))).cast("array<float>")
    faults = {
        ("power", "temperature"): when(1, F.lit(70.0)), ("gps", "eph"): when(2, F.lit(7.0)), ("estimator", "height_test_ratio"): when(3, F.lit(1.4)), ("estimator", "mag_test_ratio"): when(3, F.lit(1.6)),
        ("imu", "clipping_count"): when(4, F.col("seq") * 5), ("actuator", "actuator_output"): when(5, full), ("imu", "seq_gap"): when(6, F.lit(2)), ("imu", "temperature"): when(7, F.lit(90.0)),
    }
    return flights(spark, 8, seconds, faults)
