"""The table events as telemetry: user_id is the vehicle, event_type the stream, event_id the sequence, ts the receive time, value the signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ingest import STREAMS
from tidemark.sources.streams import ENVELOPE, PAYLOAD, PERIODIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("vehicle"), F.col("event_type").alias("stream"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value"),
    )


#: The same in DuckDB.
SIGNALS = "sig AS (SELECT event_id AS seq, user_id AS vehicle, event_type AS stream, epoch_us(ts) AS t, value FROM events)"


MS = 1_000_000


def _told() -> dict[str, dict[str, Column]]:
    """What an event says in each stream, by its value (v), its place in its mission (n) and its vehicle. What isn't named is zero."""
    v, n, odd = F.col("v"), F.col("n"), F.col("mission_id")
    vector = lambda *x: F.array(*(F.lit(float(a)) if isinstance(a, (int, float)) else a for a in x))
    amps = F.when(n % 2 == 0, 10.0).otherwise(14.0)
    return {
        "state": {
            "q": vector(1, 0, 0, 0), "angular_velocity": vector(0.02 + v / 2000, 0.01, 0), "position_ned": vector(n * 0.5, 1, -10), "velocity_ned": vector(0.1 + v / 100, 0, 0), "heading": F.pmod(n / 9, F.lit(6.0)) - 3,
            "arming_state": F.when((odd % 7 == 0) & (n < 5), 1).otherwise(2), "estimator_valid": F.lit(1),
        },
        "imu": {"clipping_count": F.when(odd % 4 == 0, n * 3).otherwise(0), "accel": vector(0, 0, -9.8), "vibration_metric": vector(8 + v / 50, 0.05, 0.0005), "temperature": 45 + v / 5},
        "power": {
            "voltage": 16 - v / 400 - n * 0.002, "current": amps, "power": amps * 15.8, "consumed_mah": (n + 1) * 2.0, "remaining": 0.72 - n * 0.002, "temperature": 32 + v / 8, "cell_count": F.lit(4),
            "warning": F.when(v > 250, 1).otherwise(0), "connected": F.lit(1),
        },
        "gps": {
            "eph": 0.8 + v / 60, "epv": F.lit(1.2), "ground_speed": 0.1 + v / 100, "noise_per_ms": 80 + n % 5, "jamming_indicator": F.lit(5), "fix_type": F.when(v > 200, 1).otherwise(4),
            "satellites_used": F.greatest(F.lit(14) - F.floor(v / 40), F.lit(0)),
        },
        "estimator": {"velocity_test_ratio": 0.4 + v / 150, "position_test_ratio": F.lit(0.35), "height_test_ratio": 0.3 + v / 200, "mag_test_ratio": F.lit(0.25), "airspeed_test_ratio": F.lit(float("nan"))},
        "actuator": {"actuator_output": vector(F.least(0.5 + v / 600, F.lit(1.0)), 0.5, 0.5, 0.5, 0, 0, 0, 0), "motor_count": F.lit(4)},
    }


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as recorded missions, one a user: the n-th event of a user is the n-th tenth of a second, in which each periodic stream tells of it once
    (position fixes not by events of errors). A user's vehicle boots again in the middle of the month."""
    s = signals(spark, sf_dir)
    order = Window.partitionBy("vehicle").orderBy("t", "seq")
    s = s.select(F.col("vehicle").alias("mission_id"), "stream", F.col("seq").alias("event"), F.col("value").alias("v"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.floor(F.col("t") / 86_400_000_000 / 15 % 2).alias("half"))
    k = F.col("k")
    rows = s.withColumn("k", F.explode(F.array(*(F.lit(STREAMS[p]) for p in PERIODIC)))).filter(~((k == STREAMS["gps"]) & (F.col("stream") == "error")))
    time = F.col("n") * 100 * MS + (70 + 4 * k) * MS
    envelope = {
        "vehicle_id": F.lit(1), "mission_id": F.col("mission_id"), "px4_boot_id": 7 + F.col("half"), "cc_boot_id": F.lit(1), "stream_id": k, "sequence": F.col("n"), "fc_timestamp_us": F.floor(time / 1000), "cc_receive_time_ns": time,
        "seq_gap": F.when(F.col("v") > 100, 2).otherwise(0), "age_ns": F.lit(0), "age_locked": F.col("v") < 150, "schema_version": F.lit(1),
    }
    told, payload = _told(), {}
    for p in PERIODIC:
        for name, kind in PAYLOAD[p]:
            zero = F.array(*[F.lit(0.0)] * {"q": 4, "actuator_output": 8}.get(name, 3)) if isinstance(kind, T.ArrayType) else F.lit(0)
            payload.setdefault(name, (kind, []))[1].append(F.when(k == STREAMS[p], told[p].get(name, zero).cast(kind)))
    return rows.select(*(envelope[n].cast(kind).alias(n) for n, kind in ENVELOPE), *(F.coalesce(*cases).alias(n) for n, (_, cases) in payload.items()))
