"""Queries of the telemetry operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregates as A
from tidemark.operators import align as J
from tidemark.operators import ingest as I
from tidemark.operators import scans as C
from tidemark.operators import windows as W
from tidemark.plans import replay
from tidemark.plans.adapters import SIGNALS, missions, signals, table
from tidemark.sources.shared import stored
from tidemark.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
V, T = ["vehicle"], ["t", "seq"]
VS = ["vehicle", "stream"]


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {SIGNALS} {sql}" if "sig" in sql else sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _nulls_last(names: list[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


# --- Continuity, age, staleness -------------------------------------------------------------------------------------


@query("""SELECT vehicle, seq, CASE WHEN lag(seq) OVER w IS NULL OR (seq - lag(seq) OVER w + 4294967296) % 4294967296 IN (0)
  OR (seq - lag(seq) OVER w + 4294967296) % 4294967296 > 2147483647 THEN 0
  ELSE (seq - lag(seq) OVER w + 4294967296) % 4294967296 - 1 END AS seq_gap FROM sig WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)""")
def seq_gap(spark, sf_dir):
    return I.seq_gap(signals(spark, sf_dir), V, T, "seq").select("vehicle", "seq", "seq_gap")


@query("SELECT vehicle, stream, seq, CASE WHEN t > lag(t) OVER w THEN t - lag(t) OVER w END AS dt FROM sig WINDOW w AS (PARTITION BY vehicle, stream ORDER BY t, seq)")
def inter_arrival(spark, sf_dir):
    return I.inter_arrival(signals(spark, sf_dir), VS, T, "t").select("vehicle", "stream", "seq", "dt")


@query("""SELECT * FROM (SELECT vehicle, stream, t AS last_seen, lead(t) OVER (PARTITION BY vehicle, stream ORDER BY t) AS recovered_at,
  CAST(((t + 14400000000) // 60000000 + 1) * 60000000 AS BIGINT) AS stale_at FROM sig) WHERE stale_at <= recovered_at""")
def stale_intervals(spark, sf_dir):
    return I.stale_intervals(signals(spark, sf_dir), VS, "t", 4 * HOUR, 60_000_000).select("vehicle", "stream", "last_seen", "recovered_at", "stale_at")


@query("""SELECT seq, stream, CAST(sum(c) OVER (PARTITION BY stream ORDER BY t, seq) AS BIGINT) AS epoch FROM (
  SELECT *, CASE WHEN lag(vehicle // 50) OVER (PARTITION BY stream ORDER BY t, seq) <> vehicle // 50 THEN 1 ELSE 0 END AS c FROM sig)""")
def boot_epoch(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("boot", F.floor(F.col("vehicle") / 50))
    return I.boot_epoch(df, ["stream"], T).select("seq", "stream", "epoch")


@query("SELECT seq, CASE WHEN vehicle % 3 <> 0 THEN t * 1000 + 5000000 - ((t - 250) * 1000 - vehicle * 1000) END AS age_ns FROM sig")
def sample_age(spark, sf_dir):
    t, v = F.col("t"), F.col("vehicle")
    return signals(spark, sf_dir).select("seq", I.age_ns(t * 1000 + 5_000_000, t - 250, v * 1000, v % 3 != 0).alias("age_ns"))


@query(f"""SELECT stream, t // 3600000000 AS hour, count(*) AS n,
  CAST(max(CASE WHEN t <> 0 AND (t // 3600000000 + 1) * 3600000000 - t <= {I.STALE_PERIODS} * 300000000 THEN 1 ELSE 0 END) AS INTEGER) AS any_fresh FROM sig GROUP BY ALL""")
def freshness(spark, sf_dir):
    """Whether a stream is fresh as each hour ends, at a period of five minutes."""
    df = signals(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / HOUR))
    fresh = I.fresh((F.col("hour") + 1) * HOUR, F.col("t"), 300_000_000)
    return df.groupBy("stream", "hour").agg(F.count("*").alias("n"), F.max(fresh.cast("int")).alias("any_fresh"))


@query("""SELECT vehicle, CAST(count(*) AS BIGINT) AS n, CAST(sum(gap) AS BIGINT) AS gaps, CAST(floor(t / 86400000000) AS BIGINT) AS second FROM (
  SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY vehicle ORDER BY t, seq) - 1, 0) AS gap FROM sig) GROUP BY vehicle, floor(t / 86400000000)""")
def ingest_counters(spark, sf_dir):
    df = I.seq_gap(signals(spark, sf_dir), V, T, "seq")
    return I.per_second(df, V, F.floor(F.col("t") / (24 * HOUR))).withColumnRenamed("rows", "n")


@query("""SELECT seq, vehicle, CASE WHEN age IS NULL THEN 'down' WHEN age <= 2500000000 THEN 'up' WHEN age <= 5000000000 THEN 'degraded' ELSE 'down' END AS link FROM (
  SELECT seq, vehicle, t - max(CASE WHEN stream = 'view' THEN t END) OVER (PARTITION BY vehicle ORDER BY t, seq) AS age FROM sig)""")
def link_state(spark, sf_dir):
    df = J.latest(signals(spark, sf_dir), V, T, {"beat": F.when(F.col("stream") == "view", F.col("t"))})
    return df.select("seq", "vehicle", I.link_state(F.col("t") - F.col("beat")).alias("link"))


# --- Validation and filters -----------------------------------------------------------------------------------------

_MESSAGES = """msg AS (SELECT seq, 53998 + seq % 20 AS message, vehicle % 7 AS system, CASE WHEN seq % 11 = 0 THEN 2 ELSE 1 END AS component,
  CASE WHEN seq % 13 = 0 THEN 2 ELSE 1 END AS version, CAST(floor(value) AS BIGINT) AS confidence FROM sig),
 judged AS (SELECT *, CASE WHEN message BETWEEN 54000 AND 54008 OR message BETWEEN 54010 AND 54013 THEN
   CASE WHEN system <> 3 OR component <> 1 THEN 'source' WHEN version <> 1 THEN 'schema' WHEN confidence > 100 THEN 'range' END ELSE 'unknown' END AS reason FROM msg)"""


def _messages(spark, sf_dir):
    seq = F.col("seq")
    df = signals(spark, sf_dir).select(
        "seq", (seq % 20 + 53998).alias("message"), (F.col("vehicle") % 7).alias("system"), F.when(seq % 11 == 0, 2).otherwise(1).alias("component"),
        F.when(seq % 13 == 0, 2).otherwise(1).alias("version"), F.floor("value").alias("confidence"),
    )
    return df.withColumn("reason", I.reject_reason(F.col("system"), F.col("component"), F.col("version"), F.col("confidence"), F.col("message"), 3, 1))


@query(f", {_MESSAGES} SELECT seq, message, reason FROM judged")
def validate_gauntlet(spark, sf_dir):
    return _messages(spark, sf_dir).select("seq", "message", "reason")


@query(f", {_MESSAGES} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged GROUP BY 1")
def reject_counts(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT seq, CASE WHEN m BETWEEN 54000 AND 54008 THEN 'to_companion' WHEN m BETWEEN 54010 AND 54013 THEN 'to_controller' END AS direction FROM (SELECT seq, 53998 + seq % 20 AS m FROM sig)""")
def message_direction(spark, sf_dir):
    return signals(spark, sf_dir).select("seq", S.direction(F.col("seq") % 20 + 53998).alias("direction"))


_SHED = {"view": "imu", "click": "state", "signup": "power", "error": "actuator", "purchase": "gps"}
_STAGE = "['normal', 'shed_raw', 'shed_bf', 'shed_crit'][vehicle % 4 + 1]"
_SHED_SQL = "CASE stream WHEN 'view' THEN 'imu' WHEN 'click' THEN 'state' WHEN 'signup' THEN 'power' WHEN 'error' THEN 'actuator' ELSE 'gps' END"


@query(f"""SELECT stage, s AS stream, count(*) AS n, count(*) FILTER (NOT ((stage = 'shed_bf' AND s IN ('imu', 'actuator'))
   OR (stage = 'shed_crit' AND s IN ('imu', 'actuator', 'power', 'gps', 'estimator')))) AS kept FROM (SELECT {_STAGE} AS stage, {_SHED_SQL} AS s FROM sig) GROUP BY ALL""")
def shed_filter(spark, sf_dir):
    stage = F.get(F.array(*(F.lit(x) for x in I.SHED)), (F.col("vehicle") % 4).cast("int"))
    df = signals(spark, sf_dir).select(stage.alias("stage"), S.lookup(_SHED, F.col("stream")).alias("stream"))
    kept = F.count_if(I.allowed(F.col("stage"), F.col("stream")))
    return df.groupBy("stage", "stream").agg(F.count("*").alias("n"), kept.alias("kept"))


# --- Alignment ------------------------------------------------------------------------------------------------------


@query("SELECT seq, vehicle, stream, row_number() OVER (PARTITION BY vehicle ORDER BY t, stream, seq) AS ordinal FROM sig")
def ordered_merge(spark, sf_dir):
    df = signals(spark, sf_dir)
    streams = [df.filter(F.col("stream") == s) for s in ("view", "click", "signup", "error", "purchase")]
    return J.in_order(J.merged(streams), V, ["t", "stream", "seq"]).select("seq", "vehicle", "stream", F.col("ordinal").cast("long"))


@query("""SELECT vehicle, seq, last_value(CASE WHEN stream = 'purchase' THEN value END IGNORE NULLS) OVER w AS throttle,
  last_value(CASE WHEN stream = 'view' THEN value END IGNORE NULLS) OVER w AS speed FROM sig
  WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def latest_value_align(spark, sf_dir):
    values = {n: F.when(F.col("stream") == s, F.col("value")) for n, s in (("throttle", "purchase"), ("speed", "view"))}
    return J.latest(signals(spark, sf_dir), V, T, values).select("vehicle", "seq", "throttle", "speed")


@query("""SELECT g.vehicle, g.tick, s.value, s.seq FROM (
  SELECT vehicle, unnest(generate_series(first, last, 21600000000)) AS tick FROM (
    SELECT vehicle, (min(t) // 21600000000) * 21600000000 + 21600000000 AS first, max(t) AS last FROM sig GROUP BY vehicle) WHERE first <= last) g
  ASOF JOIN sig s ON g.vehicle = s.vehicle AND g.tick > s.t""")
def tick_grid_asof(spark, sf_dir):
    return J.at_ticks(signals(spark, sf_dir), V, "t", T, ["value", "seq"], 6 * HOUR).select("vehicle", "tick", "value", "seq")


@query("""SELECT p.seq, p.vehicle, v.value AS seen, v.seq AS seen_seq FROM (SELECT * FROM sig WHERE stream = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM sig WHERE stream = 'view') v ON p.vehicle = v.vehicle AND p.t >= v.t""")
def as_of_join(spark, sf_dir):
    df = signals(spark, sf_dir)
    views = df.filter("stream = 'view'").select("vehicle", "t", F.col("value").alias("seen"), F.col("seq").alias("seen_seq"))
    return J.as_of(df.filter("stream = 'purchase'"), views, V, "t", "t", ["seen", "seen_seq"]).select("seq", "vehicle", "seen", "seen_seq")


@query("SELECT seq, CASE WHEN e >= 1728000000000 THEN 'critical' WHEN e >= 864000000000 THEN 'warn' WHEN e >= 3600000000 THEN 'ok' END AS state FROM (SELECT seq, t - min(t) OVER () AS e FROM sig)")
def scenario_lookup(spark, sf_dir):
    df = signals(spark, sf_dir)
    begun = df.agg(F.min("t").alias("t0"))
    steps = [(HOUR, "ok"), (20 * 24 * HOUR, "critical"), (10 * 24 * HOUR, "warn")]
    return J.step_lookup(df.crossJoin(F.broadcast(begun)), steps, F.col("t") - F.col("t0"), "state").select("seq", "state")  # one row


@query("SELECT seq, t + vehicle - t AS rtt, (t - 7) - (t + vehicle // 2) AS offset_us FROM sig")
def sync_exchange(spark, sf_dir):
    sent, received = F.col("t"), F.col("t") + F.col("vehicle")
    trip = received - sent
    return signals(spark, sf_dir).select("seq", trip.alias("rtt"), (F.col("t") - 7 - (sent + F.floor(trip / 2))).alias("offset_us"))


@query("""SELECT p.seq, coalesce(a.seq, -1) AS acked, coalesce(a.seq, -1) >= p.seq - 500 AS recent FROM (SELECT * FROM sig WHERE stream = 'error') p
  ASOF LEFT JOIN (SELECT * FROM sig WHERE stream = 'click') a ON p.vehicle = a.vehicle AND p.t >= a.t""")
def report_acks(spark, sf_dir):
    df = signals(spark, sf_dir)
    acks = df.filter("stream = 'click'").select("vehicle", "t", F.col("seq").alias("acked"))
    out = J.as_of(df.filter("stream = 'error'"), acks, V, "t", "t", ["acked"]).select("seq", F.coalesce("acked", F.lit(-1)).cast("long").alias("acked"))
    return out.withColumn("recent", F.col("acked") >= F.col("seq") - 500)


# --- Window detectors -----------------------------------------------------------------------------------------------


@query("SELECT vehicle, seq, round(median(value) OVER (PARTITION BY vehicle ORDER BY t, seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 6) AS median FROM sig")
def rolling_median(spark, sf_dir):
    return _rounded(W.rolling_median(signals(spark, sf_dir), V, T, "value", 9), "median").select("vehicle", "seq", "median")


@query("""SELECT vehicle, seq, round((value - m) / greatest(1.4826 * list_median(list_transform(l, lambda x: abs(x - m))), 0.005), 6) AS z FROM (
  SELECT *, list_median(l) AS m FROM (SELECT vehicle, seq, value, list(value) OVER (PARTITION BY vehicle ORDER BY t, seq ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS l FROM sig))""")
def rolling_mad_z(spark, sf_dir):
    return _rounded(W.rolling_z(signals(spark, sf_dir), V, T, "value", 32, 0.005), "z").select("vehicle", "seq", "z")


_CUSUM = """, d AS (SELECT vehicle, seq, t, (value - 50) / 50 AS x FROM sig), c AS (SELECT *, sum(x - 0.5) OVER w AS u, sum(-x - 0.5) OVER w AS n FROM d WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)),
 s AS (SELECT *, u - least(0, min(u) OVER w) AS up, n - least(0, min(n) OVER w) AS down FROM c WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq))"""


@query(f"{_CUSUM} SELECT vehicle, seq, round(up, 6) AS cusum_up, round(down, 6) AS cusum_down, CASE WHEN up > 4 THEN 'up' WHEN down > 4 THEN 'down' END AS trip FROM s")
def cusum(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("x", (F.col("value") - 50) / 50)
    return _rounded(W.cusum(df, V, _nulls_last(T), "x", 0.0, 0.5, 4.0), "cusum_up", "cusum_down").select("vehicle", "seq", "cusum_up", "cusum_down", "trip")


@query("""SELECT vehicle, seq, round(u - least(0, min(u) OVER w) + 1e-8, 6) AS ph_up, round(greatest(0, max(n) OVER w) - n + 1e-8, 6) AS ph_down FROM (
  SELECT *, sum(value - m - 5) OVER w AS u, sum(value - m + 5) OVER w AS n FROM (SELECT *, avg(value) OVER w AS m FROM sig WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq))
  WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)) WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)""")
def page_hinkley(spark, sf_dir):
    # Averages of a few cents end in a 5 often; the nudge keeps both engines off the tie.
    df = W.page_hinkley(signals(spark, sf_dir), V, _nulls_last(T), "value", 5.0, 60.0)
    return _rounded(df.withColumns({n: F.col(n) + 1e-8 for n in ("ph_up", "ph_down")}), "ph_up", "ph_down").select("vehicle", "seq", "ph_up", "ph_down")


@query("""SELECT vehicle, seq, CASE WHEN lag(value, 2) OVER w IS NULL THEN value ELSE list_sort([value, lag(value) OVER w, lag(value, 2) OVER w])[2] END AS despiked
  FROM sig WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)""")
def median3(spark, sf_dir):
    return W.despiked(signals(spark, sf_dir), V, T, "value").select("vehicle", "seq", "despiked")


@query("""SELECT vehicle, seq, CAST(sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle, g ORDER BY t, seq) AS BIGINT) AS streak FROM (
  SELECT *, sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY t, seq) AS g FROM sig)""")
def streak_hold(spark, sf_dir):
    return W.streak(signals(spark, sf_dir), V, T, F.col("value") > 60, F.col("value") < 20).select("vehicle", "seq", "streak")


@query("""SELECT vehicle, seq, best.k AS rank, best.v AS at_value FROM (SELECT vehicle, seq, max(CASE WHEN r > 0 THEN {'k': r, 'n': -i, 'v': value} END) OVER (PARTITION BY vehicle ORDER BY t, seq) AS best FROM (
  SELECT *, CASE WHEN value > 200 THEN 3 WHEN value > 120 THEN 2 WHEN value > 80 THEN 1 ELSE 0 END AS r, row_number() OVER (PARTITION BY vehicle ORDER BY t, seq) AS i FROM sig))""")
def first_trip_latch(spark, sf_dir):
    v = F.col("value")
    rank = F.when(v > 200, 3).when(v > 120, 2).when(v > 80, 1).otherwise(0)
    return W.latch(signals(spark, sf_dir), V, T, rank, ["value"]).select("vehicle", "seq", F.col("latched.rank").alias("rank"), F.col("latched.value").alias("at_value"))


@query("""SELECT vehicle, seq, coalesce(first_value(CASE WHEN value > 150 THEN value END IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), value) AS value FROM sig""")
def freeze_after_trip(spark, sf_dir):
    return W.freeze_after(signals(spark, sf_dir), V, T, F.col("value") > 150, ["value"]).select("vehicle", "seq", "value")


@query("""SELECT vehicle, seq, coalesce(CAST(c + CAST(1.0 AS FLOAT) AS FLOAT) < lag(c) OVER w, false) OR coalesce(r > CAST(lag(r) OVER w + CAST(0.05 AS FLOAT) AS FLOAT), false) AS gauge_fault FROM (
  SELECT *, CAST(value AS FLOAT) AS c, CAST(value / 500 AS FLOAT) AS r FROM sig) WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)""")
def gauge_monotonic(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("c", F.col("value").cast("float")).withColumn("r", (F.col("value") / 500).cast("float"))
    return W.gauge_faults(df, V, T, "c", "r").select("vehicle", "seq", "gauge_fault")


@query("""SELECT vehicle, seq, CASE WHEN dt > 0 THEN round(dv / dt, 6) END AS rate FROM (
  SELECT vehicle, seq, (t - lag(t) OVER w) / 3600000000.0 AS dt, value - lag(value) OVER w AS dv FROM sig WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq))""")
def rate_of_change(spark, sf_dir):
    return _rounded(W.rate(signals(spark, sf_dir), V, T, "t", "value", float(HOUR)), "rate").select("vehicle", "seq", "rate")


@query("SELECT vehicle, seq, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY vehicle ORDER BY t, seq ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 6) AS reject_rate FROM sig")
def reject_rate(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("bad", F.col("value") > 100)
    return _rounded(W.reject_rate(df, V, T, "bad"), "reject_rate").select("vehicle", "seq", "reject_rate")


@query("""SELECT vehicle, seq, t - first_value(t) OVER w >= 172800000000 AND sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER w >= 5 AS warm FROM sig
  WINDOW w AS (PARTITION BY vehicle ORDER BY t, seq)""")
def warm_up(spark, sf_dir):
    return W.warm(signals(spark, sf_dir), V, T, "t", F.col("value") > 40, 48 * HOUR, 5).select("vehicle", "seq", "warm")


@query("SELECT vehicle, min({'t': t, 'seq': seq, 'value': value}).value AS home, min(t) AS since FROM sig GROUP BY vehicle")
def first_values(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("vehicle").agg(F.min_by("value", F.struct("t", "seq")).alias("home"), F.min("t").alias("since"))


@query(""", n AS (SELECT vehicle, stream, seq, CAST(coalesce(seq - lag(seq) OVER w - 1, 0) AS DOUBLE) AS gap, CAST(CASE WHEN t > lag(t) OVER w THEN t - lag(t) OVER w END AS DOUBLE) AS dt,
   row_number() OVER w AS i FROM sig WINDOW w AS (PARTITION BY vehicle, stream ORDER BY t, seq)),
  s AS (SELECT vehicle, stream, seq, i, gap AS g, dt AS m, CAST(0 AS DOUBLE) AS v FROM n WHERE i = 1 UNION ALL
   SELECT n.vehicle, n.stream, n.seq, n.i, s.g + 0.05 * (n.gap - s.g), CASE WHEN s.m IS NULL THEN n.dt WHEN n.dt IS NULL THEN s.m ELSE s.m + 0.05 * (n.dt - s.m) END,
    CASE WHEN s.m IS NULL OR n.dt IS NULL THEN s.v ELSE 0.95 * (s.v + (n.dt - s.m) * 0.05 * (n.dt - s.m)) END FROM s JOIN n ON n.vehicle = s.vehicle AND n.stream = s.stream AND n.i = s.i + 1)
  SELECT vehicle, stream, seq, round(g / (1 + g), 6) AS lost_share, round(3600000000 / m, 6) AS rate, round(sqrt(v) / 3600000000, 6) AS jitter FROM s""")
def link_quality(spark, sf_dir):
    df = I.inter_arrival(I.seq_gap(signals(spark, sf_dir), VS, T, "seq"), VS, T, "t")
    out = C.link_quality(df, VS, T, "seq_gap", "dt", HOUR, 0.05)
    return _rounded(out, "lost_share", "rate", "jitter").select(*VS, "seq", "lost_share", "rate", "jitter")


@query("""SELECT vehicle, seq, CASE WHEN NOT armed THEN 'disarmed' WHEN t - since < 3000000000 THEN 'transient' WHEN inside = 1 THEN 'maneuver' ELSE 'steady' END AS phase FROM (
  SELECT *, min(CASE WHEN armed THEN t END) OVER w AS since, last_value(CASE WHEN length >= 5 AND band <> 0 THEN band END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM (
   SELECT *, row_number() OVER (PARTITION BY vehicle, epoch, run ORDER BY t, seq) AS length FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY vehicle ORDER BY t, seq) AS run FROM (
     SELECT *, CASE WHEN lag(band) OVER (PARTITION BY vehicle ORDER BY t, seq) = band THEN 0 ELSE 1 END AS fresh FROM (
      SELECT *, CASE WHEN NOT armed THEN 0 WHEN omega > 0.35 THEN 1 WHEN omega < 0.25 THEN -1 ELSE 0 END AS band, sum(CASE WHEN armed THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY t, seq) AS epoch FROM (
       SELECT vehicle, seq, t * 1000 AS t, seq % 97 <> 0 AS armed, value / 200 AS omega FROM sig))))) WINDOW w AS (PARTITION BY vehicle, epoch ORDER BY t, seq))""")
def flight_phase(spark, sf_dir):
    df = signals(spark, sf_dir).select("vehicle", "seq", (F.col("t") * 1000).alias("t"), F.when(F.col("seq") % 97 == 0, 1).otherwise(2).alias("arming"), (F.col("value") / 200).alias("omega"))
    return W.flight_phase(df, V, T, "t", "arming", "omega").select("vehicle", "seq", "phase")


# --- Aggregations ---------------------------------------------------------------------------------------------------


@query("""SELECT vehicle, stream, count(*) AS n, min(t) AS first, max(t) AS last, CAST(sum(gap) AS BIGINT) AS gap_total FROM (
  SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY vehicle, stream ORDER BY t, seq) - 1, 0) AS gap FROM sig) GROUP BY ALL""")
def stream_rollup(spark, sf_dir):
    return A.stream_rollup(I.seq_gap(signals(spark, sf_dir), VS, T, "seq"), VS, "t").withColumnRenamed("rows", "n")


@query("SELECT stream, vehicle % 10 AS segment, count(*) AS n, round(sum(value), 4) AS total FROM sig GROUP BY ROLLUP (stream, vehicle % 10)")
def report_totals(spark, sf_dir):
    df = signals(spark, sf_dir).select("stream", (F.col("vehicle") % 10).alias("segment"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    return _rounded(A.totals(df, ["stream", "segment"], ["n", "total"]), "total", digits=4)


@query("SELECT stream, CAST(vehicle % 4 AS VARCHAR) AS reason, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS dropped FROM sig WHERE value > 50 GROUP BY ALL")
def drop_totals(spark, sf_dir):
    df = signals(spark, sf_dir).select("stream", (F.col("vehicle") % 4).cast("string").alias("reason"), F.when(F.col("value") > 50, "drop").alias("kind"), F.floor("value").alias("count"))
    return A.drop_totals(df)


_TIMELINE = ", tl AS (SELECT vehicle, seq, CASE WHEN value > 300 THEN 'critical' WHEN value > 150 THEN 'warn' ELSE 'ok' END AS severity, CAST(1000 * (vehicle % 8 + 1) + 1 AS INTEGER) AS detail_code FROM sig)"


def _timeline(spark, sf_dir):
    v = F.col("value")
    severity = F.when(v > 300, "critical").when(v > 150, "warn").otherwise("ok")
    return signals(spark, sf_dir).select("vehicle", "seq", severity.alias("severity"), (1000 * (F.col("vehicle") % 8 + 1) + 1).cast("int").alias("detail_code"))


@query(f"""{_TIMELINE} SELECT *, round((warn_ticks + critical_ticks) / ticks, 9) AS warn_rate, critical_ticks = 0 AND (warn_ticks + critical_ticks) / ticks <= 0.005 AS passes FROM (
  SELECT count(DISTINCT vehicle) AS missions, count(*) AS ticks, count(*) FILTER (severity = 'warn') AS warn_ticks, count(*) FILTER (severity = 'critical') AS critical_ticks FROM tl)""")
def audit_stats(spark, sf_dir):
    return _rounded(A.audit(_timeline(spark, sf_dir), V), "warn_rate", digits=9)


@query(f"{_TIMELINE} SELECT detail_code, count(*) AS ticks FROM tl WHERE severity IN ('warn', 'critical') GROUP BY 1")
def audit_histogram(spark, sf_dir):
    return A.audit_histogram(_timeline(spark, sf_dir))


@query(f"{_TIMELINE} SELECT detail_code // 1000 AS block, CAST(max(CASE severity WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 ELSE 3 END) AS INTEGER) AS worst FROM tl GROUP BY 1")
def worst_by_block(spark, sf_dir):
    df = _timeline(spark, sf_dir)
    return df.groupBy(S.detail_block(F.col("detail_code")).alias("block")).agg(F.max(S.lookup(S.MERGE_RANK, F.col("severity"))).alias("worst"))


@query("""SELECT vehicle, l[CAST(least(floor(len(l) * 90 / 100), len(l) - 1) AS INTEGER) + 1] AS p90, l[CAST(floor(len(l) / 2) AS INTEGER) + 1] AS upper_median FROM (
  SELECT vehicle, list(value ORDER BY value) AS l FROM sig GROUP BY 1)""")
def nearest_rank_percentile(spark, sf_dir):
    return A.percentiles(signals(spark, sf_dir), V, "value", {"p90": A.rank_of(90), "upper_median": F.expr("n div 2")})


@query("""SELECT vehicle, CAST(bit_count(bit_or(1 << s)) AS INTEGER) AS sectors FROM (
  SELECT vehicle, CAST(((CAST(trunc((value / 100 - 2 + 3.141592653589793) / 6.283185307179586 * 8) AS BIGINT) % 8) + 8) % 8 AS INTEGER) AS s FROM sig) GROUP BY 1""")
def sector_popcount(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("sector", S.heading_sector(F.col("value") / 100 - 2))
    return A.sectors_visited(df, V, F.col("sector"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))) / 8, 9) AS mean FROM embeddings")
def array_mean(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return _rounded(df.select("vec_id", A.active_mean(F.col("embedding"), F.lit(8)).alias("mean")), "mean", digits=9)


@query("""SELECT vec_id, i AS worst, round(x, 9) AS excess FROM (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS n FROM (
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) - m AS x FROM (
   SELECT vec_id, embedding, list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE))) / 4 AS m, unnest([1, 2, 3, 4]) AS i FROM embeddings))) WHERE n = 1""")
def array_excess_worst(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", A.worst_excess(F.slice("embedding", 1, 4)).alias("w"))
    return df.select("vec_id", F.col("w.index").alias("worst"), F.round("w.excess", 9).alias("excess"))


_LANES = ["battery", "vibration", "estimator", "gps", "motor", "link", "thermal", "mission"]


def _findings(spark, sf_dir):
    v, lane = F.col("value"), (F.col("seq") % 8).cast("int")
    severity = F.when(v > 200, "critical").when(v > 100, "warn").otherwise("ok")
    action = F.when(severity == "ok", "none").when(severity == "warn", "warn_only").when(lane == 7, "rtl").when(lane.isin(2, 3), "hold").otherwise("land")
    return signals(spark, sf_dir).select(
        "vehicle", F.floor(F.col("t") / (24 * HOUR)).alias("tick"), F.get(F.array(*(F.lit(x) for x in _LANES)), lane).alias("lane"),
        F.when(F.col("seq") % 19 == 0, "degraded").otherwise("available").alias("availability"), severity.alias("severity"), action.alias("action"),
        (F.col("seq") % 1000 + 1000).cast("int").alias("detail_code"), v.cast("float").alias("value"), F.lit(100.0).cast("float").alias("limit"), F.lit(80).alias("confidence"),
        (F.col("seq") % 5 != 0).alias("timesync_locked"), "seq",
    )


@query("""SELECT vehicle, tick, coalesce(top.severity, 'ok') AS severity, CASE WHEN lost AND top.action IN ('rtl', 'hold') THEN 'land' ELSE coalesce(top.action, 'none') END AS action,
  CAST(flags | CASE WHEN degraded THEN 512 ELSE 0 END | CASE WHEN locked THEN 0 ELSE 1024 END AS INTEGER) AS health_flags FROM (
  SELECT vehicle, tick, max(CASE WHEN raised THEN {'r': rank, 'p': -priority, 'severity': severity, 'action': action} END) AS top, coalesce(bit_or(CASE WHEN raised THEN flag END), 0) AS flags,
   bool_or(degraded) AS degraded, bool_and(locked) AS locked, bool_or(raised AND lane IN (2, 3)) AS lost FROM (
   SELECT *, NOT degraded AND rank > 0 AS raised, CASE WHEN rank = 0 THEN 'none' WHEN rank = 1 THEN 'warn_only' WHEN lane = 7 THEN 'rtl' WHEN lane IN (2, 3) THEN 'hold' ELSE 'land' END AS action,
     [0, 4, 2, 3, 1, 6, 5, 7][lane + 1] AS priority, [1, 4, 16, 8, 2, 64, 32, 128][lane + 1] AS flag FROM (
    SELECT vehicle, CAST(floor(t / 86400000000) AS BIGINT) AS tick, CAST(seq % 8 AS INTEGER) AS lane, seq % 19 = 0 AS degraded, seq % 5 <> 0 AS locked,
      CASE WHEN value > 200 THEN 3 WHEN value > 100 THEN 1 ELSE 0 END AS rank, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'warn' ELSE 'ok' END AS severity FROM sig)) GROUP BY ALL)""")
def merge_dominant(spark, sf_dir):
    return A.merge_findings(_findings(spark, sf_dir), ["vehicle", "tick"]).select("vehicle", "tick", "severity", "action", "health_flags")


@query("SELECT vehicle, CAST(bit_or(1 << CAST(seq % 8 AS INTEGER)) AS INTEGER) AS flags FROM sig WHERE value > 100 GROUP BY 1")
def flags_or(spark, sf_dir):
    df = signals(spark, sf_dir).filter("value > 100")
    return df.groupBy("vehicle").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("seq") % 8).cast("int"))).alias("flags"))


@query(f"""{_TIMELINE}, a AS (SELECT vehicle, severity, detail_code, row_number() OVER (PARTITION BY vehicle ORDER BY seq) AS ordinal FROM tl),
 b AS (SELECT vehicle, CASE WHEN ordinal % 50 = 0 THEN 'warn' ELSE severity END AS severity, detail_code, ordinal FROM a WHERE ordinal < 60)
 SELECT coalesce(a.vehicle, b.vehicle) AS vehicle, coalesce(a.ordinal, b.ordinal) AS ordinal, a.severity AS left_severity, b.severity AS right_severity FROM a FULL JOIN b ON a.vehicle = b.vehicle AND a.ordinal = b.ordinal
 WHERE a.severity IS DISTINCT FROM b.severity OR a.detail_code IS DISTINCT FROM b.detail_code""")
def timeline_diff(spark, sf_dir):
    a = J.in_order(_timeline(spark, sf_dir), V, ["seq"]).drop("seq").withColumn("ordinal", F.col("ordinal").cast("long"))
    b = a.filter("ordinal < 60").withColumn("severity", F.when(F.col("ordinal") % 50 == 0, "warn").otherwise(F.col("severity")))
    out = A.timeline_diff(a, b.select(a.columns), V, "ordinal")
    return out.select("vehicle", "ordinal", F.col("left.severity").alias("left_severity"), F.col("right.severity").alias("right_severity"))


@query("""SELECT vehicle, stream, m.n AS manifest_rows, d.n AS disk_rows, m.n IS NOT DISTINCT FROM d.n AS agrees FROM (
  SELECT vehicle, stream, count(*) + CASE WHEN vehicle % 9 = 0 THEN 1 ELSE 0 END AS n FROM sig WHERE vehicle % 13 <> 0 GROUP BY vehicle, stream) m
  FULL JOIN (SELECT vehicle, stream, count(*) AS n FROM sig WHERE vehicle % 11 <> 0 GROUP BY ALL) d USING (vehicle, stream)""")
def manifest_reconcile(spark, sf_dir):
    df, v = signals(spark, sf_dir), F.col("vehicle")
    counts = lambda x: x.groupBy(*VS).agg(F.count("*").alias("rows"))
    manifest = counts(df.filter(v % 13 != 0)).withColumn("rows", F.col("rows") + F.when(v % 9 == 0, 1).otherwise(0))
    return A.reconcile(manifest, counts(df.filter(v % 11 != 0)), VS)


@query("SELECT vehicle, stream FROM sig WHERE value > 20 EXCEPT ALL SELECT vehicle, stream FROM sig WHERE value > 90")
def set_difference(spark, sf_dir):
    df = signals(spark, sf_dir)
    return df.filter("value > 20").select(*VS).exceptAll(df.filter("value > 90").select(*VS))


@query("SELECT vehicle FROM sig WHERE value > 300 INTERSECT SELECT vehicle FROM sig WHERE stream = 'error' AND value > 100")
def set_intersection(spark, sf_dir):
    df = signals(spark, sf_dir)
    return df.filter("value > 300").select("vehicle").intersect(df.filter("stream = 'error' AND value > 100").select("vehicle"))


@query("""SELECT vehicle, CASE WHEN bool_or(failed AND level = 'corrupt') THEN 'corrupt' WHEN bool_or(failed) THEN 'dirty' ELSE 'clean' END AS verdict,
  coalesce(array_to_string(list_sort(list_distinct(list(reason) FILTER (failed))), ';'), '') AS reasons FROM (
  SELECT vehicle, value > 150 AS failed, CASE WHEN stream = 'error' THEN 'corrupt' ELSE 'dirty' END AS level, stream AS reason FROM sig) GROUP BY 1""")
def verdict(spark, sf_dir):
    df = signals(spark, sf_dir)
    checks = df.select("vehicle", (F.col("value") > 150).alias("failed"), F.when(F.col("stream") == "error", "corrupt").otherwise("dirty").alias("level"), F.col("stream").alias("reason"))
    return A.verdict(checks, V)


@query("SELECT vehicle, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY value DESC, seq) AS n FROM sig) WHERE n <= 3")
def top_values(spark, sf_dir):
    w = Window.partitionBy("vehicle").orderBy(F.desc("value"), "seq")
    return signals(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 3").select("vehicle", "seq", "value")


@query("SELECT DISTINCT ON (stream, vehicle, seq % 1000) stream, vehicle, seq % 1000 AS k FROM sig")
def dedup_key(spark, sf_dir):
    return signals(spark, sf_dir).select("stream", "vehicle", (F.col("seq") % 1000).alias("k")).dropDuplicates()


# --- Scalars --------------------------------------------------------------------------------------------------------

_OCV_SQL = "CASE " + " ".join(f"WHEN s >= {lo} THEN {v_lo} + (s - {lo}) / {hi - lo!r} * ({v_hi} - {v_lo})" for (hi, v_hi), (lo, v_lo) in zip(S.OCV, S.OCV[1:])) + " END"


@query(f"SELECT seq, round({_OCV_SQL}, 9) AS volts FROM (SELECT seq, least(1.0, value / 200) AS s FROM sig)")
def lut_interpolate(spark, sf_dir):
    return _rounded(signals(spark, sf_dir).select("seq", S.ocv(F.col("value") / 200).alias("volts")), "volts", digits=9)


@query("""SELECT seq, round(x, 9) AS p, CAST(floor(floor(x * 100 * 1000 + 0.5) / 1000) + CASE WHEN CAST(floor(x * 100 * 1000 + 0.5) AS BIGINT) % 1000 > 500 OR (CAST(floor(x * 100 * 1000 + 0.5) AS BIGINT) % 1000 = 500
   AND CAST(floor(floor(x * 100 * 1000 + 0.5) / 1000) AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END AS INTEGER) AS percent FROM (SELECT seq, 1 / (1 + exp(-(value - 50) / 10)) AS x FROM sig)""")
def logistic_conf(spark, sf_dir):
    p = S.logistic((F.col("value") - 50) / 10)
    return signals(spark, sf_dir).select("seq", F.round(p, 9).alias("p"), S.confidence_percent(p).alias("percent"))


@query("SELECT seq, CASE WHEN value < 10 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100)) END AS clamped FROM sig")
def clamp01(spark, sf_dir):
    x = F.when(F.col("value") < 10, float("nan")).otherwise(F.col("value") / 100)
    return signals(spark, sf_dir).select("seq", S.clamp01(x).alias("clamped"))


@query("SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2 + CAST(embedding[3] AS DOUBLE) ** 2), 9) AS norm FROM embeddings")
def vector_norm(spark, sf_dir):
    parts = [F.get("embedding", i) for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(*parts), 9).alias("norm"))


@query("""SELECT seq, round(0.020 * exp(2000 * (1 / (value / 10 + 273.15) - 1 / 298.15)) * (1 + 0.5 * greatest(0, 0.2 - least(1, value / 500)) / 0.2), 9) AS ohm,
  round((value / 500 * 5000 - 12 * (seq / 8.0 / 3600) * 1000) / 5000, 9) AS soc_home FROM sig""")
def battery_scalars(spark, sf_dir):
    v = F.col("value")
    home = S.soc_at_home(v / 500, F.col("seq").cast("double"), F.lit(8.0), F.lit(12.0))
    return signals(spark, sf_dir).select("seq", F.round(S.internal_resistance(v / 500, v / 10), 9).alias("ohm"), F.round(home, 9).alias("soc_home"))


@query("""SELECT seq, t * 1000 - vehicle AS companion_ns, CASE WHEN value > 200 THEN CASE WHEN seq % 2 = 0 THEN 1000000000 ELSE 200000000 END WHEN value > 100 THEN 250000000 ELSE 1000000000 END AS interval_ns,
  CASE WHEN vehicle % 40 >= 8 AND seq % 30 <= 20 AND value < 60 THEN 'locked' WHEN vehicle % 40 >= 4 THEN 'degraded' ELSE 'unlocked' END AS quality, printf('%06d.parquet', seq) AS part,
  CAST('0x' || substr(sha256(stream), 1, 8) AS BIGINT) AS dialect FROM sig""")
def conversions(spark, sf_dir):
    v, seq = F.col("value"), F.col("seq")
    severity = F.when(v > 200, "critical").when(v > 100, "warn").otherwise("ok")
    return signals(spark, sf_dir).select(
        "seq", S.controller_to_companion_ns(F.col("t"), F.col("vehicle")).alias("companion_ns"), S.report_interval_ns(severity, seq % 2 == 0).alias("interval_ns"),
        S.sync_quality(F.col("vehicle") % 40, (seq % 30) * 1_000_000, F.when(v < 60, 0.0).otherwise(0.5)).alias("quality"), S.part_name(seq).alias("part"), S.dialect_id(F.col("stream")).alias("dialect"),
    )


@query("""SELECT seq, 'reply' AS route FROM sig WHERE vehicle % 5 = 0 AND seq % 3 <> 0 UNION ALL SELECT seq, 'telemetry' FROM sig WHERE vehicle % 5 <> 0
  UNION ALL SELECT seq, 'acknowledgement' FROM sig WHERE vehicle % 5 = 1""")
def sync_demux(spark, sf_dir):
    df = signals(spark, sf_dir).select("seq", (F.col("vehicle") % 5).alias("message"), (F.col("seq") % 3).alias("sent"))
    routes = zip(I.demux(df, "message", "sent", 0, 1), ("reply", "telemetry", "acknowledgement"))
    return J.merged([d.select("seq", F.lit(name).alias("route")) for d, name in routes])


_DROPPED = ", ".join(f"CAST(coalesce(sum(n) FILTER (kind = 'drop' AND stream_id = {k}), 0) AS BIGINT) AS dropped_{name}" for name, k in I.STREAMS.items())


@query(f"""SELECT vehicle, {_DROPPED}, CAST(coalesce(sum(n) FILTER (kind = 'drop' AND stream_id IS NULL), 0) AS BIGINT) AS raw_dropped, CAST(coalesce(sum(n) FILTER (kind = 'seal'), 0) AS BIGINT) AS parts_sealed,
  CAST(coalesce(sum(n) FILTER (kind = 'write_error'), 0) AS BIGINT) AS write_errors, CAST(coalesce(sum(n) FILTER (kind = 'lag'), 0) AS BIGINT) AS lagged, max({{'t': t, 'x': stage}}).x AS shed_stage,
  max({{'t': t, 'x': free}}) FILTER (free IS NOT NULL).x AS free_bytes, coalesce(bool_or((kind = 'drop' AND n > 0) OR kind = 'write_error' OR stage > 0), false) AS warn FROM (
  SELECT vehicle, t, CAST(floor(value) AS BIGINT) AS n, ['drop', 'seal', 'shed', 'write_error', 'lag'][seq % 5 + 1] AS kind, CASE WHEN seq % 9 < 8 THEN seq % 9 END AS stream_id,
   CASE WHEN seq % 50 = 2 THEN 1 ELSE 0 END AS stage, CASE WHEN seq % 5 = 2 THEN CAST(floor(value * 10) AS BIGINT) END AS free FROM sig) GROUP BY vehicle""")
def log_health(spark, sf_dir):
    seq, v = F.col("seq"), F.col("value")
    operations = signals(spark, sf_dir).select(
        "vehicle", F.col("t").alias("cc_receive_time_ns"), F.get(F.array(*map(F.lit, ("drop", "seal", "shed", "write_error", "lag"))), (seq % 5).cast("int")).alias("kind"),
        F.when(seq % 9 < 8, seq % 9).alias("stream_id"), F.floor(v).alias("count"), F.when(seq % 50 == 2, 1).otherwise(0).alias("shed_stage"), F.when(seq % 5 == 2, F.floor(v * 10)).alias("free_bytes"),
    )
    return operations.groupBy("vehicle").agg(*A.log_health())


# --- Ordered scans --------------------------------------------------------------------------------------------------


def _recursive(columns: str, first: str, then: str, out: str) -> str:
    """SQL of an ordered fold: n has each vehicle's rows numbered; the state of row i comes from that of row i - 1 (s) and the row (n)."""
    return f""", n AS (SELECT vehicle, seq, t, {columns}, row_number() OVER (PARTITION BY vehicle ORDER BY t, seq) AS i FROM sig),
  s AS (SELECT n.vehicle, n.seq, n.i, {first} FROM n WHERE i = 1 UNION ALL SELECT n.vehicle, n.seq, n.i, {then} FROM s JOIN n ON n.vehicle = s.vehicle AND n.i = s.i + 1)
  SELECT vehicle, seq, {out} FROM s"""


@query(
    _recursive(
        "CAST(value AS DOUBLE) AS x", "x AS mean, CAST(0 AS DOUBLE) AS var", "s.mean + 0.05 * (n.x - s.mean), 0.95 * (s.var + (n.x - s.mean) * 0.05 * (n.x - s.mean))",
        "round(mean + 1e-8, 6) AS ewma, round(var + 1e-7, 5) AS ewma_var",
    )
)
def ewma(spark, sf_dir):
    df = C.ewma(signals(spark, sf_dir), V, T, "value", 0.05)  # off the ties of cents
    return df.select("vehicle", "seq", F.round(F.col("ewma") + 1e-8, 6).alias("ewma"), F.round(F.col("ewma_var") + 1e-7, 5).alias("ewma_var"))


@query("""SELECT vehicle, round(list_reduce(list(value ORDER BY seq), lambda a, x: a + 0.05 * (x - a)), 6) AS ewma FROM sig GROUP BY 1""")
def ewma_fold(spark, sf_dir):
    return _rounded(C.final_ewma(signals(spark, sf_dir), V, "seq", "value", 0.05), "ewma")


def _rls_sql() -> str:
    """The recursion of three-parameter least squares: h the parameters, p the matrix, m = p * phi, w the weight, e the residual."""
    at = range(1, 4)
    dot = lambda v: f"({v}[1] + {v}[2] * u + {v}[3] * u * u)"
    h = ", ".join(f"h[{i}] + m[{i}] / w * e" for i in at)
    p = ", ".join("[" + ", ".join(f"(p[{i}][{j}] - m[{i}] / w * m[{j}]) / 0.999" for j in at) + "]" for i in at)
    start = ", ".join("[" + ", ".join("100::DOUBLE" if i == j else "0::DOUBLE" for j in at) + "]" for i in at)
    moved = ", ".join(dot(f"p[{i}]") for i in at)
    return f""", n AS (SELECT vehicle, seq, vehicle / 1000 + (seq % 10) / 10 AS u, CAST(value AS DOUBLE) AS y, row_number() OVER (PARTITION BY vehicle ORDER BY t, seq) AS i FROM sig),
  s AS (SELECT vehicle, seq, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS e, [0::DOUBLE, 0::DOUBLE, 0::DOUBLE] AS h, [{start}] AS p FROM n WHERE i = 1 UNION ALL
   SELECT vehicle, seq, i, e, [{h}], [{p}] FROM (SELECT *, 0.999 + {dot("m")} AS w, y - {dot("h")} AS e FROM (
    SELECT *, [{moved}] AS m FROM (SELECT n.vehicle, n.seq, n.i, n.u, n.y, s.h, s.p FROM s JOIN n ON n.vehicle = s.vehicle AND n.i = s.i + 1))))
  SELECT vehicle, seq, round(e, 4) AS residual, round(h[1], 4) AS theta0, round(h[2], 4) AS theta1, round(h[3], 4) AS theta2 FROM s WHERE i > 0"""


@query(_rls_sql())
def rls3(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("u", F.col("vehicle") / 1000 + (F.col("seq") % 10) / 10)
    return _rounded(C.rls(df, V, T, "u", "value"), "residual", "theta0", "theta1", "theta2", digits=4).select("vehicle", "seq", "residual", "theta0", "theta1", "theta2")


_FALL = "(n.raw >= s.now OR (s.pending = n.raw AND n.t - s.since >= 86400000000))"


@query(
    _recursive(
        "CASE WHEN value > 300 THEN 2 WHEN value > 80 THEN 1 ELSE 0 END AS raw", "raw AS now, -1 AS pending, t AS since",
        f"CASE WHEN {_FALL} THEN n.raw ELSE s.now END, CASE WHEN {_FALL} THEN -1 ELSE n.raw END, CASE WHEN s.pending = n.raw THEN s.since ELSE n.t END", "['ok', 'warn', 'critical'][now + 1] AS held",
    )
)
def severity_hysteresis(spark, sf_dir):
    v = F.col("value")
    df = signals(spark, sf_dir).withColumn("severity", F.when(v > 300, "critical").when(v > 80, "warn").otherwise("ok"))
    return C.held_severity(df, V, T, "severity", "t", 24 * HOUR, S.HOLD_RANK).select("vehicle", "seq", "held")


def _timesync_sql() -> str:
    """The clock filter: a the accepted exchanges (o offset, r round trip), b the outcomes, each the last 32; nearest ranks of sorted lists."""
    rank = lambda l, q: f"{l}[CAST(least(len({l}) * {q} // 100, len({l}) - 1) AS INTEGER) + 1]"
    of = lambda l, f: f"list_sort(list_transform({l}, lambda x: x.{f}))"
    return f""", n AS (SELECT vehicle, seq, CAST(trunc(value * 1000) AS BIGINT) AS trip, row_number() OVER (PARTITION BY vehicle ORDER BY t, seq) AS i FROM sig),
  s AS (SELECT vehicle, seq, CAST(0 AS BIGINT) AS i, false AS bad, [{{'o': CAST(0 AS BIGINT), 'r': CAST(0 AS BIGINT)}}][:0] AS a, [false][:0] AS b, CAST(0 AS BIGINT) AS rejected FROM n WHERE i = 1 UNION ALL
   SELECT vehicle, seq, i, bad, CASE WHEN bad THEN a ELSE list_append(a, {{'o': CAST(777 - trip // 2 AS BIGINT), 'r': trip}})[-32:] END, list_append(b, bad)[-32:], rejected + CASE WHEN bad THEN 1 ELSE 0 END FROM (
    SELECT *, trip < 0 OR (len(a) >= 8 AND trip > {rank(of("a", "r"), 90)} * 3 // 2) AS bad FROM (
     SELECT n.vehicle, n.seq, n.i, n.trip, s.a, s.b, s.rejected FROM s JOIN n ON n.vehicle = s.vehicle AND n.i = s.i + 1))),
  e AS (SELECT *, {of("a", "o")} AS o, {of("a", "r")} AS r FROM s WHERE i > 0)
  SELECT vehicle, seq, len(a) > 0 AND NOT bad AS accepted, {rank("o", 50)} AS offset_ns, {rank("r", 50)} AS rtt_ns, rejected,
   CASE WHEN len(a) >= 8 AND {rank("r", 90)} - {rank("r", 10)} <= 20000000 AND len(list_filter(b, lambda x: x)) / len(b) < 0.3 THEN 'locked' WHEN len(a) >= 4 THEN 'degraded' ELSE 'unlocked' END AS quality FROM e"""


@query(_timesync_sql())
def timesync_filter(spark, sf_dir):
    df = signals(spark, sf_dir).select("vehicle", "seq", "t", (F.col("t") * 1000).alias("sent"), (F.col("t") * 1000 + (F.col("value") * 1000).cast("long")).alias("received"), (F.col("t") * 1000 + 777).alias("remote"))
    return C.time_sync(df, V, T, "remote", "sent", "received").select("vehicle", "seq", "accepted", "offset_ns", "rtt_ns", "quality", "rejected")


_WORST = "CASE WHEN n.free < 50 THEN 3 WHEN n.free < 200 THEN 2 WHEN n.free < 400 THEN 1 ELSE 0 END"


@query(
    _recursive(
        "CAST(trunc(value * 10) AS BIGINT) AS free", f"{_WORST} AS stage",
        f"CASE WHEN {_WORST} > s.stage THEN {_WORST} WHEN s.stage > 0 AND n.free >= [600, 300, 100][s.stage] THEN s.stage - 1 ELSE s.stage END", "stage",
    )
)
def shed_ladder(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("free", (F.col("value") * 10).cast("long"))
    return C.shedding(df, V, T, "free", (400, 200, 50), (600, 300, 100)).select("vehicle", "seq", "stage")


_SEND = """(n.severity <> s.sent OR n.t - s.last >= CASE n.severity WHEN 'critical' THEN CASE WHEN n.seq % 2 = 0 THEN 1000000000 ELSE 200000000 END WHEN 'warn' THEN 250000000 ELSE 1000000000 END)"""


@query(
    _recursive(
        "CASE WHEN value > 300 THEN 'critical' WHEN value > 80 THEN 'warn' ELSE 'ok' END AS severity", "severity AS sent, t AS last, true AS send",
        f"CASE WHEN {_SEND} THEN n.severity ELSE s.sent END, CASE WHEN {_SEND} THEN n.t ELSE s.last END, {_SEND}", "send",
    )
)
def report_pacing(spark, sf_dir):
    v = F.col("value")
    df = signals(spark, sf_dir).withColumn("severity", F.when(v > 300, "critical").when(v > 80, "warn").otherwise("ok")).withColumn("acked", F.col("seq") % 2 == 0)
    return C.pacing(df, V, T, "severity", "acked", "t").select("vehicle", "seq", "send")


_NEW = "(s.size >= 50000 OR n.t - s.opened >= 864000000000 OR n.boot <> s.boot)"


@query(
    _recursive(
        "seq // 5000 AS boot, CAST(trunc(value * 100) AS BIGINT) AS bytes", "0 AS segment, bytes AS size, t AS opened, boot",
        f"s.segment + CASE WHEN {_NEW} THEN 1 ELSE 0 END, CASE WHEN {_NEW} THEN n.bytes ELSE s.size + n.bytes END, CASE WHEN {_NEW} THEN n.t ELSE s.opened END, CASE WHEN {_NEW} THEN n.boot ELSE s.boot END", "segment",
    )
)
def segment_rotation(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("boot", F.floor(F.col("seq") / 5000)).withColumn("size", (F.col("value") * 100).cast("long"))
    return C.rotation(df, V, T, "boot", "size", "t", 50_000, 240 * HOUR).select("vehicle", "seq", "segment")


# --- The live path over the same rows -------------------------------------------------------------------------------


def _live(spark, sf_dir):
    """The table events as a stream."""
    path = f"{sf_dir}/event[s].parquet"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("vehicle"), F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("value"), F.lit(0).cast("long").alias("seq_gap"))


@query("SELECT stream, t // 3600000000 AS hour, count(*) AS n FROM sig GROUP BY ALL")
def live_counters(spark, sf_dir):
    found = live.drained(live.counters(_live(spark, sf_dir), ["stream"], every="1 hour"), "complete")
    return found.select("stream", F.expr("unix_micros(at) div 3600000000").alias("hour"), F.col("rows").alias("n"))


@query(_recursive("value", "CAST(value AS DOUBLE) AS mean", "s.mean + 0.05 * (n.value - s.mean)", "round(mean + 1e-8, 6) AS ewma"))
def live_ewma(spark, sf_dir):
    df = live.drained(live.running_ewma(_live(spark, sf_dir), V, "seq", "value", 0.05))
    return _rounded(df.withColumn("ewma", F.col("ewma") + 1e-8), "ewma")  # off the ties of cents


# --- Replay of missions: sequential folds whose rows no SQL gives; tests hold them against an interpreter of one row after another ------------------


def _missions(spark, sf_dir):
    return stored(missions(spark, sf_dir), "missions")  # the lanes read them several times


@query()
def replay_timeline(spark, sf_dir):
    return replay.replay(_missions(spark, sf_dir))


@query()
def replay_lanes(spark, sf_dir):
    found = replay.lane_findings(_missions(spark, sf_dir))
    return found.groupBy("mission_id", "lane", "availability", "severity", "detail_code").agg(F.count("*").alias("ticks"), F.min("tick").alias("first_tick"))


@query()
def replay_hash(spark, sf_dir):
    return replay.timeline_hash(replay.replay(_missions(spark, sf_dir)))


@query()
def replay_audit(spark, sf_dir):
    return A.audit(replay.replay(_missions(spark, sf_dir)), ["mission_id"])
