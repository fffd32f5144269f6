"""Queries of recursions by composition, and of ordered work on a stream, beside their row-at-a-time and batch twins: the SQL is the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import align as J
from tidemark.operators import merkle
from tidemark.operators import prefix as P
from tidemark.plans import queries as Q
from tidemark.plans.adapters import signals
from tidemark.plans.queries import HOUR, T, V, query
from tidemark.streaming import live, ordered


def _day():
    """Rows of a vehicle are sorted day by day."""
    return F.floor(F.col("t") / (24 * HOUR))


def _sql(name: str) -> str:
    return Q.ORACLES[name].partition(f"{Q.SIGNALS} ")[2]


@query(_sql("ewma"))
def ewma_prefix(spark, sf_dir):
    df = P.ewma(signals(spark, sf_dir), V, T, "value", 0.05, _day())
    return df.select("vehicle", "seq", F.round(F.col("ewma") + 1e-8, 6).alias("ewma"), F.round(F.col("ewma_var") + 1e-7, 5).alias("ewma_var"))


@query(_sql("shed_ladder"))
def shed_ladder_tree(spark, sf_dir):
    df = signals(spark, sf_dir).withColumn("free", (F.col("value") * 10).cast("long"))
    return P.shedding(df.select(*V, *T, "free"), V, T, "free", (400, 200, 50), (600, 300, 100), _day()).select("vehicle", "seq", "stage")


def _fitted(spark, sf_dir):
    return signals(spark, sf_dir).withColumn("u", F.col("vehicle") / 1000 + (F.col("seq") % 10) / 10)


@query(_sql("rls3").replace(", 4) AS", ", 2) + 0.0 AS"))
def rls3_information(spark, sf_dir):
    found = P.least_squares(_fitted(spark, sf_dir), V, T, "u", "value", block=_day())
    return found.select("vehicle", "seq", *((F.round(c, 2) + 0.0).alias(c) for c in ("residual", "theta0", "theta1", "theta2")))  # no minus zero


#: What a stream that may be an hour late has passed once it has read everything.
_PASSED = "passed AS (SELECT * FROM sig WHERE t <= (SELECT (max(t) // 1000 - 3600000) * 1000 FROM sig))"


def _live(spark, sf_dir):
    return Q._live(spark, sf_dir).withColumn("t", F.unix_micros("ts"))


@query(f""", {_PASSED} {_sql("tick_grid_asof").replace("FROM sig", "FROM passed").replace("JOIN sig", "JOIN passed").replace(", s.seq", "")}""")
def live_grid_asof(spark, sf_dir):
    with ordered.state_store(spark):
        found = live.drained(ordered.live_grid(_live(spark, sf_dir), V, ["value"], late="1 hour", step=6 * HOUR))
    return found.select("vehicle", "tick", "value")


@query(f""", {_PASSED} {_sql("timesync_filter").replace("FROM sig", "FROM passed")}""")
def live_timesync(spark, sf_dir):
    t = F.col("t")
    rows = _live(spark, sf_dir).withColumns({"sent": t * 1000, "received": t * 1000 + (F.col("value") * 1000).cast("long"), "remote": t * 1000 + 777})
    with ordered.state_store(spark):
        return live.drained(ordered.live_time_sync(rows, V, "remote", "sent", "received", late="1 hour"))


@query(_sql("timeline_diff") + " QUALIFY row_number() OVER (PARTITION BY coalesce(a.vehicle, b.vehicle) ORDER BY coalesce(a.ordinal, b.ordinal)) <= 20")
def timeline_tree_diff(spark, sf_dir):
    """The first twenty differences of each vehicle's two timelines, found through trees of hashes."""
    a = J.in_order(Q._timeline(spark, sf_dir), V, ["seq"]).drop("seq").withColumn("ordinal", F.col("ordinal").cast("long"))
    b = a.filter("ordinal < 60").withColumn("severity", F.when(F.col("ordinal") % 50 == 0, "warn").otherwise(F.col("severity")))
    out = merkle.tree_diff(a, b.select(a.columns), V)
    return out.select("vehicle", "ordinal", F.col("left.severity").alias("left_severity"), F.col("right.severity").alias("right_severity"))
