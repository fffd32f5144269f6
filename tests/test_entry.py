"""The driver's contract."""

import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

import __spark_entry__


def test_queries_are_told_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


@pytest.mark.parametrize("name", ["cusum", "page_hinkley"])
def test_drift_sums_equal_their_sql_on_ties_and_null_times(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    start = datetime(2024, 1, 1)
    rows = [(i // 2, None if i % 14 == 3 else start + timedelta(minutes=i // 2), i // 2 % 3, "view", float(i * 37 % 211), "{}") for i in range(240)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.withColumn("ts", events.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"SELECT * FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(want, key=str)
