"""Checking a recorded mission against its manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import reconcile, verdict
from tidemark.sources import streams
from tidemark.sources.footers import footers


def part_rollup(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Rows, first and last receive time, gaps, parts and bytes of each segment and stream: all but the gaps from the parts' footers, so that only ``seq_gap`` is scanned.

    Parts whose footers lack the extremes of the receive time are scanned for it.
    """
    parts = footers(spark, root, "cc_receive_time_ns").withColumn("segment", F.regexp_extract("path", r"/(segment_[^/]*)/([^/]*)/[^/]*$", 1)).withColumn("stream", F.regexp_extract("path", r"/(segment_[^/]*)/([^/]*)/[^/]*$", 2))
    told = parts.filter((F.col("segment") != "") & F.col("stream").isin(names))
    rolled = told.groupBy("segment", "stream").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), F.bool_and("known").alias("known"))
    rolled = rolled.filter("rows > 0")
    gaps = reduce(DataFrame.unionByName, [streams.read_stream(spark, root, n).groupBy("segment").agg(F.sum("seq_gap").alias("gap_total")).withColumn("stream", F.lit(n)) for n in names])
    out = rolled.join(gaps, ["segment", "stream"])
    if not rolled.filter("not known").isEmpty():
        ends = reduce(DataFrame.unionByName, [streams.read_stream(spark, root, n).groupBy("segment").agg(F.min("cc_receive_time_ns").alias("a"), F.max("cc_receive_time_ns").alias("b")).withColumn("stream", F.lit(n)) for n in names])
        out = out.join(ends, ["segment", "stream"]).withColumn("first", F.col("a")).withColumn("last", F.col("b")).drop("a", "b")
    return out.select("segment", "rows", "first", "last", "gap_total", "parts", "bytes", "stream")


def inspect(spark: SparkSession, root: str, names: list[str], dialect_hash: str, schema_version: int, rolled: DataFrame | None = None) -> DataFrame:
    """(mission_id, verdict, reasons): corrupt if hash or schema version differ; dirty if the mission or a segment isn't closed, rows of a
    closed segment differ from the manifest, or parts are still in progress; clean otherwise."""
    manifest = streams.read_manifest(spark, root)
    mission = manifest.select("mission_id", "complete", "dialect_hash", "schema_version").distinct()
    check = lambda level, reason, failed: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), failed.alias("failed"))
    head = mission.select(
        "mission_id",
        F.inline(F.array(
            check("corrupt", "dialect hash", F.col("dialect_hash") != dialect_hash), check("corrupt", "schema version", F.col("schema_version") != schema_version), check("dirty", "not complete", ~F.col("complete")),
        )),
    )
    one = mission.select("mission_id")
    closed = manifest.filter(F.col("stream").isin(names))
    rows = reconcile(closed.filter("closed").select("segment", "stream", "rows"), (rolled or part_rollup(spark, root, names)).select("segment", "stream", "rows"), ["segment", "stream"])
    rows = rows.filter("manifest_rows is not null").crossJoin(F.broadcast(one))  # one manifest, one row
    counted = rows.select("mission_id", F.lit("dirty").alias("level"), F.concat_ws("/", "segment", "stream", F.lit("rows")).alias("reason"), (~F.col("agrees")).alias("failed"))
    opened = manifest.select("mission_id", F.lit("dirty").alias("level"), F.concat_ws("/", "segment", F.lit("open")).alias("reason"), (~F.col("closed")).alias("failed"))
    writing = streams.in_progress(spark, root).crossJoin(F.broadcast(one)).select("mission_id", F.lit("dirty").alias("level"), F.concat_ws("/", "segment", F.lit("in progress")).alias("reason"), F.lit(True).alias("failed"))
    return verdict(head.unionByName(counted).unionByName(opened).unionByName(writing), ["mission_id"])


def report(spark: SparkSession, root: str, names: list[str], dialect_hash: str, schema_version: int) -> DataFrame:
    """(mission_id, verdict, report): what ``inspect`` finds, with rows, drops, raw captures and open parts of each segment, as a JSON object a mission."""
    manifest, rolled = streams.read_manifest(spark, root), part_rollup(spark, root, names)
    each = F.struct(F.col("stream").alias("name"), "parts", "rows", F.col("first").alias("first_cc_ns"), F.col("last").alias("last_cc_ns"), F.col("gap_total").alias("seq_gap_total"))
    found = rolled.groupBy("segment").agg(F.array_sort(F.collect_list(each)).alias("streams"), F.sum("rows").alias("rows"))  # at most eight streams
    drops = streams.read_operations(spark, root).filter("kind = 'drop'").groupBy("segment").agg(F.sum("count").cast("long").alias("drops"))
    raw = streams.raw_captures(spark, root).select("segment", F.col("frames").alias("raw_frames"), F.col("torn").alias("raw_torn"))
    writing = streams.in_progress(spark, root).select("segment", F.col("parts").alias("inprogress_parts"))
    segments = manifest.select("mission_id", "segment", "cc_boot_id", "px4_boot_id", "closed").distinct()
    for more in (found, drops, raw, writing):
        segments = segments.join(more, "segment", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    segment = F.struct(
        F.col("segment").alias("dir"), "cc_boot_id", "px4_boot_id", "closed", zero("inprogress_parts"), F.col("raw_frames").isNotNull().alias("raw_present"), zero("raw_frames"),
        F.coalesce("raw_torn", F.lit(False)).alias("raw_torn"), zero("drops"), "streams",
    )
    totals = segments.groupBy("mission_id").agg(F.sum("rows").alias("total_rows"), F.coalesce(F.sum("drops"), F.lit(0)).alias("total_drops"), F.array_sort(F.collect_list(segment)).alias("segments"))
    head = manifest.select("vehicle_id", "mission_id", "complete", "dialect_hash", "schema_version").distinct()
    judged = inspect(spark, root, names, dialect_hash, schema_version, rolled).withColumn("issues", F.filter(F.split("reasons", ";"), lambda x: x != ""))
    whole = F.struct(
        F.lit(root).alias("mission_dir"), "verdict", "issues", "mission_id", "vehicle_id", "complete", "dialect_hash", (F.col("dialect_hash") == dialect_hash).alias("dialect_hash_ok"),
        (F.col("schema_version") == schema_version).alias("schema_version_ok"), "total_rows", "total_drops", "segments",
    )
    both = head.join(judged, "mission_id").join(totals, "mission_id")
    return both.select("mission_id", "verdict", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))
