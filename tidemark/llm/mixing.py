"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, stored, table, word_count

#: A source is repeated this many times at most.
MOST_COPIES = 3


def source_targets(per_source: DataFrame) -> DataFrame:
    """(source, rows, source_size) -> the same with ``target``.

    Sources in code point order, null last, weigh 1, 2, 3 and again. Their targets share the sum of all sizes
    by weight, but none exceeds ``MOST_COPIES`` times its source's size; what is over is shared again
    among the others. That is one water level: with the sources sorted by cap over weight, those below the
    level are full, and the level is what is left over the weights that are left.

    One row a source: the two windows without a key sort source names, not documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.withColumn("weight", (F.row_number().over(everything) - 1) % 3 + 1)
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST_COPIES)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onwards)
    levels = weighed.withColumn("level", level.cast("double")).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(open_level * F.col("weight"))
    return levels.select("source", "rows", "source_size", target.alias("target"))


def _draw(text: Column) -> Column:
    """A number in [0, 1), a multiple of 2^-16, from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken: one row a document.

    Size: the number of words of the text (null or empty: 0). Each document of a source expects
    target / source_size copies. Systematic sampling adds these up along the source, sorted by size, starts at
    one random offset a source (from ``seed``), and takes a document once for each integer boundary it crosses:
    every document gets the expected number rounded down or up, and sorting by size keeps the words
    taken near the target. Sources of size zero take nothing.

    A position along a source is a row number. It is counted in cells of a source (by size class and hash), about as
    many as the square root of its rows, and the counts of the cells before are added: no window
    holds a whole source. Null sources form one source; null and repeated doc_ids count as any row (equal rows may
    swap their copies); an empty table gives an empty one.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    targets = source_targets(per_source).withColumnRenamed("source", "s")
    cells = F.ceil(F.sqrt("rows") / 8).cast("long")
    placed = (
        sizes.join(targets, sizes["source"].eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("class", F.floor(F.log2(F.col("size") + 1) * 2))
        .withColumn("cell", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % cells)
    )
    counts = placed.groupBy("source", "class", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("s"), F.col("class").alias("k"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("source", "class", "cell").orderBy("size", "doc_id")
    rate = F.col("target") / F.col("source_size")
    offset = _draw(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    crossed = F.floor(offset + rate * F.col("at")) - F.floor(offset + rate * (F.col("at") - 1))
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")) & (F.col("cell") == F.col("c")))
        .withColumn("at", F.col("start") + F.col("nth"))
        .withColumn("copies", F.when(F.col("source_size") > 0, crossed).otherwise(0).cast("long"))
        .select("doc_id", "source", "size", "source_size", F.col("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with all its columns, each row repeated as often as ``mix`` takes it, or left out where that is never.

    Rows that share a doc_id (or have none) all take the most copies among them.
    """
    own, n, nth = (free_name(docs.columns, x) for x in ("taken_id", "copies", "copy"))
    copies = mix(docs, seed).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(own)))
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per_source
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed
), targets AS (
  SELECT source, n_rows, source_size, CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE)
    ELSE (SELECT max(level) FROM levels WHERE cap / weight > level) * weight END AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(log2(s.size + 1) * 2) AS class,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % CAST(ceil(sqrt(n_rows) / 8) AS BIGINT) AS cell
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, cell, size, doc_id NULLS FIRST) AS pos,
    CAST(CAST('0x' || substr(md5('0:' || coalesce('s' || source, '')), 1, 4) AS BIGINT) AS DOUBLE) / 65536 AS u, target / source_size AS r FROM placed
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(u + r * pos) - floor(u + r * (pos - 1)) AS BIGINT) * size ELSE 0 END AS taken
FROM ranked
"""
