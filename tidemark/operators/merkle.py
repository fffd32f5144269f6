"""Trees of hashes over the ordinals of timelines: two timelines are compared from the top, and rows are joined only where ranges differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import timeline_diff
from tidemark.sources.shared import stored

#: Rows of a range, and nodes that one above them sums up.
WIDE = 64


def _digest(columns: list[str]) -> Column:
    """The SHA-256 of a row's values as text, each with whether it is null and how long it is; numbers as the shortest text that tells them apart."""
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *(text(c) for c in columns)), 256)


def tree(timeline: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """(keys, level, node, digest): level 0 has a digest for each WIDE ordinals (node n: those from n * WIDE on), each level above one for WIDE nodes, the top one for all.

    A level is one aggregation without a hot key: it gathers WIDE digests at most. Ordinals count from 0 or 1 and aren't null; an empty timeline has no tree.
    """
    columns = [c for c in timeline.columns if c not in keys]
    part = lambda c: F.floor(F.col(c) / WIDE).cast("long")
    gathered = lambda df: df.withColumn("digest", F.sha2(F.concat_ws("", F.transform(F.array_sort("_all"), lambda x: F.concat(x["o"].cast("string"), F.lit("="), x["d"], F.lit(";")))), 256))
    own = timeline.select(*keys, part(ordinal).alias("node"), F.struct(F.col(ordinal).alias("o"), _digest(columns).alias("d")).alias("_x"))
    levels = []
    while True:
        level = stored(gathered(own.groupBy(*keys, "node").agg(F.collect_list("_x").alias("_all"))).select(*keys, F.lit(len(levels)).alias("level"), "node", "digest"), "tree")
        levels.append(level)
        if (level.agg(F.max("node")).first()[0] or 0) == 0:
            return reduce(DataFrame.unionByName, levels)
        own = level.select(*keys, part("node").alias("node"), F.struct(F.col("node").alias("o"), F.col("digest").alias("d")).alias("_x"))


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): the ranges of level 0 at which two trees differ, found by going down from the top through nodes that differ alone."""
    on = [*keys, "node"]
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    open_ = None
    for level in range(max([t for t in tops if t is not None], default=-1), -1, -1):
        sides = [t.filter(F.col("level") == level).select(*on, F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y"))]
        if open_ is not None:
            above = open_.select(*keys, F.col("node").alias("_above"))
            sides = [s.withColumn("_above", F.floor(F.col("node") / WIDE).cast("long")).join(above, [*keys, "_above"], "left_semi").drop("_above") for s in sides]
        open_ = stored(sides[0].join(sides[1], on, "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*on), "open-nodes")
        if open_.isEmpty():
            break
    return a.select(*on).limit(0) if open_ is None else open_


def tree_diff(a: DataFrame, b: DataFrame, keys: list[str], ordinal: str = "ordinal", first: int = 20) -> DataFrame:
    """The first rows of each key at which two timelines differ, as ``timeline_diff`` gives them. Equal timelines compare by their top nodes, without reading a row again."""
    ranges = differing(tree(a, keys, ordinal), tree(b, keys, ordinal), keys)
    near = [t.withColumn("node", F.floor(F.col(ordinal) / WIDE).cast("long")).join(ranges, [*keys, "node"], "left_semi").drop("node") for t in (a, b)]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    return timeline_diff(*near, keys, ordinal).withColumn("_nth", nth).filter(F.col("_nth") <= first).drop("_nth")
