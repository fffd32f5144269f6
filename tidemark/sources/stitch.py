"""Chains through files that are read in ranges: each range tells where it is left for each place it may be entered; which are entered follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored


def entered(maps: DataFrame) -> DataFrame:
    """maps (path, range, low, high, leaves, into): entries ``low`` to ``high`` of a range, told from its begin, leave it at ``leaves``, told from the begin of
    the range ``into``; null where the chain ends. -> (path, range, low, entry): the maps that the chain from the begin of each file uses.

    By pointer doubling: jumps of one, two, four maps are joined, and the chain's maps are those reached by any sum of them. As many rounds
    as the logarithm of the longest file's number of ranges; no file is walked by one task.
    """
    node = ["path", "range", "low"]
    nodes = maps.select(*node, "high", "leaves", "into")
    to = maps.select(F.col("path").alias("p"), F.col("range").alias("r"), F.col("low").alias("l"), F.col("high").alias("h"))
    hit = (F.col("path") == F.col("p")) & (F.col("into") == F.col("r")) & F.col("leaves").between(F.col("l"), F.col("h"))
    jump = stored(nodes.join(to, hit).select(*node, F.col("r").alias("to_range"), F.col("l").alias("to_low"), F.col("leaves").alias("entry")), "jumps")
    jumps, far = [jump], maps.agg(F.max("range")).first()[0] or 0
    while 2 ** len(jumps) <= far:
        last = jumps[-1]
        next_ = last.select(F.col("path").alias("p"), F.col("range").alias("r"), F.col("low").alias("l"), F.col("to_range").alias("far_range"), F.col("to_low").alias("far_low"), F.col("entry").alias("far_entry"))
        on = (F.col("path") == F.col("p")) & (F.col("to_range") == F.col("r")) & (F.col("to_low") == F.col("l"))
        twice = last.join(next_, on).select(*node, F.col("far_range").alias("to_range"), F.col("far_low").alias("to_low"), F.col("far_entry").alias("entry"))
        jumps.append(stored(twice, "jumps"))
    reached = nodes.filter((F.col("range") == 0) & (F.col("low") == 0)).select(*node, F.lit(0).cast("long").alias("entry"))
    for jump in reversed(jumps):
        more = reached.drop("entry").join(jump, node).select("path", F.col("to_range").alias("range"), F.col("to_low").alias("low"), "entry")
        reached = stored(reached.unionByName(more), "reached")
    return reached
