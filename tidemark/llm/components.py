"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and the node itself.

    ``large``: only neighbours above the node move; otherwise those below it do, and the node with them.
    The minimum is pre-aggregated before the shuffle, so a hub costs one partial row a task; the join
    that follows is one that adaptive execution can split.
    """
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = near.join(least, F.col("a") == F.col("n")).filter(F.col("b") > F.col("a") if large else F.col("b") != F.col("m"))
    links = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        links = links.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return links.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node of ``links`` with the smallest node reachable from it.

    Nodes may be of any orderable type. Links with a null end, self-links and repeats count for nothing;
    an empty table gives an empty table. Each round is written to the shared folder, so a lost executor
    costs no more than a round. The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
        if left != "a" or right != "b"
        else links.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = None
    while True:
        wide = stored(_star(edges, True), "large-star")
        after = stored(_star(wide, False), "small-star")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(wide)
        forget(edges)
        edges = after
        if state == tuple(sums):
            break
        state = tuple(sums)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
