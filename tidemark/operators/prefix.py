"""Recursions that compose, without Python and with one long key spread over many tasks.

Rows of a key are numbered block by block (a block is what ``block`` tells, such as an hour: rows of one block are sorted together, blocks
aren't). Linear recursions are then sums over stretches of the numbering, each carried into the next; recursions over a few states are maps of states
that are composed up a tree and applied down again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: A stretch is as long as a weight takes to fall to this: what is two stretches back has a weight below its square, nothing beside a double's 16 digits.
LEAST_WEIGHT = 1e-140
#: Rows that one node of the tree of maps composes.
WIDE = 64
#: Rows of a key's table that one task sorts for a join, whatever the size of the table.
ROWS = 1 << 19


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column | None, counts: Column, name: str) -> DataFrame:
    """Adds ``_block`` and ``name``: how many rows of the key up to and with this one ``counts`` holds for.

    Only one row a block is gathered for each key. How many rows come before a block is one more row of it, before its others, so that rows meet it in the shuffle that
    orders them and a null in a key is a key like any other.
    """
    df = df.withColumn("_block", F.lit(0) if block is None else block).withColumn(name, F.when(counts, 1).otherwise(0))
    sizes = df.groupBy(*keys, "_block").agg(F.sum(name).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_block", before.alias(name)).filter(F.col(name) > 0)
    both = df.withColumn("_row", F.lit(True)).unionByName(offsets.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_block").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum(name).over(within)).filter("_row").drop("_row")


def decayed(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], keep: float, counts: Column, block: Column | None = None, number: str = "_n") -> DataFrame:
    """Adds for each name the sum of a value over the key's rows so far, each weighted by ``keep`` to the power of the rows since; and ``number``, those rows' count.

    Rows that ``counts`` doesn't hold for add nothing and age nothing. ``keep`` is between 0 and 1, both excluded.
    """
    long = max(1, int(math.log(LEAST_WEIGHT) / math.log(keep)))
    found = numbered(df, keys, order, block, counts, number)
    at = F.greatest(F.col(number) - 1, F.lit(0))
    found = found.withColumn("_stretch", F.floor(at / long).cast("long")).withColumn("_place", (at % long).cast("double"))
    w = Window.partitionBy(*keys, "_stretch").orderBy("_block", *order).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(keep), F.col("_place"))
    found = found.withColumns({v: F.coalesce(F.sum(F.when(counts, x / weight)).over(w), F.lit(0.0)) * weight for v, x in values.items()})
    found = stored(found, "stretches")
    ends = found.groupBy(*keys, "_stretch").agg(F.max("_place").alias("_end"), F.max_by(F.struct(*values), F.struct("_block", *order)).alias("_sums"))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_stretch") + 1).alias("_s"), "_sums")
    on = F.col("_stretch") == F.col("_s")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    carried = F.pow(F.lit(keep), F.col("_place") + 1)
    whole = found.join(ends, on, "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"_sums.{v}") * carried, F.lit(0.0)) for v in values})
    return whole.drop("_s", "_sums", "_stretch", "_place", "_block", *(f"_k{i}" for i in range(len(keys))))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, block: Column | None = None, mean: str = "ewma", var: str = "ewma_var") -> DataFrame:
    """Adds the exponentially weighted mean and variance after each row: the first value seeds the mean, missing ones change nothing.

    The variance is the weighted mean of squares less the square of the weighted mean, both of differences from the key's first value, with which
    both begin at zero.
    """
    x = F.col(value).cast("double")
    valid = x.isNotNull() & ~F.isnan(x)
    firsts = df.filter(valid).groupBy(*keys).agg(F.min_by(x, F.struct(*order)).alias("_first"))
    firsts = firsts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    seen = df.join(firsts, on, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    d = x - F.col("_first")
    found = decayed(seen, keys, order, {"_mean": d * alpha, "_square": d * d * alpha}, 1 - alpha, valid, block)
    spread = F.greatest(F.col("_square") - F.col("_mean") * F.col("_mean"), F.lit(0.0))
    return found.withColumns({mean: F.when(F.col("_n") > 0, F.col("_first") + F.col("_mean")), var: F.when(F.col("_n") > 0, spread).otherwise(0.0)}).drop("_first", "_mean", "_square", "_n")


def link_quality(df: DataFrame, keys: list[str], order: list[str], gap: str, interval: str, nominal: int, alpha: float, block: Column | None = None) -> DataFrame:
    """``df`` with lost_share, rate and jitter after each row, as ``scans.link_quality`` gives them."""
    df = ewma(df, keys, order, gap, alpha, block, "_gap", "_unused")
    df = ewma(df, keys, order, interval, alpha, block, "_interval", "_var")
    g = F.greatest("_gap", F.lit(0.0))
    rate = F.when(F.col("_interval") > 0, nominal / F.col("_interval"))
    return df.withColumns({"lost_share": g / (1 + g), "rate": rate, "jitter": F.sqrt("_var") / nominal}).drop("_gap", "_unused", "_interval", "_var")


def least_squares(df: DataFrame, keys: list[str], order: list[str], u: str, y: str, forget: float = 0.999, start: float = 100.0, block: Column | None = None) -> DataFrame:
    """Adds residual, theta0, theta1, theta2: least squares on [1, u, u * u] with forgetting, in information form.

    The decayed sums of the products of what is fitted, and 1 / ``start`` on the diagonal as it decays, are a 3 x 3 system a row, solved by its minors. The
    residual is that before the row; rows without u or y have none and change nothing. Agrees with the recursion (``scans.rls``) up to rounding.
    """
    a, b = F.col(u).cast("double"), F.col(y).cast("double")
    valid = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    sums = {f"_s{p}": F.pow(a, F.lit(p)) for p in range(5)} | {f"_t{p}": b * F.pow(a, F.lit(p)) for p in range(3)}
    found = decayed(df, keys, order, sums, forget, valid, block)
    begun = F.pow(F.lit(forget), F.col("_n")) / start
    m = [[F.col(f"_s{i + j}") + (begun if i == j else 0) for j in range(3)] for i in range(3)]
    t = [F.col(f"_t{i}") for i in range(3)]
    minor = lambda r, c: [[m[i][j] for j in range(3) if j != c] for i in range(3) if i != r]
    cofactor = [[(lambda x: (x[0][0] * x[1][1] - x[0][1] * x[1][0]) * (-1 if (r + c) % 2 else 1))(minor(r, c)) for c in range(3)] for r in range(3)]
    determinant = sum((m[0][c] * cofactor[0][c] for c in range(1, 3)), m[0][0] * cofactor[0][0])
    theta = {f"theta{i}": sum((cofactor[j][i] * t[j] for j in range(1, 3)), cofactor[0][i] * t[0]) / F.col("_det") for i in range(3)}
    found = found.withColumn("_det", determinant).withColumns(theta)
    before = Window.partitionBy(*keys, "_part").orderBy(*order)
    # What holds before a row is what held after the one before it in the numbering: rows of two parts overlap by one, so that each part has it.
    found = found.withColumn("_part", F.floor(F.col("_n") / 4096).cast("long")).drop("_det", *sums)
    last = found.filter(valid & (F.col("_n") % 4096 == 4095)).withColumn("_part", F.col("_part") + 1).withColumn("_last", F.lit(True))
    both = found.withColumn("_last", F.lit(False)).unionByName(last)
    step = {f"_p{i}": F.last(F.when(valid, F.col(f"theta{i}")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)) for i in range(3)}
    both = both.withColumns(step).filter(~F.col("_last"))
    guess = sum((F.coalesce(F.col(f"_p{i}"), F.lit(0.0)) * F.pow(a, F.lit(i)) for i in range(1, 3)), F.coalesce("_p0", F.lit(0.0)))
    return both.withColumn("residual", F.when(valid, b - guess)).drop("_n", "_part", "_last", "_p0", "_p1", "_p2")


def _merged(a: DataFrame, b: DataFrame, on: list[str], parts: int) -> DataFrame:
    """a, which is in so many parts by ``on`` already, and b joined by sorting. The files of stored numbers are small enough to be broadcast where their rows aren't."""
    return a.join(b.repartition(parts, *on).hint("merge"), on)


def states(df: DataFrame, keys: list[str], order: list[str], step: Column, size: int, name: str, start: int = 0, block: Column | None = None) -> DataFrame:
    """Adds the state after each row of an automaton of ``size`` states: ``step`` is the row's map, an array with the next state of each.

    Maps of WIDE neighbours are composed to one, level by level, until each key has one; then each node hands its members the states they are entered
    with. Rows meet only the state that their node is entered with, and go on from there by the maps of the node's rows so far; maps are made of a row's columns
    where they are needed. No task holds more than WIDE rows of a key at once, and a task of a join sorts ROWS rows or so.
    """
    node, on = F.floor(F.col("_i") / WIDE).cast("long").alias("_g"), [*keys, "_g"]
    rows = stored(numbered(df, keys, order, block, F.lit(True), "_i").drop("_block").withColumn("_i", F.col("_i") - 1), "rows")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    rows = rows.select("*", node).repartition(parts, *on)
    levels, members = [], rows.select(*on, "_i", step.alias("_m"))
    while True:
        listed = F.array_sort(F.collect_list(F.struct("_i", "_m")))
        composed = F.aggregate("_all", F.array(*(F.lit(s) for s in range(size))), lambda held, x: F.transform(held, lambda s: F.get(x["_m"], s)))
        groups = members.groupBy(*on).agg(listed.alias("_all")).withColumn("_whole", composed)
        groups = stored(groups if levels else groups.drop("_all"), "maps")
        levels.append(groups)
        if (groups.agg(F.max("_g")).first()[0] or 0) == 0:
            break
        members = groups.select(*keys, F.col("_g").alias("_i"), F.col("_whole").alias("_m")).select("*", node)
    entered = levels[-1].withColumn("_s", F.lit(start)).drop("_whole")
    for depth in reversed(range(1, len(levels))):
        walk = F.aggregate(
            "_all", F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<i: bigint, s: int>>").alias("out")),
            lambda held, x: F.struct(F.get(x["_m"], held["s"]).alias("s"), F.array_append(held["out"], F.struct(x["_i"].alias("i"), held["s"].alias("s"))).alias("out")),
        )["out"]
        inner = entered.select(*keys, F.explode(walk).alias("_x")).select(*keys, F.col("_x.i").alias("_g"), F.col("_x.s").alias("_s"))
        entered = stored(inner, "entered") if depth == 1 else _merged(inner.repartition(parts, *on), levels[depth - 1].drop("_whole"), on, parts)
    so_far = Window.partitionBy(*on).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_maps", F.collect_list(F.struct(step.alias("m"))).over(so_far))
    after = F.aggregate("_maps", F.col("_s"), lambda s, x: F.get(x["m"], s))
    return _merged(rows, entered, on, parts).withColumn(name, after).drop("_i", "_g", "_maps", "_s")


def shedding(df: DataFrame, keys: list[str], order: list[str], free: str, low: tuple[int, ...], resume: tuple[int, ...], block: Column | None = None) -> DataFrame:
    """Adds stage, the shedding ladder of ``scans.shedding``: it rises at once, even over stages, and falls a stage a row at its resume mark."""
    worst = F.coalesce(*(F.when(F.col(free) < low[i], i + 1) for i in reversed(range(len(low)))), F.lit(0))
    step = [F.when(worst > s, worst).when(F.col(free) >= resume[s - 1], s - 1).otherwise(s) if s else worst for s in range(len(low) + 1)]
    return states(df, keys, order, F.array(*step), len(step), "stage", 0, block)
