"""Histograms, quantiles, interpolation and crossover over DataFrames."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, bins: int = 50, density: bool = False) -> DataFrame:
    """(bin, lo, n[, density]) of equal-width bins between minimum and maximum; the last is closed. Empty bins are left out."""
    rows = df.select(value.cast("double").alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    # One row: a broadcast of a fixed size.
    wide = rows.crossJoin(F.broadcast(ends)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("w") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1))).otherwise(F.lit(0))
    out = wide.groupBy(at.cast("int").alias("bin"), "lo", "w", "total").agg(F.count("*").alias("n"))
    columns = ["bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), "n"]
    return out.select(*columns, *([(F.col("n") / (F.col("total") * F.col("w"))).alias("density")] if density else []))


def length_frame(df: DataFrame, text: Column, bins: int = 50) -> DataFrame:
    """histogram() of the lengths of text (null is none), each row with the frame's labels: how many there are, their median, and both as written on a plot."""
    from .seq import reads_label

    # The length is taken once a row, for the bins, their ends and the marks.
    lengths = df.select(once(F.length(text)).alias("x")).where("x is not null")
    marks = lengths.agg(F.median("x").alias("median"), F.count("*").alias("reads"))
    labels = marks.select(
        "median", F.concat(F.lit("N reads = "), reads_label("reads")).alias("reads_label"), F.concat(F.lit("Median = "), F.col("median").cast("bigint").cast("string"), F.lit(" bp")).alias("median_label")
    )
    return histogram(lengths, F.col("x"), bins).crossJoin(F.broadcast(labels))  # one row


def once(value: Column) -> Column:
    """value, computed where it stands: no filter above it is pushed below, which would repeat its expression for every row."""
    return F.when(F.spark_partition_id() >= 0, value)


#: Numbers of an order column that one task of running_total runs over.
CELL = 4096


def running_total(df: DataFrame, value: Column, order: str, keys: list[str] = (), name: str = "upto") -> DataFrame:
    """df with the sum of value over all rows up to each in `order`, an integer column that no two rows of the keys share.

    In two passes: totals of cells of CELL numbers are run over first, then the rows
    of each cell, so no task gets all rows of a key.
    """
    keys = list(keys)
    rows = df.withColumn("_cell", F.floor(F.col(order) / CELL)).withColumn("_v", value)
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_v").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum("_v").over(inside)).join(cells, [*keys, "_cell"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_cell", "_v", "_in", "_before")


#: Rows that a quantile's search ends with, and that one task sorts.
NARROW = 100_000
#: Shares of all rows that ordered passes are cut into.
SHARES = 1000


def floor_quantile(df: DataFrame, value: str, p: float) -> DataFrame:
    """(q): the value at place floor(n * p) of the n sorted values; null, and no place, without values or at p = 1.

    Nulls and NaNs don't count. Approximate quantiles, whose rank error is bounded, give
    two values around the place; the rows between them are counted and searched again,
    until NARROW are left. Each pass keeps about a hundredth and reads df anew. Numbers
    are compared as doubles.
    """
    kind = df.schema[value].dataType
    rows = df.select(F.col(value).alias("x")).where("x is not null and not isnan(cast(x as double))")
    size = rows.count()
    place = math.floor(size * p)
    answer = lambda x: df.sparkSession.range(1).select(F.lit(x).cast(kind).alias("q"))
    if place >= size:
        return answer(None)
    error = 1 / 200
    while size > NARROW:
        low, high = rows.approxQuantile("x", [max(0.0, place / size - error), min(1.0, place / size + error)], error / 2)
        below, at_low, inside, at_high = rows.agg(*(F.count_if(c) for c in (F.col("x") < low, F.col("x") == low, (F.col("x") > low) & (F.col("x") < high), F.col("x") == high))).first()
        if below <= place < below + at_low:
            return answer(low)
        if below + at_low + inside <= place < below + at_low + inside + at_high:
            return answer(high)
        if not below + at_low <= place < below + at_low + inside:
            raise ArithmeticError(f"approximate quantiles {low} and {high} don't hold place {place} of {size}")
        rows, place, size = rows.where((F.col("x") > low) & (F.col("x") < high)), place - below - at_low, inside
    return rows.orderBy("x").offset(place).limit(1).agg(F.min("x").alias("q"))


def _shares(df: DataFrame) -> tuple[DataFrame, bool]:
    """df with `_share`, the number of the share of all rows that its x is in, in the order of x, and whether there are several.

    NARROW rows are one share, so that a small frame is passed over once.

    The shares' borders are approximate quantiles over the rows of every key (SHARES
    numbers), so a key that holds most rows is divided as finely as the whole.
    """
    if df.limit(NARROW + 1).count() <= NARROW:
        return df.withColumn("_share", F.lit(0.0)), False
    rows = df.withColumn("_x", F.col("x").cast("double"))
    cuts = sorted(set(rows.approxQuantile("_x", [i / SHARES for i in range(1, SHARES)], 1 / (2 * SHARES))))
    if not cuts:
        return df.withColumn("_share", F.lit(0.0)), False
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_share", handleInvalid="keep").transform(rows).drop("_x"), True


def first_reaching(curve: DataFrame, x: float) -> DataFrame:
    """The first point of (x, y) at or beyond x (left insertion); no row where the curve ends before."""
    return curve.where(F.col("x") >= x).agg(F.min_by(F.struct("x", "y"), "x").alias("p")).where("p is not null").select("p.*")


def interpolate(points: DataFrame, curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """points (keys, x) with y linear between curve's (keys, x, y), constant beyond its ends and null without a curve.

    One sorted sweep, no range join, over shares of the rows: each is handed the last
    point of the curve before it and the first one after it, so no task sorts all rows
    of a key.
    """
    keys = list(keys)
    both, several = _shares(curve.select(*keys, "x", "y", F.lit(0).alias("asks")).unionByName(points.select(*keys, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("asks"))))
    point, at = F.struct("x", "y"), F.when(F.col("asks") == 0, F.col("x"))
    ends = both.groupBy(*keys, "_share").agg(F.min_by(point, at).alias("first"), F.max_by(point, at).alias("last"))
    # A row a key and share: at most SHARES + 1 of a key.
    shares = Window.partitionBy(*keys).orderBy("_share")
    around = [F.last("last", True).over(shares.rowsBetween(Window.unboundedPreceding, -1)), F.first("first", True).over(shares.rowsBetween(1, Window.unboundedFollowing))]
    handed = ends.withColumn("_around", F.array(*around)).select(*keys, "_share", F.explode("_around").alias("p")).where("p is not null").select(*keys, "p.x", "p.y", F.lit(0).alias("asks"), "_share")
    known = F.when(F.col("asks") == 0, point)
    inside, so_far = Window.partitionBy(*keys, "_share"), (Window.unboundedPreceding, 0)
    left = F.last(known, True).over(inside.orderBy("x", "asks").rowsBetween(*so_far))
    right = F.last(known, True).over(inside.orderBy(F.desc("x"), F.desc("asks")).rowsBetween(*so_far))
    found = (both.unionByName(handed) if several else both).withColumn("l", left).withColumn("r", right).where("asks = 1")
    y = F.when(F.col("l").isNull(), F.col("r.y")).when(F.col("r").isNull(), F.col("l.y")).otherwise(
        F.col("l.y") + (F.col("x") - F.col("l.x")) * (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
    )
    return found.select(*keys, "x", F.when(F.col("l.x") == F.col("x"), F.col("l.y")).otherwise(y).alias("y"))


def crossover(diff: DataFrame, keys: list[str] = ()) -> DataFrame:
    """First x at which d of (keys, x, d) changes sign, by the line through the points around it.

    In shares of the rows; each also gets the first row of the key's next share.
    """
    keys = list(keys)
    rows, several = _shares(diff.select(*keys, "x", "d"))
    heads = rows.groupBy(*keys, "_share").agg(F.min_by(F.struct("x", "d"), "x").alias("p"))
    before = F.lag("_share").over(Window.partitionBy(*keys).orderBy("_share"))  # SHARES + 1 rows of a key at most
    heads = heads.select(*keys, "p.x", "p.d", before.alias("_share")).where("_share is not null")
    order = Window.partitionBy(*keys, "_share").orderBy("x")
    pairs = (rows.unionByName(heads) if several else rows).withColumn("x1", F.lead("x").over(order)).withColumn("d1", F.lead("d").over(order)).where("x1 is not null and signum(d) <> signum(d1)")
    root = F.col("x") - F.col("d") * (F.col("x1") - F.col("x")) / (F.col("d1") - F.col("d"))
    return pairs.groupBy(*keys).agg(F.min_by(root, F.col("x")).alias("crossover"))
