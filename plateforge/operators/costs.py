"""Closed-form cost models as Column expressions over a grid. All money is DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import crossover, interpolate

# Pooled-library prices in USD; rows are member ranges, columns lengths in bases.
TIER_LENGTHS = (120, 150, 200, 250, 300)
TIERS = {
    (2, 100): (400.0, 466.0, 520.0, 689.0, 1030.0),
    (101, 500): (800.0, 933.0, 1040.0, 1379.0, 2060.0),
    (501, 1000): (1200.0, 1400.0, 1560.0, 2068.0, 3090.0),
    (1001, 2000): (1600.0, 1867.0, 2080.0, 2757.0, 4121.0),
    (2001, 6000): (2400.0, 2800.0, 3120.0, 4136.0, 6181.0),
    (6001, 12000): (3120.0, 3744.0, 4056.0, 5148.0, 7694.0),
    (12001, 18000): (4056.0, 4867.0, 5273.0, 6694.0, 10004.0),
}
ASSEMBLY = {"hifi": 2680.0 / 250, "goldengate": 474.0 / 100}


def _d(name: Column | str) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("double")


def eblocks_synthesis(length="length", n="n") -> Column:
    return F.when((_d(length) > 300) & (_d(length) <= 500), 35.0 * _d(n)).otherwise(_d(length) * _d(n) * 0.07)


def gblocks_synthesis(length="length", n="n") -> Column:
    return _d(length) * _d(n) * 0.09


def gene_fragments_synthesis(length="length", n="n") -> Column:
    """Null below 300 bases, where the product doesn't exist."""
    return F.when(_d(length) < 300, F.lit(None).cast("double")).when(_d(length) <= 500, 35.0 * _d(n)).otherwise(_d(length) * _d(n) * 0.07)


def fragment_assembly(n="n", method: str = "hifi") -> Column:
    if method not in ASSEMBLY:
        raise ValueError(f"unknown assembly method {method!r}; known: {', '.join(ASSEMBLY)}")
    return ASSEMBLY[method] * _d(n) + 165.0 / (6 * 200) * 10 * _d(n)


def fragment_barcoding(n="n") -> Column:
    return _d(n) / 384 * 97.73


def fragment_sequencing(length="length", n="n") -> Column:
    return F.when(_d(n) * 100 * (_d(length) + 100) / 1e9 > 1, 550.0).otherwise(500.0)


def pooled_synthesis(n="n", length="length", discount: bool = True) -> Column:
    """Tier price of the nearest listed length (ties to the shorter) up to 350 bases, else a price per base."""
    price = F.lit(0.0)
    # Between two listed lengths the nearest changes past the middle.
    middles = [(a + b) / 2 for a, b in zip(TIER_LENGTHS, TIER_LENGTHS[1:], strict=False)]
    for (lo, hi), row in TIERS.items():
        by_length = F.lit(row[-1])
        for middle, usd in reversed(list(zip(middles, row, strict=False))):
            by_length = F.when(_d(length) <= middle, usd).otherwise(by_length)
        price = F.when(_d(n).between(lo, hi), by_length * (2 / 3) if discount else by_length).otherwise(price)
    bases = _d(length) * _d(n)
    large = F.when(_d(length) <= 549, 0.002 * bases).when(_d(length).between(550, 2050), 0.004 * bases).otherwise(0.0)
    long = F.when(_d(n) < 3000, 0.015 * bases).when((_d(n) > 3000) & (_d(n) < 30000), large).otherwise(0.0)
    return F.when(_d(length) <= 350, price).otherwise(long)


def pooled_cloning() -> Column:
    return F.lit(2680.0 / 250 * 5)


def _plates(n) -> Column:
    return F.floor(8 * _d(n) / 384)


def pooled_sorting(n="n") -> Column:
    return (30 * _plates(n) + 60) / 60.0 * (70.0 + 65.0)


def pooled_barcoding(n="n") -> Column:
    return _plates(n) * 97.73


def pooled_sequencing(n="n", length="length") -> Column:
    return F.when(8 * _d(n) * 100 * (_d(length) + 100) / 1e9 > 1, 550.0).otherwise(500.0)


def pooled_hitpicking(n="n") -> Column:
    return 0.128 * _d(n) + F.ceil(_d(n) / 384) * 7.84


def pooled_total(n="n", length="length") -> Column:
    total = pooled_synthesis(n, length) + pooled_cloning() + pooled_sorting(n) + pooled_barcoding(n) + pooled_sequencing(n, length) + pooled_hitpicking(n)
    return total.cast("bigint")  # truncates


def grid(spark: SparkSession, lengths: list[int], sizes: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lengths], "length int").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in sizes], "n int")))


def commercial_costs(points: DataFrame, method: str = "hifi") -> DataFrame:
    """(length, n, provider, product, cost): every component is truncated before the sum."""
    whole = lambda c: c.cast("bigint")
    shared = whole(fragment_assembly("n", method)) + whole(fragment_barcoding()) + whole(fragment_sequencing())
    products = [("Twist", "Gene Fragments", gene_fragments_synthesis()), ("IDT", "eBlocks", eblocks_synthesis()), ("IDT", "gBlocks", gblocks_synthesis())]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(q).alias("product"), (whole(c) + shared).alias("cost")) for p, q, c in products)))
    return points.select("length", "n", each.alias("x")).select("length", "n", "x.*")


def cost_stats(costs: DataFrame) -> DataFrame:
    return costs.groupBy("length", "n").agg(F.min("cost").alias("min_cost"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("max_cost"), F.count("cost").alias("n_products"))


def cost_crossover(stats: DataFrame, own: DataFrame) -> DataFrame:
    """Per length, the size at which the own cost curve meets the mean commercial one; null where it never does."""
    mean = interpolate(own.select("length", F.col("n").cast("double").alias("x")), stats.select("length", F.col("n").cast("double").alias("x"), F.col("mean_cost").alias("y")), ["length"])
    diff = mean.join(own.select("length", F.col("n").cast("double").alias("x"), "cost"), ["length", "x"]).select("length", "x", (F.col("y") - F.col("cost")).alias("d"))
    return own.select("length").distinct().join(crossover(diff, ["length"]), "length", "left")


def fold_savings(stats: DataFrame, own: DataFrame, size: int = 1000) -> DataFrame:
    """Mean commercial over own cost at size, where both grids have it."""
    return stats.where(F.col("n") == size).join(own.where(F.col("n") == size).select("length", "cost"), "length").select("length", (F.col("mean_cost") / F.col("cost")).alias("fold"))


def cost_zoom(stats: DataFrame, own: DataFrame) -> DataFrame:
    """(length, curve, x, y, crossover_x, crossover_y, x_lo, x_hi, y_hi): the points of both cost curves in the window around their crossover.

    The window is 50 members to each side (zero at least) and half as high again as the
    own cost at the crossover; sizes 0 to 200 and costs up to 5000 where the curves
    never meet. A length without points in its window has one row with a null curve.
    """
    line = own.select("length", F.col("n").cast("double").alias("x"), F.col("cost").cast("double").alias("y"))
    meets = cost_crossover(stats, own)
    height = interpolate(meets.where("crossover is not null").select("length", F.col("crossover").alias("x")), line, ["length"]).select("length", F.col("y").alias("crossover_y"))
    x = F.col("crossover_x")
    windows = meets.withColumnRenamed("crossover", "crossover_x").join(height, "length", "left").select(
        "length", "crossover_x", "crossover_y", F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), x - 50)).alias("x_lo"), F.when(x.isNull(), 200.0).otherwise(x + 50).alias("x_hi"), F.when(x.isNull(), 5000.0).otherwise(F.col("crossover_y") * 1.5).alias("y_hi")
    )
    curves = stats.select("length", F.lit("commercial").alias("curve"), F.col("n").cast("double").alias("x"), F.col("mean_cost").alias("y")).unionByName(line.withColumn("curve", F.lit("own")))
    near = windows.join(curves, "length").where("x between x_lo and x_hi and y between 0 and y_hi").select("length", "curve", "x", "y")
    return windows.join(near, "length", "left").select("length", "curve", "x", "y", "crossover_x", "crossover_y", "x_lo", "x_hi", "y_hi")
