"""Sampling-funnel and recovery simulations.

Two engines give the same distributions: `hash` draws md5 uniforms and joins
them to cumulative intervals (any SQL engine can repeat it), `kernel` draws
multinomials in Arrow batches, seeded by (seed, simulation), so that results
never depend on the partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.stats import first_reaching, running_total

Z90 = 1.2815515655446004


def uniform(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) of 52 bits from the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def normal(*parts: Column | str) -> Column:
    """Box-Muller on two hash uniforms; the first is kept off zero."""
    u = F.greatest(uniform(*parts, F.lit("a")), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*parts, F.lit("b")))


def sigma_of(skew: float) -> float:
    """Width of the lognormal whose 90 % to 10 % quantile ratio is skew."""
    return math.log(skew) / (2 * Z90)


def lognormal_pool(spark: SparkSession, size: int, skew: float, seed: int = 0) -> DataFrame:
    """(variant, weight) summing to one."""
    s = sigma_of(skew)
    raw = spark.range(size).select(F.col("id").alias("variant"), F.exp(-s * s / 2 + s * normal(F.lit(seed), "id")).alias("w"))
    total = raw.agg(F.sum("w").alias("t"))
    return raw.crossJoin(F.broadcast(total)).select("variant", (F.col("w") / F.col("t")).alias("weight"))  # one row


def intervals(pool: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Half-open intervals [lo, hi) of each variant on the unit line; the last reaches beyond one, against rounding."""
    keys = list(keys)
    whole = pool.groupBy(*keys).agg(F.sum("weight").alias("t"), F.max("variant").alias("last"))
    rows = running_total(pool.select(*keys, "variant", "weight"), F.col("weight"), "variant", keys)
    rows = rows.join(whole, keys) if keys else rows.crossJoin(F.broadcast(whole))  # one row
    return rows.select(*keys, "variant", ((F.col("upto") - F.col("weight")) / F.col("t")).alias("lo"), F.when(F.col("variant") == F.col("last"), 2.0).otherwise(F.col("upto") / F.col("t")).alias("hi"))


def draw(draws: DataFrame, pool: DataFrame, keys: list[str] = (), cells: int | None = None) -> DataFrame:
    """draws (keys, u, ...) with the variant whose interval holds u: an equi-join on cells of the unit line, then the residual.

    There are as many cells as the largest pool has variants (256 at least). Intervals
    then have two rows a cell in all, and a cell gets its even share of the draws, so
    what is joined grows with draws + pool, however unequal the weights.
    """
    if cells is None:
        cells = max(256, pool.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
    cuts = intervals(pool, keys)
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    cuts = cuts.select(*keys, "variant", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    rows = draws.withColumn("cell", cell(F.col("u")))
    return rows.join(cuts, [*keys, "cell"]).where("u >= lo and u < hi").drop("cell", "lo", "hi")


def sample_counts(pool: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(variant, n) of `size` weighted draws with replacement, by the hash engine."""
    draws = pool.sparkSession.range(size).select(uniform(F.lit(seed), "id").alias("u"))
    return draw(draws, pool).groupBy("variant").agg(F.count("*").alias("n"))


def funnel(spark: SparkSession, n_sims: int = 10_000, lib_size: int = 1000, skew: float = 4, p_incorrect: float = 0.3, scale: float = 50, fold: float = 10, p_grow: float = 0.9, p_fail: float = 0.03, seed: int = 0, semantics: str = "coded", counts: bool = False) -> DataFrame:
    """(sim, unique) correct variants recovered, or with counts (sim, variant, is_correct, n), by the kernel engine.

    semantics: "coded" sorts fold wells per clone counted, "documented" per library member.
    """
    if semantics not in ("coded", "documented"):
        raise ValueError("semantics is coded or documented")
    sigma = sigma_of(skew) if skew > 1 else 0.0

    def one(sim: int) -> np.ndarray:
        rng = np.random.default_rng([seed, sim])
        pool = np.exp(-sigma * sigma / 2 + sigma * rng.standard_normal(lib_size))
        p = np.append(pool / pool.sum() * (1 - p_incorrect), p_incorrect)
        clones = rng.multinomial(int(lib_size * scale), p / p.sum())
        base = clones.sum() - 1 if semantics == "coded" else lib_size
        wells = rng.multinomial(int(p_grow * fold * base), clones / max(1, clones.sum())) if clones.sum() else clones * 0
        lost = rng.multinomial(int(wells.sum() * p_fail), wells / wells.sum()) if wells.sum() else wells
        return wells - lost

    def run(batches):
        for batch in batches:
            sims = batch.column(0).to_numpy()
            found = [one(int(s)) for s in sims]
            if counts:
                n = lib_size + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sims, n)), pa.array(np.tile(np.arange(n), len(sims))), pa.array(np.tile(np.arange(n) < lib_size, len(sims))), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["sim", "variant", "is_correct", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(sims), pa.array(np.array([(f[:-1] > 0).sum() for f in found], np.int64))], names=["sim", "unique"])

    sims = spark.range(0, n_sims, 1, max(1, min(n_sims, spark.sparkContext.defaultParallelism * 4))).withColumnRenamed("id", "sim")
    return sims.mapInArrow(run, "sim long, variant long, is_correct boolean, n long" if counts else "sim long, unique long")


def coverage_sweep(spark: SparkSession, folds: list[float] | None = None, lib_size: int = 328, n_sims: int = 100, skew: float = 4, scale: float = 30, p_incorrect: float = 0.1, p_grow: float = 0.67, p_fail: float = 0.03, **options) -> DataFrame:
    """Unique variants by fold and simulation, with a zero baseline for each simulation; folds are 25 from 1 to 5000 wells by default."""
    if folds is None:
        folds = [(1 + 4999 * i / 24) / lib_size for i in range(25)]
    rates = {"skew": skew, "scale": scale, "p_incorrect": p_incorrect, "p_grow": p_grow, "p_fail": p_fail}
    options = rates | options
    parts = [funnel(spark, n_sims, lib_size, fold=f, **options).withColumn("fold", F.lit(float(f))) for f in folds]
    if not parts:
        return spark.createDataFrame([], "sim long, fold double, unique long, coverage double, wells long, transformants long, skew double, p_incorrect double, p_grow double, p_fail double")
    rows = spark.range(n_sims).select(F.col("id").alias("sim"), F.lit(0.0).alias("fold"), F.lit(0).cast("long").alias("unique"))
    for p in parts:
        rows = rows.unionByName(p)
    constants = [F.lit(int(lib_size * scale)).cast("long").alias("transformants"), *(F.lit(float(v)).alias(k) for k, v in rates.items() if k != "scale")]
    return rows.select("sim", "fold", "unique", (F.col("unique") / lib_size).alias("coverage"), (F.col("fold") * lib_size).cast("long").alias("wells"), *constants)


def recovery_curve(draws: DataFrame, library: int) -> DataFrame:
    """(x, y) mean share of the library seen after x draws of (rep, k, variant), k from 1.

    First sights are a grouped minimum; the running count is one over draw numbers, in cells of them.
    """
    first = draws.groupBy("rep", "variant").agg(F.min("k").alias("k"))
    reps = draws.agg(F.countDistinct("rep").alias("reps"))
    new = draws.groupBy("k").agg(F.lit(0).cast("long").alias("z")).join(first.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    seen = running_total(new, F.coalesce("n", F.lit(0)), "k", name="seen")
    return seen.crossJoin(F.broadcast(reps)).select(F.col("k").cast("long").alias("x"), (F.col("seen") / F.col("reps") / library).alias("y"))


def recovery_with_resynthesis(pool: DataFrame, t1: int | None, t2: int | None = None, resynthesis: bool = False, n_reps: int = 100, seed: int = 0) -> DataFrame:
    """Recovery over t1 weighted draws, then t2 more: uniform over what each replicate has not seen, or weighted again."""
    if t1 is None:
        raise ValueError("t1 is needed")
    t2 = t2 or 0
    if t1 < 0 or t2 < 0:
        raise ValueError("t1 and t2 can't be negative")
    if resynthesis and not t2:
        raise ValueError("resynthesis needs t2 above zero")
    spark = pool.sparkSession
    if t1 + t2 == 0:
        return spark.createDataFrame([], "x long, y double")
    library = pool.count()
    reps = spark.range(n_reps).withColumnRenamed("id", "rep")
    # Draw numbers stay distributed; each is repeated for the replicates, of which there are n_reps rows.
    steps = lambda lo, hi: spark.range(lo, hi).withColumnRenamed("id", "k").crossJoin(F.broadcast(reps)).withColumn("u", uniform(F.lit(seed), "rep", "k"))
    first = draw(steps(1, t1 + 1 if resynthesis else t1 + t2 + 1), pool).select("rep", "k", "variant")
    met = first.where("variant is not null").groupBy("rep", "variant").agg(F.min("k").alias("k"))
    if resynthesis:
        met = storage.keep(met)
        # The pool may be of any size: each of its rows is repeated for the replicates, and the seen go by an equi-join.
        # Spark takes what it repeats for as small as the pool, so the joins with as many rows as pool x n_reps say that they are no broadcasts.
        pairs = pool.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_reps - 1).cast("long"))).alias("rep"), "variant")
        unseen = storage.keep(pairs.join(met.select("rep", "variant").hint("merge"), ["rep", "variant"], "left_anti"))
        ranked = running_total(unseen, F.lit(1).cast("long"), "variant", ["rep"]).select("rep", "variant", (F.col("upto") - 1).alias("r"))
        left = unseen.groupBy("rep").agg(F.count("*").alias("m"))
        second = steps(t1 + 1, t1 + t2 + 1).join(left, "rep").withColumn("r", F.floor(F.col("u") * F.col("m"))).join(ranked.hint("merge"), ["rep", "r"])
        # A replicate that has seen all draws no more; the others meet nothing in these draws that they have seen before.
        met = met.unionByName(second.groupBy("rep", "variant").agg(F.min("k").alias("k")))
    # Every draw number has a row, so that the curve has a point where no replicate draws any more.
    steps_only = spark.range(1, t1 + t2 + 1).withColumnRenamed("id", "k")
    seen = met.groupBy("k").agg(F.count("*").alias("n"))
    rows = steps_only.join(seen, "k", "left")
    return running_total(rows, F.coalesce("n", F.lit(0)), "k", name="seen").select(F.col("k").alias("x"), (F.col("seen") / n_reps / library).alias("y"))


def recovery_comparison(pool: DataFrame, t1: int, t2: int, n_reps: int = 100, seed: int = 0, simple: bool = True) -> DataFrame:
    """(curve, x, y) of recovery with a resynthesis after t1 draws, its marker there (the first point at or beyond t1), and with `simple` of as many draws without one."""
    again = recovery_with_resynthesis(pool, t1, t2, True, n_reps, seed)
    rows = again.select(F.lit("resynthesis").alias("curve"), "x", "y").unionByName(first_reaching(again, t1).select(F.lit("marker").alias("curve"), "x", "y"))
    if not simple:
        return rows
    plain = recovery_with_resynthesis(pool, t1 + t2, 0, False, n_reps, seed)
    return rows.unionByName(plain.select(F.lit("simple").alias("curve"), "x", "y"))


def expected_curve(pool: DataFrame, totals: DataFrame) -> DataFrame:
    """Exact expected share seen after x draws: mean of 1 - (1 - p)^x over the pool.

    Variants of one weight share a term, so what meets each of totals (a few draw
    numbers, broadcast) is one row a distinct weight, whatever the pool's size.
    """
    t = pool.agg(F.sum("weight").alias("t"), F.count("*").alias("size"))
    weights = pool.groupBy("weight").agg(F.count("*").alias("same")).crossJoin(F.broadcast(t))
    rows = weights.crossJoin(F.broadcast(totals.select("x")) if totals.count() <= 100_000 else totals.select("x"))
    return rows.groupBy("x").agg((F.sum(F.col("same") * (1 - F.pow(1 - F.col("weight") / F.col("t"), F.col("x")))) / F.first("size")).alias("y"))


def model_distribution(spark: SparkSession, size: int, skew: float = 5, seed: int = 0) -> DataFrame:
    """(variant, weight): lognormal abundances with a mean of about one, not normalised."""
    s = sigma_of(skew)
    return spark.range(size).select(F.col("id").alias("variant"), F.exp(-s * s / 2 + s * normal(F.lit(seed), "id")).alias("weight"))


def take_sample(pool: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(k, variant): `size` weighted draws with replacement in their order, k from 1."""
    draws = pool.sparkSession.range(1, size + 1).select(F.col("id").alias("k"), uniform(F.lit(seed), "id").alias("u"))
    return draw(draws, pool).select("k", "variant")


def recovered(sample: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: distinct variants drawn and their share of the pool."""
    return sample.agg(F.countDistinct("variant").alias("n")).crossJoin(F.broadcast(pool.agg(F.count("*").alias("size")))).select("n", (F.col("n") / F.col("size")).alias("share"))  # one row each


def uniform_recovery(draws: DataFrame, library: int, most: int) -> DataFrame:
    """(x, mean, std): share of the library that uniform draws (rep, k, variant) have met after each step, over replicates.

    Steps are a twentieth of `most`, 100 at least; std is of the population. One
    replicate has its share at each step counted from first sights, by an equi-join.
    """
    step = max(100, most // 20)
    first = draws.where(F.col("k") <= most).groupBy("rep", "variant").agg(F.min("k").alias("k"))
    # A variant met at draw k counts from the first step at or after it.
    met = first.groupBy("rep", (F.ceil(F.col("k") / step) * step).alias("x")).agg(F.count("*").alias("n"))
    points = draws.sparkSession.range(step, most + 1, step).withColumnRenamed("id", "x")
    every = draws.select("rep").distinct().crossJoin(F.broadcast(points))  # 20 rows at most, or one in 100 draws
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("rep").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    shares = every.join(met, ["rep", "x"], "left").select("x", (upto / library).alias("y"))
    return shares.groupBy("x").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def coverage_ticks(curve: DataFrame, library: int, t1: int | None = None) -> DataFrame:
    """(kind, x, y): a tick at each whole multiple of the library up to the curve's end, and the marker of t1, the first point at or beyond it."""
    ends = curve.agg(F.max("x").alias("most"))
    ticks = ends.select(F.explode(F.when(F.col("most") >= library, F.sequence(F.lit(1).cast("long"), F.floor(F.col("most") / library)))).alias("k"))
    rows = ticks.select(F.lit("tick").alias("kind"), (F.col("k") * library).alias("x"), F.lit(None).cast("double").alias("y"))
    return rows if t1 is None else rows.unionByName(first_reaching(curve, t1).select(F.lit("marker").alias("kind"), F.col("x").cast("long").alias("x"), "y"))
