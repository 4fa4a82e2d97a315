"""Shared-storage materialisation and distributed connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

_FORCE = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def materialise(df: DataFrame, split_skew: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that read the table,
    not the jobs before it. With split_skew, a join whose partitioning a later
    aggregation would reuse is still split where adaptive execution finds it
    skewed, at the price of one more shuffle; other joins stay as they are.
    """
    spark = df.sparkSession
    path = storage.scratch(spark)
    before = spark.conf.get(_FORCE, None)
    if split_skew:
        spark.conf.set(_FORCE, "true")
    try:
        df.write.parquet(path)
    finally:
        if split_skew:
            spark.conf.unset(_FORCE) if before is None else spark.conf.set(_FORCE, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that nothing reads any more."""
    for table in tables:
        storage.discard(table.sparkSession, table.written_at)


def clean(spark: SparkSession) -> None:
    """Remove every table that materialise() wrote for this driver, once results are taken or written."""
    storage.clean(spark)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(value: Column) -> Column:
    """value, computed where it stands: no filter above it is pushed below, which would repeat its whole expression for each use."""
    return F.when(F.spark_partition_id() >= 0, value)


def wide(table: DataFrame, rows_a_task: int) -> int:
    """Partitions for a shuffle by a fixed count: the session's number, or more where the (written) table has many rows."""
    return max(1, partitions(table.sparkSession), -(-table.count() // rows_a_task))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the smallest node reachable.

    Contraction: each node points at its smallest neighbour (itself included),
    pointers are doubled, edges are relabelled by them, loops and repeats go. A
    star vanishes in one round and chains shrink geometrically. All joins are
    plain equi-joins, which skew handling can split, and all minima combine
    before the shuffle, so a hub with any number of spokes is no hot spot.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up"))
        for _ in range(2):
            hop = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = materialise(parent.join(hop, "up").select("node", F.col("top").alias("up")))
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        edges = materialise(edges.join(a, "a").join(b, "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        if mapping is None:
            mapping = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "up")
            mapping = materialise(mapping.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def _add_up(batches):
    total = None
    for batch in batches:
        for value in batch.column(0):
            part = np.frombuffer(value.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def tree_sum(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the float64 vectors of `size` numbers in the one binary column of parts, in two levels, so that no task gets them all."""
    first = parts.repartition(max(1, math.isqrt(parts.rdd.getNumPartitions()))).mapInArrow(_add_up, "sums binary")
    total = first.repartition(1).mapInArrow(_add_up, "sums binary").first()
    return np.zeros(size) if total is None else np.frombuffer(total[0], np.float64)
