"""Approximate nearest neighbours by cross-polytope hashing (operator 1).

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns each unit vector; its hash is the nearest signed axis. A table's bucket is
the hash of one rotation, or of several where there are many vectors: the last of
them over as few axes as keep about BUCKET_ROWS vectors in a bucket. A query
probes, in each of TABLES tables, the buckets whose axes miss its nearest ones by
least; their number grows with the square root of the buckets, so that a query
meets a share of the vectors that falls as they grow. What it meets is reranked
by exact inner products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialise, partitions

TABLES = 16
#: Buckets that a query probes in a table of one rotation.
PROBES = 8
BUCKET_ROWS = 50
#: Vectors of one bucket that a task compares at a time; larger buckets are divided.
BLOCK = 4000
#: Pairs that a task scores before it keeps each query's best only.
HELD_PAIRS = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def layout(n: int, dimensions: int) -> tuple[list[int], int]:
    """Signed axes of each hash that a bucket is made of, and the buckets that a query probes in a table, for n vectors."""
    axes = 2 << max(0, (dimensions - 1).bit_length())
    hashes, cells = [axes], axes
    while (more := round(math.log2(max(1.0, n / BUCKET_ROWS / cells)))) > 0:
        hashes.append(min(axes, 1 << more))
        cells *= hashes[-1]
    return hashes, math.ceil(PROBES * math.sqrt(cells / axes))


def rotations(vectors: np.ndarray, hashes: list[int], tables: int):
    """For each table, the projections on the signed axes of its hashes: arrays (rows, axes)."""
    width = hashes[0] // 2
    unit = np.zeros((len(vectors), width), np.float32)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    unit[:, : vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    for table in range(tables):
        out = []
        for part, axes in enumerate(hashes):
            rng, x = np.random.default_rng([1, table, part] if part else [1, table]), unit
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width).astype(np.float32))
            half = x[:, : axes // 2]
            out.append(np.concatenate([half, -half], axis=1))
        yield table, out


def buckets(parts: list[np.ndarray]) -> np.ndarray:
    """The bucket of each row."""
    at = np.zeros(len(parts[0]), np.int64)
    for x in parts:
        at = at * x.shape[1] + x.argmax(axis=1)
    return at


def probed(parts: list[np.ndarray], probes: int) -> np.ndarray:
    """(rows, probes): the buckets whose axes fall short of the nearest ones by the least sum of squares."""
    best, cost = np.zeros((len(parts[0]), 1), np.int64), np.zeros((len(parts[0]), 1))
    for x in parts:
        short = (x.max(axis=1, keepdims=True) - x).astype(np.float64) ** 2
        n = min(probes, x.shape[1])
        axes = np.argpartition(short, n - 1, axis=1)[:, :n]
        best = (best[:, :, None] * x.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + np.take_along_axis(short, axes, axis=1)[:, None, :]).reshape(len(x), -1)
        if best.shape[1] > probes:
            keep = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            best, cost = np.take_along_axis(best, keep, axis=1), np.take_along_axis(cost, keep, axis=1)
    return best


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filled(hashes: list[int], tables: int):
    """Vectors to (bucket, n): how many of a batch are in each bucket."""
    cells = math.prod(hashes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([table * cells + buckets(parts) for table, parts in rotations(_matrix(batch.column(0)), hashes, tables)])
                values, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["bucket", "n"])

    return run


def _route(hashes: list[int], probes: int, tables: int):
    """Classes to rows (bucket, asks, class, vec, ids): once a table as a candidate, probes times if it asks."""
    cells = math.prod(hashes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            klass, vectors, ids, asks = batch.columns
            x = _matrix(vectors)
            asking = np.flatnonzero(asks.to_numpy(zero_copy_only=False))
            for table, parts in rotations(x, hashes, tables):
                there, rows = [buckets(parts)], [np.arange(len(x))]
                if len(asking):
                    near = probed([p[asking] for p in parts], probes)
                    there.append(near.ravel())
                    rows.append(np.repeat(asking, near.shape[1]))
                at = pa.array(np.concatenate(rows))
                kind = np.repeat([False, True], [len(rows[0]), sum(map(len, rows[1:]))])
                yield pa.RecordBatch.from_arrays([pa.array(table * cells + np.concatenate(there)), pa.array(kind), klass.take(at), vectors.take(at), ids.take(at)], names=["bucket", "asks", "class", "vec", "ids"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class _Held:
    """The best k ids of each query that a task has met so far; memory is bounded by HELD_PAIRS and k a query."""

    def __init__(self, k: int):
        self.k, self.place, self.least = k, {}, np.zeros(0)
        self.parts, self.size = [], 0

    def add(self, queries: list[int], scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.array([self.place.setdefault(q, len(self.place)) for q in queries])
        if len(self.least) < len(self.place):
            self.least = np.concatenate([self.least, np.full(len(self.place), -np.inf)])
        row, column = np.nonzero(scores >= self.least[at][:, None])
        self.parts.append((at[row], scores[row, column], ids[column]))
        self.size += len(row)
        if self.size > HELD_PAIRS:
            self.keep()

    def keep(self) -> None:
        q, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, q))
        first = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])])
        q, score, ids = q[order][first], score[order][first], ids[order][first]
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        top = rank < self.k
        last = rank == self.k - 1
        self.least[q[last]] = score[last]
        self.parts = [(q[top], score[top], ids[top])]
        # A second of what is kept is left for what comes, so that no pair is sorted often.
        self.size = min(int(top.sum()), HELD_PAIRS // 2)

    def lists(self):
        if not self.parts:
            return
        self.keep()
        (q, score, ids), names = self.parts[0], np.array(list(self.place), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        for lo in range(0, len(cuts), 4096):
            some = np.append(cuts[lo : lo + 4096], cuts[lo + 4096] if lo + 4096 < len(cuts) else len(q))
            offsets, part = pa.array((some - some[0]).astype(np.int32)), slice(some[0], some[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names[q[some[:-1]]]), pa.ListArray.from_arrays(offsets, pa.array(score[part])), pa.ListArray.from_arrays(offsets, pa.array(ids[part]))], names=["class", "scores", "ids"])


def _search(k: int):
    """Rows sorted by (task, asks): candidates, then queries; (class, scores, ids) of each query's best in all the tasks of a partition."""

    def answer(held, base, queries):
        if not base or not queries:
            return
        vectors = np.concatenate([_matrix(v) for v, _ in base])
        lists = [x for _, ids in base for x in ids.to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], np.int64)
        step = max(1, HELD_PAIRS // len(flat))
        for klass, part in queries:
            q, names = _matrix(part), klass.to_pylist()
            for lo in range(0, len(q), step):
                # Sums of products in one order for every pair: no blocking of a matrix product decides a tie.
                held.add(names[lo : lo + step], np.einsum("ik,jk->ij", q[lo : lo + step], vectors)[:, owner], flat)

    def run(batches):
        held, task, base, queries = _Held(k), None, [], []
        for batch in batches:
            tasks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], tasks[1:] != tasks[:-1]])) if len(tasks) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(tasks)], strict=True):
                if tasks[lo] != task:
                    answer(held, base, queries)
                    task, base, queries = tasks[lo], [], []
                part = batch.slice(lo, hi - lo)
                asks = part.column(1).to_numpy(zero_copy_only=False)
                n = int((~asks).sum())
                if n:
                    base.append((part.column(3).slice(0, n), part.column(4).slice(0, n)))
                if n < len(asks):
                    queries.append((part.column(2).slice(n), part.column(3).slice(n)))
        answer(held, base, queries)
        yield from held.lists()

    return run


def _lists(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.list_(pa.int64()))], names=["class", "scores", "ids"])


def _merge(k: int):
    """Rows sorted by class: the best k of all lists of a class, each id once."""

    def run(batches):
        current, parts, out = None, [], ([], [], [])

        def flush():
            score, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ids, at = np.unique(ids, return_index=True)
            best = _best(score[at], ids, k)
            out[0].append(current)
            out[1].append(score[at][best])
            out[2].append(ids[best])

        for batch in batches:
            for klass, scores, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if klass != current and parts:
                    flush()
                    parts = []
                current = klass
                parts.append((np.array(scores), np.array(ids, np.int64)))
                if len(parts) > 64:  # memory stays that of a few lists
                    flush()
                    parts = [(out[1].pop(), out[2].pop())]
                    out[0].pop()
            if out[0]:
                yield _lists(out)
                out = ([], [], [])
        if parts:
            flush()
            yield _lists(out)

    return run


def _merged(found: DataFrame, parts: int, k: int) -> DataFrame:
    return found.repartition(parts, "class").sortWithinPartitions("class").mapInArrow(_merge(k), _LISTS)


_LISTS = "class long, scores array<double>, ids array<long>"


def _everywhere(classes: DataFrame, short: DataFrame, n: int, n_short: int, parts: int, k: int) -> DataFrame:
    """Lists of the short classes over all n classes: each block of candidates meets each block of queries in one task."""
    blocks, groups = -(-n // BLOCK), -(-n_short // BLOCK)
    place = lambda count: F.pmod(F.xxhash64("class"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    base = classes.select(every(groups).alias("other"), "class", "vec", "ids").select((place(blocks) * groups + F.col("other")).alias("task"), F.lit(False).alias("asks"), "class", "vec", "ids")
    asking = classes.join(short, "class", "left_semi").select(every(blocks).alias("other"), "class", "vec", "ids").select((F.col("other") * groups + place(groups)).alias("task"), F.lit(True).alias("asks"), "class", "vec", "ids")
    return base.unionByName(asking).repartition(parts, "task").sortWithinPartitions("task", "asks").mapInArrow(_search(k), _LISTS)


def nearest(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which the condition `queries` holds.

    vectors has vec_id and embedding (arrays). Rows with a null vec_id, and null,
    empty or zero vectors or ones with null or non-finite parts, take no part; nor
    do vectors of another length than most (of two lengths equally frequent, the
    larger), with which there is no inner product. Equal vectors are indexed once,
    with their k + 1 smallest ids, which is all that any list can hold of them, so
    a vector that a third of the rows repeat is one candidate. Ties go to smaller
    ids; rows of one vec_id count as the query's own. A bucket of over BLOCK
    vectors is divided over tasks, each of which its queries visit. A query that
    meets fewer than k ids in its buckets is compared with all vectors, so it has
    k rows, or all where there are fewer. No rows in, or none that may ask: no
    rows out. Other columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"  # floats are half as much to move, and exact as doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False)))
    usual = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = usual["d"] if usual else 1
    rows = rows.where(F.size("vec") == width)
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    few = rows.select("vec_id", "vec").distinct().withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("vec").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = asking.select("vec").distinct().withColumn("asks", F.lit(True))
    classes = materialise(classes.join(asked, "vec", "left").select("class", "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    n = classes.count()
    hashes, probes = layout(n, width)
    filled = classes.select("vec").mapInArrow(_filled(hashes, tables), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    full = materialise(filled.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).alias("salts")))
    routed = classes.select("class", "vec", "ids", "asks").mapInArrow(_route(hashes, probes, tables), f"bucket long, asks boolean, class long, vec array<{kind}>, ids array<long>")
    task = F.col("bucket")
    if not full.isEmpty():
        routed = routed.join(full, "bucket", "left")
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
        salt = F.when(F.col("asks"), every).otherwise(F.array(F.pmod(F.xxhash64("class"), F.coalesce("salts", F.lit(1)))))
        routed = routed.withColumn("salt", F.explode(salt))
        task = F.xxhash64("bucket", "salt")
    parts = max(1, partitions(spark), -(-n * tables // 200_000))
    found = routed.select(task.alias("task"), "asks", "class", "vec", "ids").repartition(parts, "task").sortWithinPartitions("task", "asks").mapInArrow(_search(k + 1), _LISTS)
    merged = materialise(_merged(found, parts, k + 1))
    least = min(k + 1, few.select("vec_id").distinct().limit(k + 1).count())
    short = merged.where(F.size("ids") < least).select("class").union(classes.where("asks").select("class").join(merged, "class", "left_anti"))
    if n_short := short.count():
        exact = _merged(_everywhere(classes, short, n, n_short, parts, k + 1), parts, k + 1)
        merged = merged.where(F.size("ids") >= least).unionByName(exact)
    lists = merged.join(classes.where("asks").select("class", "vec"), "class").select("vec", F.arrays_zip("scores", "ids").alias("near"))
    other = F.slice(F.filter("near", lambda x: x["ids"] != F.col("query_id")), 1, k)
    return asking.join(lists, "vec").select("query_id", F.posexplode(other)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
