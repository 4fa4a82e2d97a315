"""MinHash near-duplicate detection with tensored banding (operator 8).

A document is the set of its distinct word 5-grams. Two small collections of
`bands` minhash bands are computed; a table key pairs one band of each, so
bands**2 tables come from 2 * bands * rows minhashes. Documents that share a
table key are candidates; the candidate graph's clusters bound the search and
every link inside a cluster is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .runtime import connected_components, materialise, partitions, quoted

SHINGLE = 5
PERCENT = 80
#: A link at exactly PERCENT is missed by the tables with probability about 2e-5.
BANDS = 22
ROWS = 4
#: Documents and shingles that one confirming task holds, at most about twice over.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 2_000_000


def _sets(column, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, hi, data, offsets in kernel.blocks(column):
        data = kernel.LOWER[data]
        starts, ends, bounds = kernel.words(data, offsets)
        word = kernel.span_hashes(kernel.prefix_sums(data), starts, ends)
        windows, first = kernel.shingle_hashes(word, bounds, size)
        yield lo, [np.unique(windows[first[i] : first[i + 1]]) for i in range(hi - lo)]


def _signatures(size: int, bands: int, rows: int):
    rng = np.random.default_rng(8)
    factors = rng.integers(1, 2**32, 2 * bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(1, 2**32, 2 * bands * rows, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys = np.zeros((n, 2 * bands), np.uint64)
            for lo, sets in _sets(batch.column(1), size):
                sizes = np.array([len(s) for s in sets])
                filled = np.flatnonzero(sizes)
                counts[lo : lo + len(sets)] = sizes
                if not len(filled):
                    continue
                flat = np.concatenate([sets[i] for i in filled])
                at = np.concatenate([[0], np.cumsum(sizes[filled])[:-1]])
                h1[lo + filled] = np.add.reduceat(flat, at)
                h2[lo + filled] = np.add.reduceat(kernel.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                low = (flat >> np.uint64(32)).astype(np.uint32)
                hashed = np.empty_like(low)
                for band in range(2 * bands):
                    key = np.full(len(filled), band + 1, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        np.multiply(np.bitwise_xor(low, shifts[k], out=hashed), factors[k], out=hashed)
                        key = kernel.mix(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(hashed, at))
                    keys[lo + filled, band] = key
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * bands)), pa.array(keys.view(np.int64).ravel()))],
                names=["doc_id", "n_shingles", "h1", "h2", "bands"],
            )

    return run


def _links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((n, n), dtype=np.float32)
    width = int(shared.sum())
    step = max(256, min(4096, (1 << 22) // n))
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(n):
        inter = common[i, :i].astype(np.int64)
        for j in np.flatnonzero(100 * inter >= percent * (sizes[i] + sizes[:i] - inter)):
            x, y = find(i), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _confirm(size: int, percent: int):
    """Over rows (task, node, text) sorted by task: the links within each task."""

    def flush(ids, texts):
        if len(set(ids)) < 2:
            return []
        sets = [s for _, part in _sets(pa.array(texts, pa.large_string()), size) for s in part]
        return _links(np.array(ids), sets, percent)

    def run(batches):
        current, ids, texts = None, [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for task, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if task != current:
                    out += flush(ids, texts)
                    current, ids, texts = task, [], []
                ids.append(node)
                texts.append(text or "")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        out += flush(ids, texts)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Links hold where 100 * |A & B| >= percent * |A | B| on whole shingle sets.
    With the default bands a link at exactly 0.80 is missed by the tables with
    probability about 2e-5, with 16 bands one at exactly 0.85.

    Null or wordless texts have an empty set, component_id = doc_id and are kept.
    Rows that share a doc_id count as one document (all such rows carry the same
    component); a null doc_id takes no part and gets a null component, kept true.
    Other columns of docs, whatever their names, are not looked at. Texts of any
    length are compared whole. No rows in, no rows out.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = materialise(base.mapInArrow(kernel.lean(_signatures(shingle, bands, rows)), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))
    filled = signatures.where("n_shingles > 0 and doc_id is not null")
    # Documents with equal sets are one node, named by their smallest id.
    classes = materialise(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")))

    # A table key can only be shared where both of its bands are, so bands that occur once go first.
    single = classes.select("node", F.posexplode("bands").alias("band", "value"))
    frequent = single.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    mine = single.join(frequent, "value", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < bands, F.col("value"))).alias("first"), F.collect_list(F.when(F.col("band") >= bands, F.col("value"))).alias("second")
    )
    keys = mine.select("node", F.explode("first").alias("x"), "second").select("node", "x", F.explode("second").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    keys = materialise(keys)
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    # Repeated ids with different texts are the same node already.
    edges = keys.join(leaders, "key").where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    clusters = connected_components(edges)

    sized = clusters.join(classes.select("node", "size"), "node")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n_blocks"))
    routed = clusters.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    # Each pair of blocks of a cluster meets in one task; a cluster of one block is one task.
    routed = routed.select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select(
        "node", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task")
    )
    n = max(partitions(spark), 1)
    tasks = routed.join(base.withColumnRenamed("doc_id", "node"), "node").select("task", "node", "text").repartition(n, "task").sortWithinPartitions("task", "node")
    links = tasks.mapInArrow(kernel.lean(_confirm(shingle, percent)), "a long, b long")
    components = connected_components(links).withColumnRenamed("node", "linked")

    named = classes.join(components, classes["node"] == components["linked"], "left").select("h1", "h2", F.coalesce("root", "node").alias("component"))
    result = signatures.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """docs without the documents that near_duplicates() does not keep.

    Of rows that repeat a doc_id one stays, the one whose text has the least hash;
    rows with a null doc_id all stay. No rows in, no rows out.
    """
    kept = near_duplicates(docs, percent, bands=bands).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("kept_id"), F.struct(*map(quoted, docs.columns)).alias("row"), F.xxhash64("text").alias("h"))
    known = rows.where("kept_id is not null").groupBy("kept_id").agg(F.min_by("row", "h").alias("row")).join(kept, "kept_id", "left_semi")
    return known.select("row").union(rows.where("kept_id is null").select("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, bands=16)


#: All pairs that share a shingle, by count: for tables of a few thousand documents.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n - c)), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
small AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM s LEFT JOIN small ON doc_id = a"""
