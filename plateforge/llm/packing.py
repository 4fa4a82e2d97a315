"""Conflict-constrained best-fit packing (operator 3).

Documents, longest first, go to the fullest bin that still holds them and has no
conflict: a bin never holds two pieces of one duplicate cluster or of one source.
Bins stand in order of their residual; those of a residual are classed by the
bitmaps of their sources and of their duplicate clusters, and how many of them hold
each source and cluster is counted. The successor search walks up from the piece's
size, past residuals whose bins all hold the piece's source or cluster, until a
compatible bin is found, so the tightest one is taken.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, near_dedup
from .runtime import partitions

CAPACITY = 2048
#: Items packed together; the number of groups follows the table.
GROUP_ITEMS = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, int, int]]:
    """items: (size, source, cluster), longest first. (bin, first offset, residual then) of each.

    Of compatible bins of the tightest residual, one of a class met first is taken, its newest.
    """
    sources: dict = {}
    repeated = {c: i for i, c in enumerate(k for k, n in Counter(c for _, _, c in items).items() if n > 1)}
    bins: list[list[int]] = []  # residual, sources, clusters
    by_residual: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(dict)
    total: Counter = Counter()  # bins of each residual
    holding: dict[tuple, Counter] = defaultdict(Counter)  # of these, the ones that hold a source or a cluster
    inside: list[list[tuple]] = []  # what each bin holds, as keys of holding
    filled = 0  # bit r: some bin has residual r
    out = []
    for size, source, cluster in items:
        place = sources.setdefault(source, len(sources))
        s, mine = 1 << place, [("s", place)]
        c = 0
        if cluster in repeated:
            c = 1 << repeated[cluster]
            mine.append(("c", repeated[cluster]))
        taken = [holding[k] for k in mine]
        chosen, ahead = None, filled >> size
        while ahead and chosen is None:
            r = size + (ahead & -ahead).bit_length() - 1
            ahead &= ahead - 1
            if any(t[r] == total[r] for t in taken):
                continue
            for (held, clusters), members in by_residual[r].items():
                if not held & s and not clusters & c:
                    chosen = members.pop()
                    if not members:
                        del by_residual[r][held, clusters]
                    total[r] -= 1
                    for k in inside[chosen]:
                        holding[k][r] -= 1
                    if not total[r]:
                        filled &= ~(1 << r)
                    break
        if chosen is None:
            chosen = len(bins)
            bins.append([capacity, 0, 0])
            inside.append([])
        b = bins[chosen]
        out.append((chosen, capacity - b[0], b[0] - size))
        b[0] -= size
        b[1] |= s
        b[2] |= c
        inside[chosen] += mine
        if b[0]:  # a full bin takes nothing more
            by_residual[b[0]].setdefault((b[1], b[2]), []).append(chosen)
            total[b[0]] += 1
            for k in inside[chosen]:
                holding[k][b[0]] += 1
            filled |= 1 << b[0]
    return out


def _pack(capacity: int):
    def flush(group, rows):
        whole, items, out = 0, [], []
        for doc_id, size, source, cluster in rows:
            # What exceeds a bin fills bins of its own; the rest is packed.
            k, rest = divmod(size, capacity)
            for piece in range(k):
                out.append((doc_id, piece, piece * capacity, capacity, (group << 32) | whole, 0, 0))
                whole += 1
            if rest:
                items.append((rest, source, cluster, doc_id, k))
        items.sort(key=lambda x: -x[0])
        for (size, _, _, doc_id, k), (at, offset, left) in zip(items, best_fit([x[:3] for x in items], capacity), strict=True):
            out.append((doc_id, k, k * capacity, size, (group << 32) | (whole + at), offset, left))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_offset", "left_then"])

    def run(batches):
        group, rows = None, []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group and rows:
                    yield flush(group, rows)
                    rows = []
                group = g
                rows.append(row)
        if rows:
            yield flush(group, rows)

    return run


def _normal(text: str):
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, bin_offset, left_then): where each piece of each document lies.

    A document's tokens are its words and one end mark, so null and empty texts
    have one. Longer ones than a bin are cut at multiples of capacity; nothing is
    dropped. cluster names a column with the duplicate cluster; without it,
    documents with the same words in the same order, in any case and spacing, are
    one cluster. A null source or doc_id is a value like any other; ties go by
    doc_id; repeated rows are packed each (in different bins, being one cluster).
    Other columns are not looked at; no rows in, no rows out. Groups of about GROUP_ITEMS documents, dealt by a hash, are packed apart, so
    each leaves at most its last bins underfull and memory is bounded by a group.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(_normal("text"))
    groups = max(1, -(-docs.count() // GROUP_ITEMS))
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.regexp_count(text, F.lit(_WORD)) + 1).alias("size"), "source", key.alias("cluster"), F.length(text).alias("length"))
    items = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "length"), F.lit(groups)))
    dealt = items.repartition(min(groups, max(partitions(docs.sparkSession), 1)), "grp").sortWithinPartitions("grp", F.desc("size"), "doc_id")
    schema = "doc_id long, piece int, first_token long, n_tokens int, bin_id long, bin_offset int, left_then int"
    return dealt.select("grp", "doc_id", "size", "source", "cluster").mapInArrow(kernel.lean(_pack(capacity)), schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are near-duplicate components; rows without an id or words, which have none, go by their text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    near = near_dedup.near_duplicates(docs, percent=85, bands=16).where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component"))
    # A row that repeats an id with no words takes that id's component: it is the same document.
    rows = docs.withColumn("node", F.col("doc_id").cast("long")).join(near.withColumnRenamed("doc_id", "node"), "node", "left")
    cluster = F.when(F.col("component").isNotNull(), F.struct(F.lit("").alias("text"), F.col("component").alias("id"))).otherwise(F.struct(_normal("text").alias("text"), F.lit(None).cast("long").alias("id")))
    return pack(rows.select("doc_id", "text", "source", cluster.alias("cluster")), cluster="cluster")
