"""Repeated-passage removal with longest-previous-factor arrays (operator 10).

A window is a string of `length` bytes. Every window has an anchor: the gram of
ANCHOR bytes with the smallest hash in it, leftmost on ties. Equal windows have
equal anchors at equal offsets, so a corpus-wide comparison splits by anchor.
The windows of a text that share one anchor occurrence form a piece. Anchors met
once are done; where all pieces of an anchor are equal, all their windows repeat.
The rest meet, one copy of each distinct piece, at their anchor. A group of more
than ARRAY_PIECES distinct pieces is divided by longer keys: the windows in which
the anchor lies at the first half of the offsets share more bytes to its left,
the others more to its right, and these bytes are the halves' keys. Every halving
lengthens the key; keys met once and pieces met again are done as before, and at
a key of `length` bytes a group is one string. So a group of any size is divided
in at most eight rounds over a table that shrinks by each, without one row for
each window. Each group left is one suffix array: previous and next smaller
positions in suffix order give each window's longest previous factor (and, turned
round, its longest next one), and a window repeats where that reaches `length`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .runtime import discard, materialise, quoted, wide

LENGTH = 200
ANCHOR = 40
#: Bytes of pieces that a worker gathers before it builds an array (groups are never cut).
ARRAY_BYTES = 1 << 19
#: Distinct pieces (about 280 bytes each) that one suffix array takes; larger groups are divided first.
ARRAY_PIECES = 2000
#: Rows of a table that one task of a shuffle by a fixed count should get.
TASK_ROWS = 50_000


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text index, first window, windows, anchor hash, piece hash) of all pieces of a block, as arrays."""
    lens = np.diff(offsets)
    grams = len(data) - ANCHOR + 1
    if grams <= 0 or lens.max() < length:
        return None
    sums = kernel.prefix_sums(data)
    at = np.arange(grams)
    packed = (kernel.span_hashes(sums, at, at + ANCHOR) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = length - ANCHOR + 1
    padded = np.full((-(-grams // width) + 1) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = packed
    cells = padded.reshape(-1, width)
    left = np.minimum.accumulate(cells, axis=1).ravel()
    right = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    ends = np.repeat(offsets[1:], lens)
    p = np.flatnonzero(np.arange(len(data)) + length <= ends)
    anchor = (np.minimum(right[p], left[p + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.concatenate([first, [len(p)]]))
    lo, a = p[first], anchor[first]
    owner = np.searchsorted(offsets, lo, side="right") - 1
    return owner, lo - offsets[owner], n, kernel.span_hashes(sums, a, a + ANCHOR), kernel.span_hashes(sums, lo, lo + n - 1 + length)


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            ids, units, twins = (batch.column(i) for i in range(3))
            for lo, hi, data, offsets in kernel.blocks(batch.column(3)):
                if (found := _pieces(data, offsets, length)) is None:
                    continue
                owner, start, n, anchor, piece = found
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), ids.take(rows), units.take(rows), twins.take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["anchor", "piece", "id", "unit", "twin", "start", "n"],
                )

    return run


_HALF = "grp long, cls long, anchor long, piece long, id long, unit long, twin long, start int, at int, near int, far int, low int, n int, bytes binary"
_HALF_COLUMNS = [c.split(" ")[0] for c in _HALF.split(", ")]


def _anchor_of(raw: bytes, length: int) -> int:
    """Place of the anchor that all windows of a piece share: that of its first window."""
    data = np.frombuffer(raw[:length], np.uint8)
    grams = np.arange(length - ANCHOR + 1)
    return int(np.argmin(kernel.span_hashes(kernel.prefix_sums(data), grams, grams + ANCHOR) >> np.uint64(32)))


def _halve(length: int):
    """Rows of _HALF to the two halves of their windows, by the anchor's offset in the window.

    A row's windows have the anchor (at byte `at` of its piece) at offsets near to
    far - 1; low is the first of them in the piece. All windows of a half hold the
    bytes of its key, whatever else a row has; grp is the key's hash, cls that of
    all the half's bytes.
    """

    def run(batches):
        for batch in batches:
            out = []
            for _, _, *name, at, near, far, low, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    at = _anchor_of(raw, length)
                middle = (near + far) // 2
                for a, b in ((near, middle), (middle, far)):
                    first, last = max(low, at - b + 1), min(low + n - 1, at - a)
                    if first <= last:
                        out.append((*name, at, a, b, first, last - first + 1, raw[first - low : last - low + length], at - a - first, at - b + 1 - first + length))
            if not out:
                continue
            data = np.frombuffer(b"".join(r[-3] for r in out), np.uint8)
            ends = np.cumsum([len(r[-3]) for r in out])
            base = np.concatenate([[0], ends[:-1]])
            sums = kernel.prefix_sums(data)
            keys = kernel.span_hashes(sums, base + [r[-2] for r in out], base + [r[-1] for r in out])
            grp = kernel.mix(keys + np.array([r[7] * 1000 + r[8] for r in out], np.uint64))
            cls = kernel.span_hashes(sums, base, ends)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(cls.view(np.int64)), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=_HALF_COLUMNS)

    return run


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    return rank


def rank_levels(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(reach, rank of each position's next `reach` bytes) by prefix doubling from 8 up to depth (8 at least); equal strings, equal ranks."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    levels = [(8, _dense(key))]
    while (reach := levels[-1][0]) < depth:
        rank, step = levels[-1][1], min(reach, depth - reach)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - step)] = rank[step:].astype(np.uint64) + np.uint64(1)
        levels.append((reach + step, _dense(rank * np.uint64(n + 1) + later)))
    return levels


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    return rank_levels(text, depth)[-1][1]


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest place before and the nearest after it with a smaller value; -1 and len(values) where there is none."""
    n = len(values)
    low = np.concatenate([values, [-1]])  # place n (and -1) ends every search
    out = []
    for step in (-1, 1):
        near = np.arange(n) + step
        near[near < 0] = n
        near = np.append(near, n)
        open_ = np.flatnonzero(low[near[:n]] > values)
        while len(open_):
            near[open_] = near[near[open_]]  # what lies between is larger still
            open_ = open_[low[near[open_]] > values[open_]]
        out.append(near[:n])
    before, after = out
    return np.where(before == n, -1, before), after


def longest_factors(levels: list[tuple[int, np.ndarray]], at: np.ndarray, depth: int, later: bool = True) -> tuple[np.ndarray, ...]:
    """Longest previous and, if asked, longest next factor of the suffixes that start at the ascending positions `at`, among these, cut at depth.

    In suffix order, the previous and the next smaller position are the two suffixes
    nearest to a suffix of all that start earlier; the longer common prefix is its
    longest previous factor. Larger positions, the same way, give the longest next.
    """
    ranks = levels[-1][1][at]
    order = np.argsort(ranks, kind="stable")
    size = len(levels[0][1])

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at text positions i and j in whole steps of 8 bytes; depth where it is reached."""
        n = np.full(len(i), depth, np.int64)
        short = np.flatnonzero(levels[-1][1][i] != levels[-1][1][j])
        i, j, met = i[short], j[short], np.zeros(len(short), np.int64)
        for reach, rank in reversed(levels[:-1]):
            a, b = i + met, j + met
            inside = (np.maximum(a, b) < size) & (met + reach <= depth)
            met += reach * (inside & (rank[np.minimum(a, size - 1)] == rank[np.minimum(b, size - 1)]))
        n[short] = np.minimum(met, depth - 1)
        return n

    out = []
    for value in (order, len(at) - 1 - order)[: 1 + later]:
        best = np.zeros(len(at), np.int64)
        for near in smaller_neighbours(value):
            there = np.flatnonzero((near >= 0) & (near < len(at)))
            mine = order[there]
            best[mine] = np.maximum(best[mine], common(at[mine], at[order[near[there]]]))
        out.append(best)
    return tuple(out)


def repeated_windows(pieces: list[bytes], counts: list[int], length: int, keep_first: bool) -> list[tuple[list[int], list[int]]]:
    """For each piece, runs (first, last) of its windows that occur elsewhere in pieces, or earlier if keep_first."""
    sizes = np.array([len(b) for b in pieces])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    levels = rank_levels(np.frombuffer(b"".join(pieces), np.uint8), length)
    counts = np.array(counts)
    owner = np.repeat(np.arange(len(pieces)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    window = np.arange(len(owner)) - begin[owner]
    factors = longest_factors(levels, base[owner] + window, length, later=not keep_first)
    hit = np.max(factors, axis=0) >= length
    edge = np.ones(len(hit) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(edge)
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in pieces]
    for lo, hi in zip(starts[:-1], starts[1:] - 1, strict=True):
        if hit[lo]:
            out[owner[lo]][0].append(int(window[lo]))
            out[owner[lo]][1].append(int(window[hi]))
    return out


def _compare(length: int, keep_first: bool):
    """Rows (grp, anchor, piece, low, n, bytes) sorted by grp and document order to (anchor, piece, lo[], hi[])."""

    def flush(rows):
        found = repeated_windows([r[5] for r in rows], [r[4] for r in rows], length, keep_first)
        kept = [(r[1], r[2], [r[3] + x for x in f[0]], [r[3] + x for x in f[1]]) for r, f in zip(rows, found, strict=True) if f[0]]
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), ints, ints))], names=["anchor", "piece", "lo", "hi"])

    def run(batches):
        rows, seen, size, last = [], set(), 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if size > ARRAY_BYTES:
                        yield flush(rows)
                        rows, size = [], 0
                    seen, last = set(), row[0]
                if row[1:4] not in seen:  # a document row that is there twice sends its pieces twice
                    seen.add(row[1:4])
                    rows.append(row)
                    size += len(row[5])
        if rows:
            yield flush(rows)

    return run


def _apply(columns: int):
    """Rows with the columns of docs, then whole, los, his: the same columns, then n_bytes, spans and the bytes kept."""

    def run(batches):
        for batch in batches:
            out = []
            for text, whole, los, his in zip(*(batch.column(i).to_pylist() for i in (columns, columns + 1, columns + 2, columns + 3)), strict=True):
                raw = (text or "").encode()
                spans = [[0, len(raw)]] if whole and raw else []
                if not whole and los:
                    for lo, hi in sorted(zip((x for part in los for x in part), (x for part in his for x in part), strict=True)):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                out.append((len(raw), [{"start": lo, "end": hi} for lo, hi in spans], rest := b"".join([*kept, raw[at:]]), rest.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[*batch.schema.names[:columns], "n_bytes", "spans", "kept", "kept_text"])

    return run


def _identity() -> tuple:
    """Two hashes that name a text: 128 bits, so that no two texts of a corpus share them by chance."""
    return F.xxhash64("text").alias("unit"), F.xxhash64(F.lit(20), "text").alias("twin")


def _array_runs(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(anchor, piece, lo, hi): runs of repeated windows in the groups (grp) of pieces, each compared in one suffix array."""
    tasks = wide(pieces, TASK_ROWS)
    dealt = pieces.repartition(tasks, "grp").sortWithinPartitions("grp", "id", "unit", "twin", "start", "low")
    return dealt.select("grp", "anchor", "piece", "low", "n", "bytes").mapInArrow(kernel.lean(_compare(length, keep_first)), "anchor long, piece long, lo array<int>, hi array<int>")


def _divided_runs(pieces: DataFrame, length: int, keep_first: bool):
    """As _array_runs, a table a round, of groups that are too large for one array."""
    top = length - ANCHOR + 1
    fixed = {"grp": F.lit(0).cast("long"), "cls": F.lit(0).cast("long"), "at": F.lit(-1), "near": F.lit(0), "far": F.lit(top), "low": F.lit(0)}
    rows = pieces.dropDuplicates(["anchor", "piece"]).withColumns(fixed).select(*_HALF_COLUMNS)
    while not rows.isEmpty():
        halves = materialise(rows.mapInArrow(kernel.lean(_halve(length)), _HALF))
        me = F.struct("id", "unit", "twin", "start", "anchor", "piece")
        same = halves.groupBy("grp", "cls").agg(F.min(me).alias("f"), (F.count("*") > 1).alias("many"))
        # Written apart, like the anchors, so that a hot group's rows are split in their join.
        same = materialise(same)
        sizes = same.groupBy("grp").agg(F.count("*").alias("k"))
        marked = halves.join(materialise(same.join(sizes, "grp")), ["grp", "cls"]).withColumn("leads", me.eqNullSafe(F.col("f")))
        marked = materialise(marked.drop("f"))
        again = marked.where("many and not leads" if keep_first else "many")
        yield again.select("anchor", "piece", F.array("low").alias("lo"), F.array(F.col("low") + F.col("n") - 1).alias("hi"))
        rest = marked.where("leads and k > 1")
        yield _array_runs(rest.where(F.col("k") <= ARRAY_PIECES), length, keep_first)
        rows = rest.where(F.col("k") > ARRAY_PIECES).select(*_HALF_COLUMNS)


def strip_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Every row of docs as struct `row`, with n_bytes, spans (start, end in bytes, disjoint, sorted), the kept bytes and kept_text.

    A byte is in a span if a string of `length` bytes over it starts anywhere else
    in the corpus, the same text included; with keep_first, only if it starts
    earlier, in (doc_id, position) order, so that the first copy stays. Strings
    never cross documents. Equal texts are whole copies: all of them go (with
    keep_first all but those with the smallest doc_id; rows that also share the
    doc_id count as one). Null and empty texts, and texts shorter than `length`,
    keep all they have; a null doc_id comes first in order. Characters that a cut
    divides are not in kept_text. Extra columns pass through in `row`.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), *_identity(), "text")
    long = base.where(F.octet_length("text") >= length)
    copies = long.groupBy("unit", "twin").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.count_if(F.col("id").isNull()).alias("nulls"))
    copies = copies.where("copies > 1").select("unit", "twin", F.when(F.col("nulls") == 0, F.col("first_id")).alias("first_id"), F.lit(True).alias("copied"))

    schema = "anchor long, piece long, id long, unit long, twin long, start int, n int"
    anchors = materialise(long.select("id", "unit", "twin", "text").mapInArrow(kernel.lean(_anchors(length)), schema))
    place = F.xxhash64("unit", "twin", "start")
    met = anchors.groupBy("anchor").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.min("piece").alias("q0"), F.max("piece").alias("q1"), F.min(F.struct("id", "unit", "twin", "start")).alias("first"))
    # Written apart, so that the next join deals both sides itself; a hot anchor's places are split, then aggregated.
    met = materialise(met.where("p0 <> p1").select("anchor", (F.col("q0") != F.col("q1")).alias("mixed"), "first"))
    places = anchors.join(met, "anchor").groupBy("unit", "twin", "start", "anchor", "piece", "n", "mixed").agg(F.min("id").alias("id"), F.min("first").alias("first"))
    places = materialise(places, split_skew=True)
    discard(anchors, met)

    mixed = places.where("mixed")
    classes = materialise(mixed.groupBy("anchor", "piece").agg(F.min(F.struct("id", "unit", "twin", "start", "n")).alias("f"), (F.count("*") > 1).alias("many")))
    hot = classes.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > ARRAY_PIECES).select("anchor", F.lit(True).alias("hot"))
    wants = classes.join(hot, "anchor", "left").groupBy(F.col("f.unit").alias("u"), F.col("f.twin").alias("t"), F.col("f.id").alias("i"))
    wants = wants.agg(F.collect_list(F.struct("anchor", "piece", F.col("f.start").alias("start"), F.col("f.n").alias("n"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wants"))
    # A text's bytes are laid out once; each piece is copied out of them as it is written, so a row in hand is one piece, however many its text has.
    cut = long.join(wants, (F.col("unit") == F.col("u")) & (F.col("twin") == F.col("t")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "unit", "twin", F.col("text").cast("binary").alias("raw"), "wants")
    cut = cut.select("id", "unit", "twin", "raw", F.explode("wants").alias("w")).select("w.anchor", "w.piece", "id", "unit", "twin", "w.start", "w.n", "w.hot", F.substring("raw", F.col("w.start") + 1, F.col("w.n") - 1 + length).alias("bytes"))
    cut = materialise(cut)
    runs = _array_runs(cut.where("not hot").withColumn("grp", F.col("anchor")).withColumn("low", F.lit(0)), length, keep_first)
    for found in _divided_runs(cut.where("hot"), length, keep_first):
        runs = runs.unionByName(found)

    end = F.col("start") + F.col("n") - 1 + length
    # What a piece has is whole where it repeats another row's; the one row that was compared has the runs found.
    if keep_first:
        plain = places.where(~F.col("mixed") & ~F.struct("id", "unit", "twin", "start").eqNullSafe(F.col("first")))
        full = mixed.join(classes.where("many").select("anchor", "piece", "f"), ["anchor", "piece"]).where(~F.struct("id", "unit", "twin", "start", "n").eqNullSafe(F.col("f")))
        compared = classes
    else:
        plain = places.where("not mixed")
        full = mixed.join(classes.where("many").select("anchor", "piece"), ["anchor", "piece"])
        compared = classes.where("not many")
    spans = plain.select("unit", "twin", F.array("start").alias("lo"), F.array(end).alias("hi")).union(full.select("unit", "twin", F.array("start"), F.array(end)))
    at = compared.select("anchor", "piece", F.col("f.unit").alias("unit"), F.col("f.twin").alias("twin"), F.col("f.start").alias("start")).join(runs, ["anchor", "piece"])
    spans = spans.union(at.select("unit", "twin", F.transform("lo", lambda x: x + F.col("start")), F.transform("hi", lambda x: x + F.col("start") + length)))
    spans = spans.groupBy("unit", "twin").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))

    names = docs.columns
    rows = docs.select(F.struct(*map(quoted, names)).alias("row"), F.col("text"), *_identity(), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(spans, ["unit", "twin"], "left").join(copies, ["unit", "twin"], "left")
    gone = F.coalesce("copied", F.lit(False))
    if keep_first:
        gone = gone & ~F.col("id").eqNullSafe(F.col("first_id"))
    ready = rows.select("row", "text", (gone & (F.octet_length("text") >= length)).alias("whole"), "los", "his")
    ready = ready.select(*(F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "text", "whole", "los", "his")
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + ["n_bytes long", "spans array<struct<start:int,end:int>>", "kept binary", "kept_text string"])
    done = ready.mapInArrow(kernel.lean(_apply(len(names))), schema)
    return done.select(F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names))).alias("row"), "n_bytes", "spans", "kept", "kept_text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window by its hash, cut out of blocks of its text: for tables of a few MB.
ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(hex(text), '') AS h, length(coalesce(hex(text), '')) // 2 AS n FROM documents),
b AS (SELECT doc_id, h, n, unnest(range(0, n - 199, 512)) AS s FROM d WHERE n >= 200),
g AS (SELECT doc_id, n, s, substr(h, 2 * s + 1, 1424) AS part FROM b),
o AS (SELECT doc_id, s, part, unnest(range(least(512, n - 199 - s))) AS o FROM g),
w AS (SELECT doc_id, s + o AS i, hash(substr(part, 2 * o + 1, 400)) AS k FROM o),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w SEMI JOIN again USING (k)),
run AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM span),
kept AS (SELECT doc_id, count(*) AS spans, sum(hi - lo) AS removed, max(hi) AS last, string_agg(substr(h, CAST(2 * upto + 1 AS BIGINT), CAST(2 * (lo - upto) AS BIGINT)), '' ORDER BY lo) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
