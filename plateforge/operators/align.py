"""Banded alignment of given pairs, alignment of reads by the index, consensus with gaps, and realignment.

Where a pair and its place are known, dynamic programming in a band around it says
how they align, as a CIGAR string. Arrow batches carry the pairs; reads are aligned
where they are, without a shuffle. Consensus counts letters by place inside the
batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from .index import K, map_reads

BAND = 48
MATCH, MISMATCH, GAP = 2, -4, -4


#: Cells of the tables of the pairs that are aligned together.
TABLE_CELLS = 1 << 22


def _letters(texts: list[str], fill: int) -> np.ndarray:
    """Texts as rows of bytes, filled up to the longest."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    return out


def banded(pairs: list[tuple[str, str, int]], band: int = BAND) -> list[tuple[int, str, int] | None]:
    """(first reference place from 0, CIGAR, score) of each (read, reference, offset): the read whole, free at the reference's ends, near offset.

    A read that is found unchanged at its offset stays there. Of equally good paths
    the one that ends first is taken, and from its end on matches before deletions
    before insertions. None where the band misses the reference. All pairs go through
    their reads' letters together.
    """
    count = len(pairs)
    if not count:
        return []
    width, worst = 2 * band + 1, -(10**8)
    a, b = _letters([p[0] for p in pairs], 0), _letters([p[1] for p in pairs], 1)
    n, m = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    columns = np.arange(width) + (np.array([p[2] for p in pairs]) - band)[:, None]  # place that cell c has come to before the first letter
    steps = GAP * np.arange(width)
    rows = np.arange(count)[:, None]
    table = np.full((a.shape[1] + 1, count, width), worst, np.int32)
    same = np.zeros((a.shape[1] + 1, count, width), bool)
    table[0][(columns >= 0) & (columns <= m[:, None])] = 0
    for i in range(1, a.shape[1] + 1):
        place = columns + i - 1
        here = (place >= 0) & (place < m[:, None])
        same[i] = here & (b[rows, np.clip(place, 0, max(b.shape[1] - 1, 0))] == a[:, i - 1 : i]) if b.shape[1] else False
        best = np.where(here, table[i - 1] + np.where(same[i], MATCH, MISMATCH), worst)
        best[:, :-1] = np.maximum(best[:, :-1], table[i - 1][:, 1:] + GAP)  # a read letter that the reference lacks
        outside = (place < -1) | (place >= m[:, None])
        best[outside] = worst
        # Reference letters that the read lacks: the best of all cells to the left, less a gap for each step.
        best = np.maximum.accumulate(best - steps, axis=1) + steps
        best[outside] = worst
        table[i] = best
    end = np.argmax(table[n, np.arange(count)], axis=1)
    total = table[n, np.arange(count), end]
    out: list[tuple[int, str, int] | None] = []
    for k in range(count):
        if total[k] <= worst // 2:
            out.append(None)
            continue
        i, c, path = int(n[k]), int(end[k]), []
        cells, hits, first, last = table[:, k], same[:, k], int(columns[k, 0]), int(m[k])
        while i > 0:
            now = cells[i, c]
            if 0 <= first + c + i - 1 < last and now == cells[i - 1, c] + (MATCH if hits[i, c] else MISMATCH):
                path.append("M")
                i -= 1
            elif c > 0 and now == cells[i, c - 1] + GAP:
                path.append("D")
                c -= 1
            else:
                path.append("I")
                i, c = i - 1, c + 1
        text = "".join(reversed(path))
        out.append((first + c, "".join(f"{len(x.group())}{x.group()[0]}" for x in re.finditer(r"M+|I+|D+", text)), int(total[k])))
    return out


def _aligned(given: list[tuple | None], band: int) -> list:
    """Equal pairs of a batch are aligned once."""
    pairs = list(dict.fromkeys(given))
    found: list = [None] * len(pairs)
    rest = []
    for i, pair in enumerate(pairs):
        if pair is None or None in pair:
            continue
        read, reference, offset = pair
        if read and 0 <= offset <= len(reference) - len(read) and reference.startswith(read, offset):
            found[i] = (offset, f"{len(read)}M", MATCH * len(read))
        else:
            rest.append(i)
    rest.sort(key=lambda i: len(pairs[i][0]))
    while rest:
        most = max(1, TABLE_CELLS // ((len(pairs[rest[-1]][0]) + 1) * (2 * band + 1)))
        part, rest = rest[-most:], rest[:-most]
        for i, x in zip(part, banded([pairs[i] for i in part], band), strict=True):
            found[i] = x
    by_pair = dict(zip(pairs, found, strict=True))
    return [by_pair[p] for p in given]


def _align(band: int):
    def run(batches):
        for batch in batches:
            found = _aligned(list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)), band)
            columns = [pa.array([f and f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "pos", "cigar", "score"])

    return run


def align_pairs(pairs: DataFrame, band: int = BAND) -> DataFrame:
    """pairs (read_seq, ref_seq, offset, ...) with pos (from 0), cigar and score; null where nothing aligns."""
    kept = [c for c in pairs.columns]
    rows = pairs.select(F.struct(*kept).alias("row"), F.col("read_seq").alias("r"), F.col("ref_seq").alias("t"), F.col("offset").cast("int").alias("o"))
    kind = pairs.select(F.struct(*kept).alias("row")).schema["row"].dataType.simpleString()
    return rows.mapInArrow(_align(band), f"row {kind}, pos int, cigar string, score int").select("row.*", "pos", "cigar", "score")


def align_reads(reads: DataFrame, references: DataFrame, k: int = K, clip: bool = False, **options) -> DataFrame:
    """(read_name, ref_id, strand, pos, cigar, score, read_seq) of each read of (read_name, read_seq) that maps; see map_reads().

    read_seq is as aligned: the reverse complement on the reverse strand. Reads that share a name stay apart.
    """
    found = map_reads(reads.select("read_name", "read_seq"), references, k=k, clip=clip, **options)
    return found.where("flag <> 4").select("read_name", "ref_id", "strand", "pos", "cigar", "score", "read_seq")


#: Letters that are counted; any other is N. The last is a reference letter that a read lacks.
SYMBOLS = "ACGTN-"
#: Places of wells and references that a task counts before it hands the counts on.
HELD_PLACES = 1 << 18
_COUNTS = [f"{kind}{i}" for kind in "nw" for i in range(len(SYMBOLS))]
_PILE = "well string, at int, extra int, " + ", ".join(f"{c} long" for c in _COUNTS)
_SYMBOL = np.full(256, 4, np.int64)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _SYMBOL[[ord(x) for x in _pair]] = _i
# Thousandths of log10 of the odds of a letter being right at each phred quality: (1 - e) against e / 3.
_WEIGHT = np.array([max(0, round(1000 * np.log10(3 * (1 - e) / e))) if (e := max(10 ** (-q / 10), 1e-9)) < 0.75 else 0 for q in range(94)], np.int64)


class _Counters:
    """Counts and weights of letters by well and place: one array a well, which grows with its places; inserted letters by (place, number)."""

    def __init__(self):
        self.wells: dict[str, tuple[int, np.ndarray]] = {}
        self.extra: dict[tuple[str, int, int], np.ndarray] = {}
        self.size = 0

    def table(self, well: str, lo: int, hi: int) -> tuple[int, np.ndarray]:
        start, table = self.wells.get(well, (lo, np.zeros((0, 2 * len(SYMBOLS)), np.int64)))
        end = start + len(table)
        if lo < start or hi > end:
            first, last = min(lo, start), max(hi, end + (end - start) // 2 if hi > end else end)
            grown = np.zeros((last - first, 2 * len(SYMBOLS)), np.int64)
            grown[start - first : end - first] = table
            self.size += len(grown) - len(table)
            start, table = self.wells[well] = first, grown
        return start, table

    def add(self, reads, letters: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> None:
        """Count reads (well, pos, steps); letters and weights of all of them lie end to end, each read's from its offset."""
        runs: dict[str, list] = {}
        k = len(SYMBOLS)
        for read, (well, pos, steps) in enumerate(reads):
            at, i, mine = pos, int(offsets[read]), runs.setdefault(well, [])
            first = i
            for n, op in steps:
                if op in "M=X":
                    mine.append((at, i, n))
                    at, i = at + n, i + n
                elif op == "D":
                    start, table = self.table(well, at, at + n)
                    table[at - start : at - start + n, k - 1] += 1
                    # What is missing is as sure as the letters around it.
                    around = weights[max(i - 1, first) : min(i + 1, int(offsets[read + 1]))]
                    table[at - start : at - start + n, 2 * k - 1] += int(around.min()) if len(around) else 0
                    at += n
                elif op == "I":
                    for j in range(n):
                        key = (well, at - 1, j + 1)
                        found = self.extra.get(key)
                        if found is None:
                            found = self.extra[key] = np.zeros(2 * k, np.int64)
                            self.size += 1
                        found[letters[i + j]] += 1
                        found[k + letters[i + j]] += weights[i + j]
                    i += n
                elif op == "S":
                    i += n
        for well, mine in runs.items():
            if not mine:
                continue
            at, i, n = np.array(mine, np.int64).T
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, letter = np.repeat(at, n) + steps, np.repeat(i, n) + steps
            lo, hi = int(at.min()), int((at + n).max())
            start, table = self.table(well, lo, hi)
            cell, size = (place - lo) * k + letters[letter], (hi - lo) * k
            part = table[lo - start : hi - start]
            part[:, :k] += np.bincount(cell, minlength=size).reshape(-1, k)
            part[:, k:] += np.bincount(cell, weights[letter], size).astype(np.int64).reshape(-1, k)

    def rows(self):
        parts = []
        for well, (start, table) in self.wells.items():
            there = np.flatnonzero(table.any(axis=1))
            if len(there):
                parts.append((np.full(len(there), well, object), there + start, np.zeros(len(there), np.int64), table[there]))
        if self.extra:
            keys = list(self.extra)
            parts.append((np.array([k[0] for k in keys], object), np.array([k[1] for k in keys]), np.array([k[2] for k in keys]), np.array(list(self.extra.values()))))
        self.__init__()
        for well, at, extra, table in parts:
            columns = [pa.array(well, pa.string()), pa.array(at, pa.int32()), pa.array(extra, pa.int32()), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(table.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["well", "at", "extra", *_COUNTS])


def _end_to_end(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters, one byte each, and where each text begins (plus the end)."""
    texts = [(t or "").encode("latin-1", "replace") for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _pile(batches):
    counters = _Counters()
    known: dict[str, list] = {}

    def steps(cigar):
        if (found := known.get(cigar)) is None:
            if len(known) > 10_000:
                known.clear()
            found = known[cigar] = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS=X])", cigar)]
        return found

    for whole in batches:
        for lo in range(0, whole.num_rows, 2000):
            batch = whole.slice(lo, 2000)
            (data, offsets), (marks, ends) = _end_to_end(batch.column(3)), _end_to_end(batch.column(4))
            weights = np.full(len(data), _WEIGHT[40])
            n = np.diff(offsets)
            same = n == np.diff(ends)  # else the qualities are missing
            weights[np.repeat(same, n)] = _WEIGHT[np.clip(marks[np.repeat(same, np.diff(ends))].astype(np.int64) - 33, 0, 93)]
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            counters.add([(well, pos, steps(cigar)) for well, pos, cigar in rows], _SYMBOL[data], offsets, weights)
            if counters.size > HELD_PLACES:
                yield from counters.rows()
    yield from counters.rows()


def pile_up(aligned: DataFrame) -> DataFrame:
    """(well, at, extra, n0.., w0..): how often each of SYMBOLS stands at each place, and the weight of their qualities; extra numbers inserted letters after a place.

    aligned has well, pos, cigar, read_seq and perhaps read_qual (40 where it is
    missing). Letters are counted in the tasks that read them, so what is shuffled is one
    row a place and task, however deep a well is.
    """
    qual = F.col("read_qual") if "read_qual" in aligned.columns else F.lit(None).cast("string")
    rows = aligned.where("well is not null and pos is not null and cigar is not null").select("well", "pos", "cigar", "read_seq", qual.alias("read_qual"))
    return rows.mapInArrow(_pile, _PILE).groupBy("well", "at", "extra").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def gapped_consensus(aligned: DataFrame, least_depth: int = 1, weighted: bool = False) -> DataFrame:
    """(well, cons_seq) of (well, pos, cigar, read_seq): the majority at each place; gaps go, insertions of over half the reads stay, N below least_depth.

    With weighted (and read_qual), the call at a place is the letter or gap of the
    greatest posterior under independent errors, an even prior and the reads'
    qualities, and cons_qual has the phred of the odds against the next, 60 at most.
    Of equal calls the gap goes first, then the alphabet.
    """
    kinds = len(SYMBOLS)
    order = sorted(range(kinds), key=lambda i: SYMBOLS[i])
    by = "w" if weighted else "n"
    value = lambda i: F.struct((-F.col(f"{by}{i}")).alias("v"), (-F.col(f"n{i}")).alias("n"), F.lit(SYMBOLS[i]).alias("base"))
    depth = sum((F.col(f"n{i}") for i in range(1, kinds)), F.col("n0"))
    ranked = F.array_sort(F.filter(F.array(*(value(i) for i in order)), lambda x: x["n"] < 0))
    piled = pile_up(aligned).select("well", "at", "extra", ranked.alias("r"), depth.alias("depth"))
    best, margin = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1))["v"], F.lit(0)) - F.get("r", F.lit(0))["v"]
    calls = piled.select("well", "at", "extra", best["base"].alias("base"), F.least(F.lit(60), F.floor(margin / 100)).cast("int").alias("q"), "depth")
    places = calls.groupBy("well", "at").agg(F.max(F.when(F.col("extra") == 0, F.col("depth"))).alias("depth"), F.array_sort(F.collect_list(F.struct("extra", "base", "q", F.col("depth").alias("seen")))).alias("there"))

    def letter(x):
        call = F.when(x["extra"] > 0, F.when(2 * x["seen"] > F.col("depth"), x["base"])).when(x["seen"] < least_depth, F.lit("N")).when(x["base"] != "-", x["base"])
        return F.struct(call.alias("c"), F.when(x["seen"] < least_depth, F.lit(0)).otherwise(x["q"]).alias("q"))

    kept = F.filter(F.transform("there", letter), lambda x: x["c"].isNotNull())
    wells = places.groupBy("well").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", kept.alias("t")))), lambda x: x["t"])).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["c"]), "").alias("cons_seq")
    return wells.select("well", text, *([seq.phred_encode(F.transform("t", lambda x: x["q"])).alias("cons_qual")] if weighted else []))


def well_consensus(wells: DataFrame, aligned: DataFrame, band: int = BAND) -> DataFrame:
    """wells (global_well, major_ref, ref_seq, ref_len, ...) with cons_seq of the reads aligned to the dominant reference and its CIGAR on it.

    aligned has well, ref_id, pos, cigar and read_seq. Wells without a consensus have nulls.
    """
    mine = aligned.join(wells.select(F.col("global_well").alias("well"), F.col("major_ref").alias("ref_id")), ["well", "ref_id"], "left_semi")
    found = wells.join(gapped_consensus(mine).withColumnRenamed("well", "global_well"), "global_well", "left")
    pairs = found.withColumn("read_seq", F.col("cons_seq")).withColumn("offset", F.lit(0))
    return align_pairs(pairs, band).withColumnRenamed("cigar", "CIGAR").drop("read_seq", "offset", "pos", "score")
