"""Minimizer index of references, and reads mapped by chains of its seeds.

Of every window of W successive k-mers the one of the least hash is a seed, on
whichever strand is smaller, so a read and a reference that share a stretch of W + K
- 1 letters share a seed there. The index is a table: built once, written, and used
again. Seeds with very many places say nothing of where a read belongs; they are cut
at a stated count and reported. References go to the reads' tasks in lots of bounded
size, one pass over the reads each, so reads are never shuffled and each row keeps
its own best alignment, whatever its name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq

K, W = 11, 5
#: Places of a seed beyond which it is cut from the index.
MOST_PLACES = 200
#: Letters of the references that go to a task at once.
LOT_BASES = 8 << 20
MATCH, MISMATCH, OPEN, EXTEND = 2, -4, 4, 2
#: Score under which an alignment is no better than chance.
LEAST_SCORE = 30
#: Letters between two seeds of a chain, and of a read's end beyond its chain, that are aligned at most.
REACH = 2000
#: Cells of the tables that are filled together; seeds that a chain's next one looks back on; (reference, strand) groups of a read that are aligned.
TABLE_CELLS, LOOK_BACK, CANDIDATES = 1 << 21, 50, 5

_CODE = np.full(256, 4, np.uint8)
for _letters in (b"ACGT", b"acgt"):
    _CODE[np.frombuffer(_letters, np.uint8)] = range(4)
_TURN = np.arange(256, dtype=np.uint8)
_TURN[np.frombuffer(seq.IUPAC.encode(), np.uint8)] = np.frombuffer(seq.COMPLEMENT.encode(), np.uint8)


def turned(text: bytes) -> bytes:
    return _TURN[np.frombuffer(text, np.uint8)][::-1].tobytes()


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def minimizers(texts: list[bytes], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, seed, turned) of the seeds of each text, in order; k-mers with another letter than ACGT have none.

    A text with fewer than w k-mers, but with some, has the least of them.
    """
    gap = b"\0" * max(1, w - k + 1)
    data = _CODE[np.frombuffer(gap.join(texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])])
    n = len(data) - k + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, bool)
    there, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        letter = data[j : j + n].astype(np.uint64)
        there = there << np.uint64(2) | letter & np.uint64(3)
        back |= (np.uint64(3) - (letter & np.uint64(3))) << np.uint64(2 * j)
    odd = np.concatenate([[0], np.cumsum(data == 4)])
    none = np.uint64(2**64 - 1)
    seeds = _mix(np.minimum(there, back))
    seeds[(odd[k:] - odd[:-k] > 0) | (there == back)] = none
    padded = np.concatenate([seeds, np.full(w - 1, none)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, w)
    least = np.argmin(windows, axis=1)
    at = np.unique((np.arange(n) + least)[windows[np.arange(n), least] != none])
    owner = np.searchsorted(offsets, at, side="right") - 1
    return owner, at - offsets[owner], seeds[at], back[at] < there[at]


_SEED = "seed long, ref_id string, place int, turned boolean"


def _seeds(k: int, w: int):
    def run(batches):
        for batch in batches:
            names = batch.column(0)
            owner, place, seed, back = minimizers([(t or "").encode("latin-1", "replace") for t in batch.column(1).to_pylist()], k, w)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), names.take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(back)], names=["seed", "ref_id", "place", "turned"])

    return run


def build_index(references: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(seed, ref_id, place, turned, hits, k, w) of the references (ref_id, ref_seq); hits is the number of the seed's places in all of them.

    References without a name, a sequence or any k-mer of ACGT have no row.
    """
    seeds = references.where("ref_id is not null and ref_seq is not null").select("ref_id", "ref_seq").mapInArrow(_seeds(k, w), _SEED)
    hits = seeds.groupBy("seed").agg(F.count("*").alias("hits"))
    return seeds.join(hits, "seed").select("seed", "ref_id", "place", "turned", "hits", F.lit(k).alias("k"), F.lit(w).alias("w"))


def save_index(index: DataFrame, path: str) -> DataFrame:
    """The index, written as Parquet and read back: later runs read it by load_index()."""
    index.write.mode("overwrite").parquet(path)
    return load_index(index.sparkSession, path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index_report(index: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """One row: seeds, places, and of both those that are cut because a seed has over `most` places."""
    by_seed = index.groupBy("seed").agg(F.count("*").alias("n"))
    big = F.col("n") > most
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_seed.agg(F.count("*").alias("seeds"), total("n").alias("places"), F.count_if(big).alias("cut_seeds"), total(F.when(big, F.col("n"))).alias("cut_places"))


# ---- alignment of segments ----


def _rows(texts: list[bytes], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t, np.uint8)
    return out


def _fill(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of the first i letters of each a with the first j of its b, with an affine cost of gaps: all, and those that end with a letter that b lacks."""
    count, n = a.shape
    m = b.shape[1]
    low = -(10**8)
    steps = EXTEND * np.arange(m + 1, dtype=np.int32)
    best, extra = np.empty((n + 1, count, m + 1), np.int32), np.empty((n + 1, count, m + 1), np.int32)
    best[0] = np.where(steps > 0, -OPEN - steps, 0)
    extra[0] = low
    base = np.empty((count, m + 1), np.int32)
    for i in range(1, n + 1):
        np.maximum(extra[i - 1] - EXTEND, best[i - 1] - (OPEN + EXTEND), out=extra[i])
        base[:, 0] = extra[i][:, 0]
        base[:, 1:] = np.maximum(best[i - 1][:, :-1] + np.where(a[:, i - 1 : i] == b, MATCH, MISMATCH), extra[i][:, 1:])
        best[i] = base
        if m:
            # Letters that a lacks: from the best cell to the left, less the gap's cost.
            left = np.maximum.accumulate(base + steps, axis=1)[:, :-1] - OPEN - steps[1:]
            np.maximum(best[i][:, 1:], left, out=best[i][:, 1:])
    return best, extra


def _back(best: np.ndarray, extra: np.ndarray, a: bytes, b: bytes, i: int, j: int) -> str:
    """The path to cell (i, j), a letter a step: = X I D; matches before gaps in b's favour."""
    path = []
    state, lost = "H", 0
    while i or j:
        if state == "H":
            now = best[i, j]
            same = i and j and a[i - 1] == b[j - 1]
            if i and j and now == best[i - 1, j - 1] + (MATCH if same else MISMATCH):
                path.append("=" if same else "X")
                i, j = i - 1, j - 1
            elif i and now == extra[i, j]:
                state = "I"
            else:
                state, lost = "D", int(now)
        elif state == "D":
            path.append("D")
            j -= 1
            if lost == best[i, j] - OPEN - EXTEND:
                state = "H"
            lost += EXTEND
        else:
            path.append("I")
            if extra[i, j] == best[i - 1, j] - OPEN - EXTEND:
                state = "H"
            i -= 1
    return "".join(reversed(path))


def align_segments(pairs: list[tuple[bytes, bytes, str]]) -> list[tuple[int, str, int]]:
    """(score, path, letters of the reference) of each (read, reference, kind).

    "whole": both to their ends. "end": the read to its end, free in the reference.
    "clip": free in both; read letters that would lower the score are S. Equal pairs
    are aligned once, equal letters without a table.
    """
    found: dict[tuple, tuple] = {}
    rest = []
    for pair in dict.fromkeys(pairs):
        a, b, kind = pair
        if a == b or kind != "whole" and b.startswith(a):
            found[pair] = (MATCH * len(a), "=" * len(a), len(a))
        elif kind == "whole" and not (a and b):
            n = len(a) + len(b)
            found[pair] = (-OPEN - EXTEND * n, ("I" if a else "D") * n, len(b))
        elif kind == "whole" and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
            found[pair] = (MATCH * (len(a) - 1) + MISMATCH, "".join("=" if x == y else "X" for x, y in zip(a, b, strict=True)), len(b))
        elif kind == "clip" and not b:
            found[pair] = (0, "S" * len(a), 0)
        else:
            rest.append(pair)
    rest.sort(key=lambda p: (len(p[0]), len(p[1])))
    while rest:
        last = rest[-1]
        take, width = 0, 0
        while take < len(rest) and (take == 0 or (take + 1) * (len(last[0]) + 1) * (max(width, len(rest[-take - 1][1])) + 1) <= TABLE_CELLS):
            take += 1
            width = max(width, len(rest[-take][1]))
        lot, rest = rest[-take:], rest[:-take]
        best, extra = _fill(_rows([p[0] for p in lot], 0), _rows([p[1] for p in lot], 1))
        for at, pair in enumerate(lot):
            a, b, kind = pair
            table, more = best[: len(a) + 1, at, : len(b) + 1], extra[: len(a) + 1, at, : len(b) + 1]
            if kind == "whole":
                i, j = len(a), len(b)
            elif kind == "end":
                i, j = len(a), int(np.argmax(table[-1]))
            else:  # the latest letter of the read on ties
                top = table.max(axis=1)
                i = len(top) - 1 - int(np.argmax(top[::-1]))
                j = int(np.argmax(table[i]))
            found[pair] = (int(table[i, j]), _back(table, more, a, b, i, j) + "S" * (len(a) - i), j)
    return [found[p] for p in pairs]


# ---- chains ----


def chain(places: np.ndarray, reads: np.ndarray, k: int) -> tuple[float, list[int]]:
    """(score, indexes) of the best chain of seeds, both places rising; seeds are sorted by places, then reads.

    A seed adds its new letters, less a cost that grows with the difference of both
    steps; steps are REACH letters at most.
    """
    n = len(places)
    shift = places - reads
    if n == 1 or (shift == shift[0]).all() and np.diff(places).max() <= REACH:
        return float(k + np.minimum(np.diff(places), k).sum()), list(range(n))
    # Most chains are short, where plain numbers are faster than arrays of a few.
    p, q = places.tolist(), reads.tolist()
    score, before = [float(k)] * n, [-1] * n
    for j in range(1, n):
        top, back = float(k), -1
        for i in range(max(0, j - LOOK_BACK), j):
            dr, dq = p[j] - p[i], q[j] - q[i]
            if dr <= 0 or dq <= 0 or dr > REACH or dq > REACH:
                continue
            gain = score[i] + min(dr, dq, k)
            if dr != dq and gain > top:
                gap = abs(dr - dq)
                gain -= 0.01 * k * gap + 0.5 * math.log2(gap + 1)
            if gain > top:
                top, back = gain, i
        score[j], before[j] = top, back
    at = score.index(max(score))
    total, out = score[at], []
    while at >= 0:
        out.append(at)
        at = before[at]
    return total, out[::-1]


def _blocks(places, reads, k):
    """Exact stretches (reference place, read place, length) of a chain; a seed that overlaps the one before on another diagonal is left to the gap."""
    out: list[list[int]] = []
    for r, q in zip(places, reads, strict=True):
        if out:
            r0, q0, n = out[-1]
            if r - q == r0 - q0 and r <= r0 + n:
                out[-1][2] = r + k - r0
                continue
            if r < r0 + n or q < q0 + n:
                continue
        out.append([int(r), int(q), k])
    return out


class _Lot:
    """References and their seeds, as sorted arrays."""

    def __init__(self, names, texts, seeds, refs, places, back):
        order = np.argsort(seeds, kind="stable")
        self.names, self.texts = names, texts
        self.seeds, self.refs, self.places, self.back = (np.asarray(x)[order] for x in (seeds, refs, places, back))

    def anchors(self, reads: list[bytes], k: int, w: int, direction: str | None):
        """Groups (read, reference, turned, places, read places) of the seeds that reads share with references, best supported first within a read."""
        owner, place, seed, back = minimizers(reads, k, w)
        lo, hi = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(seed)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        i, r, turn = owner[which], self.refs[at], back[which] != self.back[at]
        lengths = np.array([len(t) for t in reads], np.int64)
        q = np.where(turn, lengths[i] - k - place[which], place[which]) if len(i) else place[which]
        p = self.places[at].astype(np.int64)
        if direction:
            kept = turn == (direction == "reverse")
            i, r, turn, q, p = i[kept], r[kept], turn[kept], q[kept], p[kept]
        order = np.lexsort((q, p, turn, r, i))
        i, r, turn, q, p = i[order], r[order], turn[order], q[order], p[order]
        edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (turn[1:] != turn[:-1])])) if len(i) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(i)))
        best: dict[int, int] = {}
        taken: dict[int, int] = {}
        for g in np.lexsort((edge, -size, i[edge])).tolist() if len(edge) else ():
            read = int(i[edge[g]])
            most = best.setdefault(read, int(size[g]))
            if 2 * size[g] < most or taken.get(read, 0) >= CANDIDATES:
                continue
            taken[read] = taken.get(read, 0) + 1
            part = slice(edge[g], edge[g] + size[g])
            yield read, int(r[edge[g]]), bool(turn[edge[g]]), p[part], q[part]

    def align(self, reads: list[bytes], k: int, w: int, direction: str | None, clip: bool, least: int) -> list[tuple | None]:
        """(ref_id, turned, pos, cigar, score, edits) of each read, or None."""
        plans, pairs = [], []
        ends = "clip" if clip else "end"
        for read, ref, turn, places, at in self.anchors(reads, k, w, direction):
            text, target = turned(reads[read]) if turn else reads[read], self.texts[ref]
            _, kept = chain(places, at, k)
            blocks = _blocks(places[kept], at[kept], k)
            r, q, _ = blocks[0]
            head = text[max(0, q - REACH) : q]
            span = len(head) + len(head) // 2 + 16
            first = len(pairs)
            pairs.append((head[::-1], target[max(0, r - span) : r][::-1], ends))
            for (r0, q0, n), (r1, q1, _) in zip(blocks, blocks[1:], strict=False):
                pairs.append((text[q0 + n : q1], target[r0 + n : r1], "whole"))
            r, q, n = blocks[-1]
            tail = text[q + n : q + n + REACH]
            pairs.append((tail, target[r + n : r + n + len(tail) + len(tail) // 2 + 16], ends))
            plans.append((read, ref, turn, blocks, first, max(0, blocks[0][1] - REACH), max(0, len(text) - (q + n) - REACH)))
        solved = align_segments(pairs)
        out: list = [None] * len(reads)
        ranks: list = [None] * len(reads)
        for read, ref, turn, blocks, first, cut_head, cut_tail in plans:
            parts = solved[first : first + len(blocks) + 1]
            score = sum(p[0] for p in parts) + MATCH * sum(n for *_, n in blocks)
            rank = (-score, self.names[ref], turn)
            if score < least or ranks[read] is not None and ranks[read] <= rank:
                continue
            path = "S" * cut_head + parts[0][1][::-1]
            for (_, _, n), (_, step, _) in zip(blocks, parts[1:], strict=True):
                path += "=" * n + step
            path += "S" * cut_tail
            cigar = "".join(f"{len(m[0])}{'M' if m[0][0] in '=X' else m[0][0]}" for m in re.finditer(r"[=X]+|I+|D+|S+", path))
            ranks[read] = rank
            out[read] = (self.names[ref], turn, blocks[0][0] - parts[0][2], cigar, score, sum(map(path.count, "XID")))
        return out


_BEST = "ref_id string, turned boolean, pos int, cigar string, score int, edits int"
_BEST_KINDS = (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32())


def _map(lot, k: int, w: int, direction: str | None, clip: bool, least: int):
    def run(batches):
        index = _Lot(*lot.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                texts = [(t or "").encode("latin-1", "replace") for t in batch.column(1).to_pylist()]
                distinct = list(dict.fromkeys(texts))
                found = dict(zip(distinct, index.align(distinct, k, w, direction, clip, least), strict=True))
                best = []
                for text, *old in zip(texts, *(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                    new = found[text]
                    best.append(new if new and (old[0] is None or (-new[4], new[0], new[1]) < (-old[4], old[0], old[1])) else old)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([b[i] for b in best], t) for i, t in enumerate(_BEST_KINDS))], names=["row", "s", *(c.split(" ")[0] for c in _BEST.split(", "))])

    return run


ADDED = ("ref_id", "flag", "strand", "pos", "cigar", "score", "edits")


def map_reads(reads: DataFrame, references: DataFrame, index: DataFrame | None = None, direction: str | None = None, clip: bool = True, most: int = MOST_PLACES, k: int = K, w: int = W, least: int = LEAST_SCORE) -> DataFrame:
    """All rows of reads (read_seq, ...) with ref_id, flag, strand, pos (from 0), cigar, score and edits of the best alignment; read_seq is as aligned.

    Seeds of one reference and strand are chained; the letters between them are aligned
    with affine gap costs, those at the ends free in the reference, with clip also cut
    off (S) where they fit badly. The best score wins, then the smaller ref_id, then the
    forward strand; one under `least` is none. flag is 0, 16 (turned) or 4 (nothing found: nulls); edits counts
    letters changed, lost and gained. direction "forward" or "reverse" allows one strand
    only. index is build_index()'s, perhaps loaded; without one it is built here.
    Seeds with over `most` places are not used. Null and empty reads are unmapped.
    Columns named like the added ones are replaced.
    """
    if direction not in (None, "forward", "reverse"):
        raise ValueError("direction is forward or reverse, or None")
    spark = reads.sparkSession
    if index is None:
        index = build_index(references, k, w)
    else:
        size = index.select("k", "w").first()
        k, w = (size.k, size.w) if size else (k, w)
    known = references.where("ref_id is not null and ref_seq is not null").select("ref_id", "ref_seq")
    bases = known.agg(F.coalesce(F.sum(F.length("ref_seq")), F.lit(0))).first()[0]
    lots = max(1, math.ceil(bases / LOT_BASES))
    mine = F.pmod(F.xxhash64("ref_id"), F.lit(lots))
    rest = [c for c in reads.columns if c not in ADDED and c != "read_seq"]
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in _BEST.split(", "))]
    rows = reads.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.col("read_seq").alias("s"), *none)
    kind = rows.schema["row"].dataType.simpleString()
    for lot in range(lots):
        # About LOT_BASES letters and their seeds, whatever the size of the whole.
        texts = {r.ref_id: (r.ref_seq or "").encode("latin-1", "replace") for r in known.where(mine == lot).toLocalIterator()}
        names = sorted(texts)
        number = {name: i for i, name in enumerate(names)}
        seeds = index.where((mine == lot) & (F.col("hits") <= most)).select("seed", "ref_id", "place", "turned").toArrow()
        arrays = seeds["seed"].to_numpy().view(np.uint64), np.array([number[x] for x in seeds["ref_id"].to_pylist()], np.int32), seeds["place"].to_numpy(), seeds["turned"].to_numpy()
        sent = spark.sparkContext.broadcast((names, [texts[n] for n in names], *arrays))
        rows = rows.mapInArrow(_map(sent, k, w, direction, clip, least), f"row {kind}, s string, {_BEST}")
    back = F.col("turned")
    out = {c: F.col("row")[c] for c in rest} | {"read_seq": F.when(back, seq.reverse_complement("s")).otherwise(F.col("s"))}
    added = {
        "ref_id": F.col("ref_id"), "flag": F.when(back.isNull(), 4).when(back, 16).otherwise(0), "strand": F.when(back, "rev").when(~back, "fwd"), **{c: F.col(c) for c in ADDED[3:]}
    }
    return rows.select(*(out[c].alias(c) for c in reads.columns if c not in ADDED), *(added[c].alias(c) for c in ADDED))
