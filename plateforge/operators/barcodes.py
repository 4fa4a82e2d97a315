"""Barcode demultiplexing: approximate search at the ends of reads, calls, trimming and summaries.

A barcode may lie anywhere in a read's end window, with letters changed, lost or
gained. Its distance and its place come from one bit-parallel pass over the window:
a column of the dynamic programming table is two machine words of steps up and down,
and all reads of an Arrow batch and all barcodes of the kit advance by one letter
together. Reads stay where they are; nothing is shuffled and no name needs to be
unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..sources import records

UNCLASSIFIED = "unclassified"
#: Letters of the longest barcode (a machine word's bits), and rows of the largest kit, which goes to every task.
CODE_LETTERS, KIT_ROWS = 64, 1000
#: Pairs of a read and a barcode that advance together.
PAIRS = 1 << 18
ADDED = ("idx", "barcode", "distance", "next_distance", "front_start", "front_end", "rear_start", "rear_end")

_TURN = np.arange(256, dtype=np.uint8)
_TURN[np.frombuffer(seq.IUPAC.encode(), np.uint8)] = np.frombuffer(seq.COMPLEMENT.encode(), np.uint8)
_ONE = np.uint64(1)


def _masks(codes: list[bytes]) -> np.ndarray:
    """For each code and letter, the bits of the letter's places."""
    table = np.zeros((len(codes), 256), np.uint64)
    for k, code in enumerate(codes):
        for i, letter in enumerate(code):
            table[k, letter] |= np.uint64(1 << i)
    return table


def _advance(eq, up, down, high, score, first):
    """One text letter: the steps up and down of a column, and the score of its last cell. first: 1 where each letter before a match costs one."""
    x = eq | down
    across = (((eq & up) + up) ^ up) | eq
    rise, fall = down | ~(across | up), up & across
    score += (rise & high != 0).astype(np.int16) - (fall & high != 0).astype(np.int16)
    rise, fall = rise << _ONE | first, fall << _ONE
    return fall | ~(x | rise), rise & x


def search(texts: np.ndarray, lengths: np.ndarray, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end), each codes x texts: the least edit distance of a code to any substring of a text, and where the first such substring ends.

    texts are rows of letters, filled up with zeros.
    """
    masks = _masks(codes)
    size = np.array([[len(c)] for c in codes], np.int16)
    high = _ONE << (size - 1).astype(np.uint64)
    shape = (len(codes), len(texts))
    score = np.broadcast_to(size, shape).copy()
    best, end = score.copy(), np.zeros(shape, np.int16)
    up, down = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)
    for j in range(texts.shape[1]):
        up, down = _advance(masks[:, texts[:, j]], up, down, high, score, np.uint64(0))
        better = (score < best) & (j < lengths)
        best = np.where(better, score, best)
        end[better] = j + 1
    return best, end


def starts(texts: np.ndarray, ends: np.ndarray, which: np.ndarray, distance: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """Where the shortest substring that ends at ends and has the distance to its code begins."""
    masks = _masks([c[::-1] for c in codes])
    size = np.array([len(c) for c in codes], np.int16)[which]
    high, score = _ONE << (size - 1).astype(np.uint64), size.copy()
    begin = np.where(score == distance, ends, -1)
    up, down = np.full(len(texts), ~np.uint64(0)), np.zeros(len(texts), np.uint64)
    rows = np.arange(len(texts))
    for j in range(texts.shape[1]):
        letter = np.where(j < ends, texts[rows, np.maximum(ends - 1 - j, 0)], 0)
        up, down = _advance(masks[which, letter], up, down, high, score, _ONE)
        begin = np.where((begin < 0) & (score == distance) & (j < ends), ends - 1 - j, begin)
    return np.maximum(begin, 0)


def _window(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([min(len(t), window) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint8)
    for i, t in enumerate(texts):
        out[i, : lengths[i]] = np.frombuffer(t[:window], np.uint8)
    return out, lengths


def call(texts: list[bytes], codes: list[bytes], window: int, most: int, margin: int, ends: str):
    """(which code or -1, distance, next distance, front start, front end, rear start, rear end) arrays over texts; places are -1 where an end has none."""
    sides = [_window(texts, window)]
    if ends != "front":
        sides.append(_window([_TURN[np.frombuffer(t[-window:], np.uint8)][::-1].tobytes() for t in texts], window))
    found = [search(*side, codes) for side in sides]
    total = found[0][0] if ends == "front" else (np.minimum if ends == "either" else np.maximum)(found[0][0], found[1][0])
    order = np.argsort(total, axis=0, kind="stable")
    rows = np.arange(len(texts))
    which, distance = order[0], total[order[0], rows]
    after = total[order[1], rows] if len(codes) > 1 else np.full(len(texts), -1, np.int16)
    clear = (distance <= most) & ((after < 0) | (after - distance >= margin))
    places = []
    for (text, _), (d, e) in zip(sides, found, strict=True):
        mine, end = d[which, rows], e[which, rows].astype(np.int64)
        there = clear & (mine <= most)
        places.append((np.where(there, starts(text, end, which, mine, codes), -1), np.where(there, end, -1)))
    whole = np.array([len(t) for t in texts], np.int64)
    front = places[0]
    rear = tuple(np.where(p >= 0, whole - p, -1) for p in reversed(places[1])) if len(places) > 1 else (np.full(len(texts), -1),) * 2
    return np.where(clear, which, -1), distance, after, *front, *rear


def _call(names: list[str], idx: list[int], codes: list[bytes], window: int, most: int, margin: int, ends: str, trim: bool):
    lot = max(1, PAIRS // len(codes))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, lot):
                batch = whole.slice(at, lot)
                bases, quals = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                which, distance, after, *places = call([(b or "").encode("latin-1", "replace") for b in bases], codes, window, most, margin, ends)
                given = [(p.astype(np.int32), p < 0) for p in places]
                if trim:
                    cut = [(max(int(f), 0), int(r) if r >= 0 else None) for f, r in zip(places[1], places[2], strict=True)]
                    bases = [b and b[f : max(f, len(b) if r is None else r)] for b, (f, r) in zip(bases, cut, strict=True)]
                    quals = [q and q[f : max(f, len(q) if r is None else r)] for q, (f, r) in zip(quals, cut, strict=True)]
                called = which.tolist()
                columns = [
                    batch.column(0), pa.array(bases, pa.string()), pa.array(quals, pa.string()), pa.array([idx[k] if k >= 0 else None for k in called], pa.int32()), pa.array([names[k] if k >= 0 else UNCLASSIFIED for k in called]),
                    pa.array(distance.astype(np.int32)), pa.array(after.astype(np.int32), mask=after < 0), *(pa.array(p, mask=m) for p, m in given),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "s", "q", *ADDED])

    return run


def demultiplex(reads: DataFrame, kit: DataFrame, window: int = 40, most: int = 4, margin: int = 1, ends: str = "front", trim: bool = True) -> DataFrame:
    """reads (read_seq, perhaps read_qual, ...) with the barcode of each and its places.

    kit has idx, name and barcode: at most KIT_ROWS rows of at most CODE_LETTERS letters.
    A code is sought in the first `window` letters; with ends "either" or "both" its
    reverse complement also in the last ones, and the lesser or the greater distance
    counts. The barcode is called where its distance is `most` at most and `margin` less
    than any other's (ties between codes are unclassified unless margin is 0: then the
    smaller idx). Added: idx (null), barcode (or "unclassified"), distance, next_distance,
    and the places, from 0, of the barcode at either end, null where it is not. With trim, read_seq and
    read_qual keep what lies between. Null and empty reads are unclassified. Columns of
    reads that are named like an added one are replaced.
    """
    if ends not in ("front", "either", "both"):
        raise ValueError("ends is front, either or both")
    rows = kit.select("idx", "name", "barcode").orderBy("idx").limit(KIT_ROWS + 1).collect()
    codes = [(r.barcode or "").encode("latin-1", "replace") for r in rows]
    if not 0 < len(rows) <= KIT_ROWS or not all(0 < len(c) <= CODE_LETTERS for c in codes):
        raise ValueError(f"a kit has 1 to {KIT_ROWS} barcodes of 1 to {CODE_LETTERS} letters")
    cut = [c for c in ("read_seq", "read_qual") if c in reads.columns]
    rest = [c for c in reads.columns if c not in (*ADDED, *cut)]
    packed = reads.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), "read_seq", "read_qual" if "read_qual" in cut else F.lit(None).cast("string").alias("read_qual"))
    kind = packed.schema["row"].dataType.simpleString()
    added = ", ".join(f"{c} {'string' if c == 'barcode' else 'int'}" for c in ADDED)
    found = packed.mapInArrow(_call([r.name for r in rows], [r.idx for r in rows], codes, window, most, margin, ends, trim), f"row {kind}, s string, q string, {added}")
    return found.select(*(F.col("row")[c].alias(c) if c in rest else F.col("s" if c == "read_seq" else "q").alias(c) for c in reads.columns if c not in ADDED), *ADDED)


def barcode_summary(called: DataFrame, kit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a barcode of the kit, called or not, and one for the unclassified, for each of the `by` columns: reads, their share, mean distance, letters left.

    called is demultiplex()'s output. Rows are counted before anything is joined.
    """
    counts = called.groupBy(*by, "barcode").agg(F.count("*").alias("reads"), F.avg("distance").alias("mean_distance"), F.sum(F.length("read_seq")).alias("bases"))
    names = kit.select(F.col("name").alias("barcode")).union(kit.sparkSession.createDataFrame([(UNCLASSIFIED,)], "barcode string"))
    # The counts of a group, KIT_ROWS + 1 at most, are one map, so that the reads are passed over once.
    one = F.when(F.col("barcode").isNotNull(), F.struct("barcode", F.struct("reads", "mean_distance", "bases").alias("c")))
    groups = counts.groupBy(*by).agg(F.sum("reads").alias("total"), F.map_from_entries(F.collect_list(one)).alias("found"))
    found = groups.crossJoin(F.broadcast(names)).select(*by, "barcode", "total", F.try_element_at("found", F.col("barcode")).alias("c"))  # KIT_ROWS + 1 names at most
    n = F.coalesce("c.reads", F.lit(0)).cast("long")
    return found.select(*by, "barcode", n.alias("reads"), F.coalesce(n / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("share"), "c.mean_distance", F.coalesce("c.bases", F.lit(0)).cast("long").alias("bases"))


def batch_demux(spark: SparkSession, root: str, kit: DataFrame, max_reads: int | None = None, glob: str = "*.{fastq,fq}*", range_bytes: int = records.RANGE_BYTES, **options) -> DataFrame:
    """demultiplex() over all FASTQ files under root, or one file, in one plan: source_file (the name without its last suffix), rec, read_name, read_seq, read_qual and what is added.

    max_reads takes the first records of every file, exactly: files are framed only as
    far as the byte range that holds the last of them. Malformed records are left out
    (they count as records).
    """
    rows = records.read_fastq(spark, root, glob, range_bytes, max_reads).where("not malformed")
    source = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return demultiplex(rows.select("path", source.alias("source_file"), "rec", F.col("header").alias("read_name"), F.col("seq").alias("read_seq"), F.col("qual").alias("read_qual")), kit, **options)


def write_demux(called: DataFrame, path: str) -> None:
    """FASTQ text of batch_demux(): a folder a source file, and in it one a barcode, unclassified included. Rows are written where they are."""
    called.select("source_file", "barcode", records.record_text().alias("value")).write.partitionBy("source_file", "barcode").text(path)
