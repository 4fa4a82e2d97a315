"""Alignment, consensus and the FASTQ source against brute force."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from plateforge.functions import stats
from plateforge.operators import align, demux
from plateforge.sources import records


def full(read, ref):
    """The best score over the whole table, without a band."""
    n, m = len(read), len(ref)
    low = -(10**9)
    h = [[0] * (m + 1)] + [[low] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            h[i][j] = max(h[i - 1][j - 1] + (align.MATCH if read[i - 1] == ref[j - 1] else align.MISMATCH) if j else low, h[i - 1][j] + align.GAP, h[i][j - 1] + align.GAP if j else low)
    return max(h[n])


def test_banded_alignment_is_the_best():
    r = random.Random(1)
    pairs = []
    for _ in range(150):
        ref = "".join(r.choice("ACGT") for _ in range(r.randint(20, 60)))
        start = r.randint(0, 10)
        read = list(ref[start : start + r.randint(8, 45)])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(read))
            read[k : k + 1] = r.choice([[r.choice("ACGT")], [], [read[k], r.choice("ACGT")]]) if len(read) > 3 else [read[k]]
        pairs.append(("".join(read), ref, start))
    for (read, ref, _), (at, cigar, score) in zip(pairs, align.banded(pairs, 80), strict=True):
        assert score == full(read, ref)
        i, j, total = 0, at, 0
        for n, op in re.findall(r"(\d+)([MID])", cigar):
            n = int(n)
            total += sum(align.MATCH if read[i + q] == ref[j + q] else align.MISMATCH for q in range(n)) if op == "M" else align.GAP * n
            i, j = i + n * (op in "MI"), j + n * (op in "MD")
        assert (i, total) == (len(read), score)
    assert align.banded([]) == [] and align.banded([("ACGT", "ACGT", 500)]) == [None]


def test_consensus_keeps_what_most_reads_have(spark):
    ref = "ACGTTGCAAGGCTTAACCGATTGCATCGGA"
    truth = ref[:10] + ref[11:18] + "T" + ref[18:]
    reads = [("w", truth if i % 3 else ref, "g", ref, 0) for i in range(9)] + [("v", None, "g", ref, 0)]
    pairs = spark.createDataFrame(reads, "well string, read_seq string, ref_id string, ref_seq string, offset int")
    wells = spark.createDataFrame([("w", "g", ref, len(ref)), ("v", "g", ref, len(ref))], "global_well string, major_ref string, ref_seq string, ref_len int")
    got = {r.global_well: r for r in demux.classify_consensus(align.well_consensus(wells, align.align_pairs(pairs, 10), 10)).collect()}
    assert got["w"].cons_seq == truth and sum(int(n) for n in re.findall(r"(\d+)[MI]", got["w"].CIGAR)) == len(truth) and "D" in got["w"].CIGAR and "I" in got["w"].CIGAR
    assert got["v"].cons_seq is None and got["v"].cons_check == "Error"


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_fastq_ranges(spark, tmp_path, size):
    """Records of odd shapes, cut anywhere by the ranges, are those of a plain reading of lines."""
    r = random.Random(size)
    lines = []
    for i in range(60):
        n = r.randint(0, 9)
        lines += [f"@r{i} é" if i % 9 else "", "ACGTACGTA"[:n], "+", "@+IIIIIIIII"[: n if i % 7 else n + 1]]
    lines = lines[:-2]
    text = "\n".join(lines) + ("\n" if size == 7 else "")
    (tmp_path / "a.fastq").write_text(text, "utf-8")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "empty.fastq").write_text("")
    want = []
    for at in range(0, len(lines), 4):
        part = lines[at : at + 4] + [None] * 4
        want.append((at // 4, part[0][1:], part[1], part[3]))
    found = records.read_fastq(spark, str(tmp_path), range_bytes=size).collect()
    for name in ("a.fastq", "b.fq.gz"):
        assert sorted((x.rec, x.header, x.seq, x.qual) for x in found if x.path.endswith(name)) == want
    bad = {x.rec for x in found if x.malformed}
    assert bad == {i for i in range(60) if i % 9 == 0 or i % 7 == 0 or i == 59}
    assert [x.malformed for x in records.malformed_files(records.read_fastq(spark, str(tmp_path))).collect()] == [len(bad)] * 2
    assert records.read_fastq(spark, str(tmp_path / "a.fastq")).count() == 60


def test_running_total_and_quantile(spark, monkeypatch):
    monkeypatch.setattr(stats, "CELL", 3)
    rows = spark.createDataFrame([(k, i, i % 5) for k in "ab" for i in range(-7, 30, 2)], "k string, i long, v long")
    got = {(r.k, r.i): r.upto for r in stats.running_total(rows, F.col("v"), "i", ["k"]).collect()}
    assert got == {(k, i): sum(j % 5 for j in range(-7, i + 1, 2)) for k in "ab" for i in range(-7, 30, 2)}
    values = [random.Random(3).choice([1.5, 2.0, 7.25, -3.0, 100.0]) for _ in range(57)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for p in (0.0, 0.1, 0.5, 0.9, 0.99):
        assert stats.floor_quantile(frame, "x", p).first().q == sorted(values)[int(57 * p)]


def test_plate_map_clips(spark):
    reads = spark.createDataFrame([("1A1", "x")] * 5 + [("2P24", "y"), ("junk", "z"), ("1Q1", "z"), ("1A25", "z")], "well_pos string, ref_name string")
    got = demux.plate_map(reads, min_reads=3).collect()
    assert len(got) == 2 * 384 and {(r.plate, r.well, r.reads, r.clipped) for r in got if r.reads} == {(1, "A1", 5, 3), (2, "P24", 1, 1)}
    assert demux.plate_map_json(demux.plate_map(reads)).count() == 2


def test_weighted_consensus_and_deep_wells(spark, monkeypatch):
    """Counts by place over many lots equal one count of all letters; a few sure reads outweigh many doubtful ones."""
    r = random.Random(6)
    ref = "".join(r.choice("ACGT") for _ in range(40))
    rows = [("w", 0, "40M", ref[:9] + "ACGT"["CATG".index(ref[9])] + ref[10:], "I" * 9 + "$" + "I" * 30)] * 5 + [("w", 0, "40M", ref, "I" * 40)] * 2
    rows += [("w", 5, "3S10M2D20M1I2M", "TTT" + ref[5:15] + ref[17:37] + "G" + ref[37:39], None), ("v", -3, "4M", "ACGN", "IIII"), ("v", 200, "2M", "AC", "I"), ("n", None, "4M", "ACGT", None), (None, 0, "4M", "ACGT", None)]
    frame = spark.createDataFrame(rows, "well string, pos int, cigar string, read_seq string, read_qual string").repartition(3)
    want = {}
    for well, pos, cigar, bases, _ in rows:
        if well is None or pos is None:
            continue
        at, i = pos, 0
        for n, op in re.findall(r"(\d+)([MIDS])", cigar):
            for j in range(int(n)):
                if op == "I":
                    want[well, at - 1, j + 1, bases[i + j]] = want.get((well, at - 1, j + 1, bases[i + j]), 0) + 1
                elif op != "S":
                    letter = bases[i + j] if op == "M" else "-"
                    want[well, at + j, 0, letter] = want.get((well, at + j, 0, letter), 0) + 1
            at, i = at + int(n) * (op in "MD"), i + int(n) * (op in "MIS")
    got = {(x.well, x.at, x.extra, letter): x[f"n{k}"] for x in align.pile_up(frame).collect() for k, letter in enumerate(align.SYMBOLS) if x[f"n{k}"]}
    assert got == want
    assert {x.well: x.cons_seq for x in align.gapped_consensus(frame).collect()}["w"] == rows[0][3]
    sure = {x.well: (x.cons_seq, x.cons_qual) for x in align.gapped_consensus(frame, weighted=True).collect()}
    assert sure["w"][0] == ref and len(sure["w"][1]) == 40 and sure["v"][0] == "ACGNAC"
    assert align.gapped_consensus(frame.limit(0)).count() == 0


def test_counters_hand_on_what_they_hold():
    counters = align._Counters()
    letters, weights = align._SYMBOL[[65, 67, 71, 84]], [1, 2, 3, 4]
    total = {}
    for pos in (50, 0, 51, 300, 0):
        counters.add([("w", pos, [(4, "M")])], letters, align.np.array([0, 4]), align.np.array(weights))
        for j in range(4):
            total[pos + j] = total.get(pos + j, 0) + 1
        if pos == 300:
            first = list(counters.rows())
    rows = [x for b in [*first, *counters.rows()] for x in b.to_pylist()]
    assert counters.size == 0 and {p: sum(x[f"n{k}"] for x in rows if x["at"] == p for k in range(6)) for p in total} == total
