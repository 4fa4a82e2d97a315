"""BAM files against plain decompression, in ranges of any size, and failures that must be seen."""

import glob
import gzip
import os
import random
import struct

import pytest

from plateforge.sources import bam

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"
REFS = [("chr1", 1000), ("a|b", 7)]


def _rows(n, longest):
    rng = random.Random(n)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 35, 150, longest])
        bases = "".join(rng.choices("ACGTN", k=size)) or None
        qual = None if not bases or rng.random() < 0.3 else "".join(chr(33 + rng.randrange(60)) for _ in bases)
        placed = rng.random() < 0.8
        out.append((f"r{i}/1" if i % 9 else None, rng.choice([0, 16, 4]), rng.choice(["chr1", "a|b"]) if placed else None, rng.randrange(1, 900) if placed else 0, rng.randrange(60), f"{size}M2D3S" if placed and size else None, bases, qual))
    return out


def _read(frame):
    return sorted(repr(tuple(r)) for r in frame.drop("path").collect())


def test_ranges_equal_the_whole(spark, tmp_path):
    """Records longer than a block and than a range, missing fields, tasks without rows: what is read is what was written, each record once."""
    rows = _rows(700, 150_000)
    bam.write_bam(spark.createDataFrame(rows, SCHEMA).repartition(3).unionByName(spark.createDataFrame([], SCHEMA)), str(tmp_path / "x"), REFS)
    want = sorted(map(repr, rows))
    for size in (20_011, 300_007, 1 << 26):
        assert _read(bam.read_bam(spark, str(tmp_path / "x"), range_bytes=size)) == want
    # Any gzip reader sees a BAM header with its references and as many records.
    seen = 0
    for path in glob.glob(str(tmp_path / "x" / "*.bam")):
        data = gzip.decompress(open(path, "rb").read())
        assert data[:4] == b"BAM\1" and data.count(b"@SQ") == 2 and open(path, "rb").read().endswith(bam.LAST_BLOCK)
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        assert struct.unpack_from("<i", data, at)[0] == 2
        at += 4
        for name, n in REFS:
            wide = struct.unpack_from("<i", data, at)[0]
            assert data[at + 4 : at + 3 + wide].decode() == name and struct.unpack_from("<i", data, at + 4 + wide)[0] == n
            at += 8 + wide
        while at < len(data):
            at, seen = at + 4 + struct.unpack_from("<i", data, at)[0], seen + 1
    assert seen == len(rows)


def test_short_reads_of_equal_qualities(spark, tmp_path):
    """Many alike records, whose insides look like starts the most."""
    rows = [("r", 4, None, 0, 0, None, "A" * 40, None)] * 5000
    bam.write_bam(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "y"), [])
    assert _read(bam.read_bam(spark, str(tmp_path / "y"), range_bytes=1009)) == sorted(map(repr, rows))


def test_failures_are_seen(spark, tmp_path):
    bam.write_bam(spark.createDataFrame(_rows(300, 3000), SCHEMA).coalesce(1), str(tmp_path / "z"), REFS)
    (path,) = glob.glob(str(tmp_path / "z" / "*.bam"))
    whole = open(path, "rb").read()
    for name, data in (("cut.bam", whole[: len(whole) // 2]), ("text.bam", b"@HD no BAM"), ("spoilt.bam", whole[: len(whole) // 2] + b"x" + whole[len(whole) // 2 + 1 :])):
        os.makedirs(tmp_path / name)
        (tmp_path / name / name).write_bytes(data)
        for size in (30_000, 1 << 26):
            with pytest.raises(Exception, match="block|cut short|not a BAM"):
                bam.read_bam(spark, str(tmp_path / name), range_bytes=size).collect()
    # A job that fails leaves no file that a reader takes.
    with pytest.raises(Exception, match="KeyError|chr9"):
        bam.write_bam(spark.createDataFrame([("r", 0, "chr9", 1, 0, "1M", "A", "I")], SCHEMA), str(tmp_path / "w"), REFS)
    assert not glob.glob(str(tmp_path / "w" / "*.bam"))
    bam.write_bam(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), REFS)
    assert bam.read_bam(spark, str(tmp_path / "e")).count() == 0
