"""BAM files as DataFrames, and a sink that writes them.

A BAM file is a chain of compressed blocks of at most 64 KB, each with its length and
checksum. Files are read in byte ranges: a range has the records that begin in the
blocks that begin in it. Its first block is found by its mark and proven by its
checksum; its first record is the first place from which a megabyte of records follow
each other validly. Each record is checked again as it is read, and one that can't be
is an error, so a wrong start never goes unseen.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .records import RANGE_BYTES, _open, task_count

# Fixed values of the format: letters of cigar operations and of packed bases, a block's mark, the empty last block.
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
MARK = b"\x1f\x8b\x08\x04"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_HEAD = struct.Struct("<iiiBBHHHiiii")
_LOOK, _LONGEST = 1 << 20, 1 << 26
_BLOCK_BYTES = 60_000

_UNPACK = str.maketrans("0123456789abcdef", BASES)
_PACK = {c: f"{i:x}" for i, c in enumerate(BASES)}
_UP, _DOWN = bytes((i + 33) % 256 for i in range(256)), bytes((i - 33) % 256 for i in range(256))
SCHEMA = "path string, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string"


def _block(raw, at: int):
    """The offset after the block at `at`, and its bytes; None where no whole block begins."""
    raw.seek(at)
    head = raw.read(12)
    if len(head) < 12 or not head.startswith(MARK):
        return None
    wide = int.from_bytes(head[10:12], "little")
    extra, size = raw.read(wide), 0
    while len(extra) >= 4:
        n = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"BC" and n == 2:
            size = int.from_bytes(extra[4:6], "little") + 1
        extra = extra[4 + n :]
    body = raw.read(max(0, size - 12 - wide))
    if len(body) < 9 or len(body) != size - 12 - wide:
        return None
    try:
        data = zlib.decompress(body[:-8], -15)
    except zlib.error:
        return None
    return (at + size, data) if zlib.crc32(data) == int.from_bytes(body[-8:-4], "little") else None


def _header(raw, path: str):
    """Names of a file's references, and (block, place in it) of the first record."""
    at, text, starts = 0, b"", []

    def need(n):
        nonlocal at, text
        while len(text) < n:
            got = _block(raw, at)
            if got is None:
                raise ValueError(f"{path}: the header is cut short at byte {at}")
            starts.append((len(text), at))
            at, text = got[0], text + got[1]

    need(8)
    if text[:4] != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    end = 8 + int.from_bytes(text[4:8], "little")
    need(end + 4)
    names, left, end = [], int.from_bytes(text[end : end + 4], "little"), end + 4
    for _ in range(left):
        need(end + 4)
        n = int.from_bytes(text[end : end + 4], "little")
        need(end + 8 + n)
        names.append(text[end + 4 : end + 3 + n].decode())
        end += 8 + n
    if end == len(text):
        return names, at, 0
    first, block = max(s for s in starts if s[0] <= end)
    return names, block, end - first


def _size(data, at: int, refs: int):
    """Bytes of the record at a place; 0 where its fixed part or name is not all there, None where none can be."""
    if at + _HEAD.size > len(data):
        return 0
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = _HEAD.unpack_from(data, at)
    if not (-1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and n_name >= 1 and n_seq >= 0):
        return None
    if size < 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq:
        return None
    if at + 36 + n_name > len(data):
        return 0
    name = data[at + 36 : at + 35 + n_name]
    return size + 4 if data[at + 35 + n_name] == 0 and all(32 < c < 127 for c in name) else None


def _follows(data, at: int, refs: int, final: bool) -> bool:
    """Whether records follow each other from a place to the end of data, which is the file's if final."""
    whole = 0
    while at < len(data):
        size = _size(data, at, refs)
        if size is None:
            return False
        if size == 0 or at + size > len(data):
            return not final and whole > 0
        at, whole = at + size, whole + 1
    return whole > 0


def _first(raw, start: int, end: int, length: int, refs: int):
    """(block, place in it) of the first record that begins in a block that begins in the range; None if there is none."""
    raw.seek(start)
    text, at, got = raw.read(min(1 << 17, length - start)), -1, None
    while got is None:
        at = text.find(MARK, at + 1)
        if at < 0 or start + at >= end:
            return None
        got = _block(raw, start + at)
    blocks, data, own, at = [], b"", 0, start + at
    while True:
        aim = len(data) + _LOOK
        while len(data) < aim and at < length:
            got = _block(raw, at)
            if got is None:
                raise ValueError(f"no block at byte {at}")
            if at < end:
                blocks.append((len(data), at))
                own += len(got[1])
            at, data = got[0], data + got[1]
        for place in range(own):
            if _size(data, place, refs) and _follows(data, place, refs, at >= length):
                first, block = max(b for b in blocks if b[0] <= place)
                return block, place - first
        if at >= length:
            return None  # the range lies within the file's last record
        if at >= end and len(data) - own > _LONGEST:
            raise ValueError(f"no record begins between bytes {start} and {end}, nor {_LONGEST} bytes on")


def _fields(data, at: int, size: int, names: list[str]):
    _, ref, pos, n_name, mapq, _, n_ops, flag, n_seq, _, _, _ = _HEAD.unpack_from(data, at)
    at += 36
    name = data[at : at + n_name - 1].decode("ascii")
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = (n_seq + 1) // 2
    bases, marks = data[at : at + packed].hex().translate(_UNPACK)[:n_seq], data[at + packed : at + packed + n_seq]
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in ops)
    qual = None if not n_seq or marks[0] == 255 else marks.translate(_UP).decode("latin-1")
    return None if name == "*" else name, flag, names[ref] if ref >= 0 else None, pos + 1, mapq, cigar or None, bases or None, qual


def _records(batches):
    """Byte ranges (path, start, end, length) to the records that begin in them."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3]
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    for batch in batches:
        for path, start, end, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _open(path) as file:
                raw = io.BufferedReader(file, 1 << 17)
                names, at, skip = _header(raw, path)
                if start > at:
                    found = _first(raw, start, end, length, len(names))
                    if found is None:
                        continue
                    at, skip = found
                rows, held, data = [], 0, b""
                while at < end or data:
                    if at >= length:
                        if data:
                            raise ValueError(f"{path}: a record is cut short at the end of the file")
                        break
                    got = _block(raw, at)
                    if got is None:
                        raise ValueError(f"{path}: no block at byte {at}")
                    owned = at < end
                    data, place = data + got[1][skip:], 0
                    at, skip = got[0], 0
                    while place < len(data):
                        size = _size(data, place, len(names))
                        if size is None:
                            raise ValueError(f"{path}: no record in the block before byte {at}")
                        if size == 0 or place + size > len(data):
                            break
                        rows.append((path, *_fields(data, place, size, names)))
                        place, held = place + size, held + size
                        if held >= 1 << 22:
                            yield table(rows)
                            rows, held = [], 0
                        if not owned:  # what began in the range is whole now; the rest is the next one's
                            place = len(data)
                    data = data[place:]
                if rows:
                    yield table(rows)


def read_bam(spark: SparkSession, root: str, glob: str = "*.bam", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Alignments of a BAM file, or of those under a folder: read_sam()'s columns with path and mapq, places from 1, what is missing null.

    A file that ends within a block or record, or isn't BAM, is an error, and so is a
    range that lies within a record of over 64 MB. Files without
    records give no rows. Optional tags are not read, so a read of over 65,535 cigar
    operations has the stand-in that its cigar field holds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length").where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.select("path", F.explode(starts).alias("start"), "length").select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"), "length")
    return ranges.repartition(task_count(ranges)).mapInArrow(_records, SCHEMA)


def _encode(row: dict, refs: dict[str, int]) -> bytes:
    name = (row["qname"] or "*").encode("ascii") + b"\0"
    ops, n = [], 0
    for c in row["cigar"] or "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            n = 0
    bases = row["seq"] or ""
    packed = bytes.fromhex("".join(_PACK.get(c, "f") for c in bases.upper()) + "0" * (len(bases) % 2))
    marks = b"\xff" * len(bases) if row["qual"] is None else row["qual"].encode("latin-1").translate(_DOWN)
    if len(marks) != len(bases):
        raise ValueError(f"{row['qname']}: {len(bases)} bases and {len(marks)} qualities")
    ref = -1 if row["rname"] is None else refs[row["rname"]]
    # 4680 is the bin of no place: what reads in order needs none.
    body = _HEAD.pack(0, ref, (row["pos"] or 0) - 1, len(name), row.get("mapq") or 0, 4680, len(ops), row["flag"] or 0, len(bases), -1, -1, 0)[4:] + name + struct.pack(f"<{len(ops)}I", *ops) + packed + marks
    return struct.pack("<i", len(body)) + body


def _pack(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return MARK + b"\0\0\0\0\0\xff\x06\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class _Part(WriterCommitMessage):
    name: str


class _BamWriter(DataSourceArrowWriter):
    """A file a task, under a hidden name until the whole job has succeeded."""

    def __init__(self, folder: str, refs: list[tuple[str, int]]):
        self.folder, self.refs = folder.rstrip("/"), refs

    def _store(self):
        from pyarrow import fs

        at = "file://" + self.folder[5:] if self.folder.startswith("file:/") and not self.folder.startswith("file://") else self.folder
        return fs.FileSystem.from_uri(at)

    def write(self, iterator):
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        part = _Part(f"part-{uuid.uuid4().hex}.bam")
        number = {name: i for i, (name, _) in enumerate(self.refs)}
        text = "".join(f"@SQ\tSN:{name}\tLN:{n}\n" for name, n in self.refs).encode()
        data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs))
        data += b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n) for name, n in self.refs)
        with store.open_output_stream(f"{folder}/.{part.name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data += _encode(row, number)
                    while len(data) >= _BLOCK_BYTES:
                        out.write(_pack(data[:_BLOCK_BYTES]))
                        data = data[_BLOCK_BYTES:]
            out.write((_pack(data) if data else b"") + LAST_BLOCK)
        return part

    def commit(self, messages):
        store, folder = self._store()
        for part in messages:
            if part is not None:
                store.move(f"{folder}/.{part.name}", f"{folder}/{part.name}")

    def abort(self, messages):
        store, folder = self._store()
        for part in messages:
            if part is not None:
                store.delete_file(f"{folder}/.{part.name}")


class BamSink(DataSource):
    """The format "bam" of DataFrame.write: options path (a folder) and refs (JSON pairs of name and length)."""

    @classmethod
    def name(cls):
        return "bam"

    def writer(self, schema, overwrite):
        return _BamWriter(self.options["path"], json.loads(self.options["refs"]))


def write_bam(alignments: DataFrame, path: str, refs: list[tuple[str, int]]) -> None:
    """read_sam()'s columns, mapq if there, as BAM files in the folder path, one a partition, in the partition's order.

    refs are the names and lengths of the header, a list that a driver can hold as every
    BAM header's is. Only a job that succeeds has files under their names; a failed task
    leaves a hidden one at most, which no reader takes. Bases outside the format's
    letters become N.
    """
    spark = alignments.sparkSession
    spark.dataSource.register(BamSink)
    fields = [c for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual") if c in alignments.columns]
    alignments.select(*fields).write.format("bam").mode("append").option("refs", json.dumps([list(r) for r in refs])).save(path)
