"""FASTQ, FASTA, SAM and barcode tables as DataFrames, and their sinks.

FASTQ files are found by Spark's own listing and read in byte ranges, so a file of
any size is many tasks and a worker holds one batch of records. A task has
neighbouring ranges of about as many bytes as any other. Framing is by four lines,
exactly: a first pass counts the line ends of each range of a file that has
several, so every range knows the number of its first line. Compressed files are
one range each, read as a stream.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage
from ..functions import seq
from ..functions.stats import once

RANGE_BYTES = 64 << 20
BATCH_RECORDS = 5000
#: Bytes that are framed at a time, and those of the ranges that one task takes; a compressed byte counts as so many.
CHUNK, TASK_BYTES, PACKED = 1 << 18, 16 << 20, 4
# Fixed value: the name that barcode records begin with.
KIT = "LevSeq"


def find_fastq(spark: SparkSession, root: str, include_gz: bool = True) -> DataFrame:
    """Paths of FASTQ files under root; without include_gz only names that end in fastq."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*fastq*").load(root).select("path")
    return rows if include_gz else rows.where(F.col("path").endswith("fastq"))


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class _LastFile:
    """The file that was opened last: ranges come in the order of their files, so each is opened once a task."""

    def __init__(self):
        self.path = self.file = None

    def open(self, path: str):
        if path != self.path:
            if self.file is not None:
                self.file.close()
            self.path, self.file = path, _open(path)
        return self.file


def _weight() -> Column:
    return F.when(F.col("path").endswith(".gz"), PACKED).otherwise(1)


def _load(ranges: DataFrame) -> tuple[int, int]:
    """Tasks for ranges, and the bytes that these share."""
    n, size = ranges.agg(F.count("*"), F.sum((F.col("end") - F.col("start")) * _weight())).first()
    size = size or 0
    return max(1, min(n, 100_000, max(ranges.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))), size


def task_count(ranges: DataFrame) -> int:
    """Tasks for ranges (path, start, end): by their bytes, and by the cores where these are few; never more than ranges.

    A range is where a file may be cut, however short; a task takes as many as fill it,
    so that tasks grow with the bytes and not with the cuts.
    """
    return _load(ranges)[0]


def _count_lines(batches):
    """Ranges (path, start, end, alone, ...) with their line ends; a range that is alone needs none."""
    files = _LastFile()
    for batch in batches:
        found = []
        for path, start, end, alone in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "alone")), strict=True):
            n = 0
            if not alone:
                f = files.open(path)
                f.seek(start)
                left = end - start
                while left > 0 and (part := f.read(min(left, 1 << 20))):
                    n += part.count(b"\n")
                    left -= len(part)
            found.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "lines"])


_RECORD = "path string, rec long, read_id string, header string, seq string, qual string, malformed boolean, broken boolean"


_FIELDS = dict(c.split(" ") for c in _RECORD.split(", "))
_NAMES = tuple(_FIELDS)
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
#: What str.strip() takes from ASCII text.
_BLANK = np.isin(np.arange(128), [*range(9, 14), *range(28, 33)])
#: What ends a read's id in its header.
_SPACE = " \t\n\x0b\f\r"
_ENDS_ID = np.isin(np.arange(128), [ord(c) for c in _SPACE])


def _texts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that lie in data at starts."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    places = np.repeat((starts - offsets[:-1]).astype(np.int32), lengths)
    places += np.arange(offsets[-1], dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])])


def _plain_records(path: str, rec: int, part: bytes, odd: bool, names: tuple[str, ...]) -> pa.RecordBatch | None:
    """Whole ASCII records without carriage returns, the first with number rec, cut at their line ends as arrays; with odd, as _frame says."""
    data = np.frombuffer(part, np.uint8)
    ends = np.flatnonzero(data == 10)
    if data[-1] != 10:
        ends = np.append(ends, len(data))
    starts = np.append(0, ends[:-1] + 1)
    size = (ends - starts).reshape(-1, 4)
    head, plus = starts[0::4], starts[2::4]
    broken = (data[head] != ord("@")) | (data[plus] != ord("+")) | (size[:, 1] != size[:, 3])
    kept = broken | (size[:, 1] == 0) if odd else None
    if odd and not kept.any():
        return None
    long = np.maximum(size[:, 0] - 1, 0)
    n = len(long)

    def ids():
        spaces = np.append(np.flatnonzero(_ENDS_ID[data]), len(data))
        return np.minimum(spaces[np.searchsorted(spaces, head + 1)] - head - 1, long)

    def malformed():
        blank = long == 0
        for i in np.flatnonzero(~blank & _BLANK[data[np.minimum(head + 1, len(data) - 1)]]):
            blank[i] = _BLANK[data[head[i] + 1 : ends[4 * i]]].all()
        return pa.array(broken | blank)

    columns = {
        "path": lambda: pa.repeat(path, n), "rec": lambda: pa.array(np.arange(rec, rec + n)), "read_id": lambda: _texts(data, head + 1, ids()), "header": lambda: _texts(data, head + 1, long),
        "seq": lambda: _texts(data, starts[1::4], size[:, 1]), "qual": lambda: _texts(data, starts[3::4], size[:, 3]), "malformed": malformed, "broken": lambda: pa.array(broken),
    }
    rows = pa.RecordBatch.from_arrays([columns[c]() for c in names], names=list(names))
    return rows.filter(pa.array(kept)) if odd else rows


def _any_records(path: str, rec: int, part: bytes, n: int, odd: bool, names: tuple[str, ...]) -> pa.RecordBatch:
    """n lines of any text as records, the last of which may be cut short."""
    lines = [x.rstrip("\r") for x in part.decode("utf-8", "ignore").split("\n")][:n]
    lines += [None] * (-len(lines) % 4)
    heads, bases, plus, quals = (lines[i::4] for i in range(4))
    broken = [q is None or not h.startswith("@") or not p.startswith("+") or len(b) != len(q) for h, b, p, q in zip(heads, bases, plus, quals, strict=True)]
    heads = [h[1:] for h in heads]
    malformed = [b or not h.strip() for h, b in zip(heads, broken, strict=True)]
    ids = [re.split(f"[{_SPACE}]", h, maxsplit=1)[0] for h in heads]
    columns = dict(zip(_NAMES, ([path] * len(heads), range(rec, rec + len(heads)), ids, heads, bases, quals, malformed, broken), strict=True))
    rows = pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[_FIELDS[c]]) for c in names], names=list(names))
    return rows.filter(pa.array([b or not s for b, s in zip(broken, bases, strict=True)])) if odd else rows


def _frame(odd: bool = False, names: tuple[str, ...] = _NAMES, keys: tuple[str, ...] = ()):
    """Ranges (path, start, end, line: that of their start, most: records of the file, or null for all) to the records whose first line begins in them.

    odd: only to those that are broken or have no letters. names are the records' columns, keys those of the ranges that they get.
    """

    def run(batches):
        files, out, held = _LastFile(), [], 0
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "line", "most")), strict=True)
            for i, (path, start, end, line, most) in enumerate(places):
                packed, raw = path.endswith(".gz"), files.open(path)
                raw.seek(max(start - 1, 0))
                # No more is read ahead than a short range has.
                text = io.BufferedReader(gzip.GzipFile(fileobj=raw), CHUNK) if packed else io.BufferedReader(raw, max(8192, min(1 << 20, end - start)))
                at = start
                if start:  # the line that the range before began is its own
                    skipped = text.readline()
                    at += len(skipped) - 1
                    line += skipped != b"\n"
                while line % 4 and (skipped := text.readline()):
                    at, line = at + len(skipped), line + 1
                while (packed or at < end) and (most is None or line < 4 * most):
                    # Whole lines, the last of which begins before the end, and what its record lacks.
                    part = text.read(CHUNK if packed else min(CHUNK, end - at))
                    if not part:
                        break
                    if not part.endswith(b"\n"):
                        part += text.readline()
                    n = part.count(b"\n") + (not part.endswith(b"\n"))
                    while n % 4 and (more := text.readline()):
                        part, n = part + more, n + 1
                    at += len(part)
                    if most is not None and n > (left := 4 * most - line):
                        part, n = b"".join(io.BytesIO(part).readlines()[:left]), left
                    plain = n % 4 == 0 and part.isascii() and b"\r" not in part
                    rows = _plain_records(path, line // 4, part, odd, names) if plain else _any_records(path, line // 4, part, n, odd, names)
                    line += n + -n % 4
                    if rows is not None and rows.num_rows:
                        given = [pa.repeat(batch.column(c)[i], rows.num_rows) for c in keys]
                        out.append(pa.RecordBatch.from_arrays([*rows.columns, *given], names=[*names, *keys]))
                        held += rows.num_rows
                    if held >= BATCH_RECORDS:
                        yield pa.concat_batches(out)
                        out, held = [], 0
                if not packed:
                    text.detach()  # the file stays open for its next range
        if out:
            yield pa.concat_batches(out)

    return run


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


@dataclass(frozen=True)
class Ranges:
    """Byte ranges (path, start, end, line, most, task, ...) of files and the number of tasks that they are dealt to; rows may lose ranges and get columns."""

    rows: DataFrame
    tasks: int


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("path", "start")


def cut_files(files: DataFrame, range_bytes: int = RANGE_BYTES, max_reads: int | None = None) -> Ranges:
    """Ranges of files (path, length, ...) with the numbers of their first lines. A task has neighbouring ranges, and about as many bytes as any other."""
    keys = [c for c in files.columns if c not in ("path", "length")]
    whole = F.col("path").endswith(".gz") | (F.col("length") <= range_bytes)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    # The bytes before each file: one row a file, of files that the driver has listed.
    before = F.coalesce(F.sum(F.col("length") * _weight()).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = lambda rows: rows.select("*", whole.alias("alone"), F.explode(starts).alias("start")).withColumn("end", F.when(F.col("alone"), F.col("length")).otherwise(F.least(F.col("start") + range_bytes, "length")))
    tasks, size = _load(cut(files))
    task = F.least(F.floor((F.col("before") + F.col("start") * _weight()) / max(size, 1) * tasks), F.lit(tasks - 1)).cast("int")
    ranges = cut(files.withColumn("before", before)).select("path", "start", "end", "alone", task.alias("task"), *keys)
    counted = _dealt(ranges, tasks).mapInArrow(_count_lines, StructType([*ranges.schema.fields]).add("lines", "long"))
    line = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    framed = counted.select("path", "start", "end", line.alias("line"), F.lit(max_reads).cast("long").alias("most"), "task", *keys)
    return Ranges(framed if max_reads is None else framed.where("line < 4 * most"), tasks)


def read_ranges(ranges: Ranges, odd: bool = False, columns: tuple[str, ...] = _NAMES, keys: tuple[str, ...] = ()) -> DataFrame:
    """The records of ranges, with these of read_fastq()'s columns and of the ranges' own: those left out are never made."""
    rows = ranges.rows.select("path", "start", "end", "line", "most", "task", *keys)
    schema = StructType()
    for c in columns:
        schema.add(c, _FIELDS[c])
    for c in keys:
        schema.add(rows.schema[c])
    return _dealt(rows, ranges.tasks).mapInArrow(_frame(odd, tuple(columns), tuple(keys)), schema)


def read_fastq(spark: SparkSession, root: str, glob: str = "*.{fastq,fq}*", range_bytes: int = RANGE_BYTES, max_reads: int | None = None, odd: bool = False, columns: tuple[str, ...] = _NAMES) -> DataFrame:
    """(path, rec, read_id, header, seq, qual, malformed, broken) of every record of a file, or of the files under a folder, .gz included.

    A record that is cut short, lacks its marks or has unequal lengths is broken; that
    or an empty name makes it malformed. Both are flags: nothing is dropped. max_reads takes the first records of each file; ranges that begin after
    them are not framed. odd gives only those records that are broken or have no letters: what
    ends a file is among them, and the others never leave the tasks that look for it.
    columns: those that are wanted; the others are not cut out of the text.
    """
    return read_ranges(cut_files(_files(spark, root, glob), range_bytes, max_reads), odd, columns)


def first_failures(fastq: DataFrame, fails: Column | None = None) -> DataFrame:
    """(path, first_bad): the first broken record of each file that has any, over all its byte ranges; one row a failing file."""
    return fastq.where(F.col("broken") if fails is None else fails).groupBy("path").agg(F.min("rec").alias("first_bad"))


def until_failure(fastq: DataFrame, fails: Column | None = None) -> DataFrame:
    """The records of each file before its first broken one, as a reader that stops there has them. fails: another test than `broken`."""
    # A row a failing file, of files that the driver has listed; the records stay where they are.
    return fastq.join(F.broadcast(first_failures(fastq, fails)), "path", "left").where("first_bad is null or rec < first_bad").drop("first_bad")


def malformed_files(fastq: DataFrame) -> DataFrame:
    """(path, malformed): files with any malformed record, and how many."""
    return fastq.groupBy("path").agg(F.count_if("malformed").alias("malformed")).where("malformed > 0")


def first_reads(fastq: DataFrame, n: int = 1000) -> DataFrame:
    return fastq.orderBy("path", "rec").limit(n)


def count_reads(fastq: DataFrame) -> DataFrame:
    return fastq.agg(F.count("*").alias("n"))


def read_names(fastq: DataFrame, skip_failing: bool = False, odd: DataFrame | None = None) -> DataFrame:
    """One row: distinct names, and malformed records. With skip_failing, a file with a broken record counts for neither; nameless records still count as malformed.

    odd: the same files read with odd=True, so that failures are found without passing over all records twice.
    """
    rows = fastq.join(F.broadcast(first_failures(fastq if odd is None else odd)), "path", "left_anti") if skip_failing else fastq
    return rows.agg(F.countDistinct(F.when(~F.col("malformed"), F.col("read_id"))).alias("names"), F.count_if("malformed").alias("malformed"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, ref_seq): records split at '>', sequence lines joined."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    return text.select(F.split(lines[0], r"\s+")[0].alias("ref_id"), F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""), r"\s", "").alias("ref_seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text; '*' is null. flag & 4 marks unmapped."""
    cells = F.split("value", "\t")
    star = lambda i: F.nullif(cells[i], F.lit("*"))
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(cells) >= 11))
    return rows.select(cells[0].alias("qname"), cells[1].cast("int").alias("flag"), star(2).alias("rname"), cells[3].cast("int").alias("pos"), star(5).alias("cigar"), star(9).alias("seq"), star(10).alias("qual"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, barcode) of a barcode CSV (name, refseq); idx is the row's place. A kit is one small file."""
    rows = spark.read.option("header", "true").csv(path).withColumnRenamed("refseq", "barcode").coalesce(1)
    return rows.select(F.monotonically_increasing_id().cast("int").alias("idx"), "name", "barcode")


def tagged_fastq(sam: DataFrame, direction: str | None = None) -> DataFrame:
    """FASTQ text lines of mapped reads, the id tagged with the reference; reverse reads turn back to read orientation."""
    mapped = sam.where((F.col("flag").bitwiseAND(4) == 0) & (F.length("seq") > 0))
    qual = seq.fill_quality("qual", "seq")
    turned = direction == "reverse"
    bases: Column = seq.reverse_complement("seq") if turned else F.col("seq")
    return mapped.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname"), F.lit("|ref="), F.col("rname")), bases, F.lit("+"), F.reverse(qual) if turned else qual).alias("value"))


def record_text() -> Column:
    """The four lines of a record of (read_name, read_seq, read_qual); a missing sequence is empty."""
    bases = F.coalesce("read_seq", F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce("read_name", F.lit(""))), bases, F.lit("+"), seq.fill_quality("read_qual", bases))


def fastq_text(reads: DataFrame) -> DataFrame:
    return reads.select(record_text().alias("value"))


def write_well_fastq(reads: DataFrame, path: str) -> None:
    """One folder per well; rows of a well are written where they are, without a shuffle. Null wells have no file."""
    rows = reads.where("well_pos is not null")
    rows.select("well_pos", record_text().alias("value")).write.partitionBy("well_pos").text(path)


def barcode_fasta(barcodes: DataFrame, side: str) -> DataFrame:
    """FASTA text of a kit; side is fbc or rbc, numbers start at 01."""
    return barcodes.select(F.concat(F.format_string(f">{KIT}-{side}-%02d\n", F.col("idx") + 1), "barcode").alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", "true").csv(path)


def write_named(df: DataFrame, path: str, suffix: str = "", header: str | None = None, order: tuple[str, ...] = ()) -> list[str]:
    """Text of df (name, value, ...) as one file a name, `<name><suffix>` in the folder path; gives the names of the files.

    The rows of a name go to one task, in the order of the `order` columns, and are
    written by Spark's own committer to a folder beside, so a task that fails or runs
    twice leaves nothing; only whole files are then moved to their names, over any older
    ones. header is each file's first line. Names are few (wells, kits, maps); null has
    no file.
    """
    spark = df.sparkSession
    rows = df.where("name is not null").withColumn("_first", F.lit(1))
    if header is not None:
        heads = rows.select("name").distinct()
        rows = rows.unionByName(heads.select("name", F.lit(header).alias("value"), F.lit(0).alias("_first")), allowMissingColumns=True)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.repartition("name").sortWithinPartitions("name", "_first", *order).select("name", "value").write.partitionBy("name").text(beside)
    where = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    store = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where(path))
    found = []
    for folder in store.listStatus(where(beside)):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().removeprefix("name=")).replace("/", "%2F")
            parts = [f.getPath() for f in store.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise RuntimeError(f"{name} was written as {len(parts)} files; spark.sql.files.maxRecordsPerFile must be unset")
            target = where(f"{path.rstrip('/')}/{name}{suffix}")
            store.delete(target, False)
            store.rename(parts[0], target)
            found.append(f"{name}{suffix}")
    store.delete(where(beside), True)
    return sorted(found)


SIDES = ("fbc", "rbc", "refs/fwd", "refs/rev")
_KIND = "if(side like 'refs/%', 'ref', side)"


@dataclass(frozen=True)
class Tree:
    """A demultiplexed tree: the ranges of all its files with their side, and its odd records (path, side, rec, read_id, seq, broken). Both are kept, so each pass over the files is made once."""

    ranges: Ranges
    odd: DataFrame


def scan_tree(spark: SparkSession, root: str, glob: str = "*.fastq*", range_bytes: int = RANGE_BYTES) -> Tree:
    """The files of fbc/, rbc/ and refs/{fwd,rev}/ under root, their lines counted and their odd records found, at the call."""
    found = cut_files(reduce(DataFrame.union, (_files(spark, f"{root}/{n}", glob).withColumn("side", F.lit(n)) for n in SIDES)), range_bytes)
    found = replace(found, rows=storage.keep(found.rows))
    return Tree(found, storage.keep(read_ranges(found, True, ("path", "rec", "read_id", "seq", "broken"), ("side",))))


def _ends(tree: Tree) -> DataFrame:
    """(path, side, first_bad): the files of read assembly that end at a record, and its number. A tagged record without letters has no mean quality and ends its file like a broken one."""
    tagged = (F.length("seq") == 0) & seq.ref_tag("read_id").isNotNull() & seq.normalize_id("read_id").isNotNull()
    return tree.odd.where(_assembled()).where(F.col("broken") | F.col("side").startswith("refs/") & tagged).groupBy("path", "side").agg(F.min("rec").alias("first_bad"))


def _assembled() -> Column:
    return F.col("side").startswith("refs/") | ~F.col("path").contains("unclassified") & seq.barcode_index("path").isNotNull()


def _kinds(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ("fbc", "rbc", "ref")))).alias("kind"))


def tree_names(tree: Tree) -> DataFrame:
    """(kind, names, malformed): read_names() with skip_failing of all the files of each side, in one pass; files with a broken record are not read."""
    whole = tree.ranges.rows.join(F.broadcast(first_failures(tree.odd)), "path", "left_anti").withColumn("kind", F.expr(_KIND))
    rows = read_ranges(replace(tree.ranges, rows=whole), columns=("read_id", "malformed"), keys=("kind",))
    found = rows.groupBy("kind").agg(F.countDistinct(F.when(~F.col("malformed"), F.col("read_id"))).alias("names"), F.count_if("malformed").alias("malformed"))
    return _kinds(tree.odd.sparkSession).join(found, "kind", "left").select("kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("names", "malformed")))


def tree_failures(tree: Tree) -> DataFrame:
    """(kind, files): the files of fbc, rbc and ref that end at a broken record."""
    found = _ends(tree).groupBy(F.expr(_KIND).alias("kind")).agg(F.count("*").alias("files"))
    return _kinds(tree.odd.sparkSession).join(found, "kind", "left").select("kind", F.coalesce("files", F.lit(0)).alias("files"))


def demux_tree(spark: SparkSession, root: str, glob: str = "*.fastq*", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three sides of read assembly from fbc/, rbc/ and refs/{fwd,rev}/ under root, each file up to its first broken record."""
    return _sides(scan_tree(spark, root, glob, range_bytes))


def _sides(tree: Tree) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranges = tree.ranges.rows.where(_assembled())
    # One row a file, of files that the driver has listed: numbered once in their order, so that a record's place is two numbers.
    files = ranges.select("side", "path").distinct().withColumn("file", F.row_number().over(Window.orderBy("side", "path")))
    ends = files.join(F.broadcast(_ends(tree)), ["side", "path"], "left").select("path", "file", "first_bad")
    # What comes after a file's failure is not framed.
    known = ranges.drop("most").join(F.broadcast(ends), "path").withColumnRenamed("first_bad", "most").where("most is null or line < 4 * most").withColumn("idx", seq.barcode_index("path"))
    read = lambda which, columns, keys: read_ranges(replace(tree.ranges, rows=known.where(which)), columns=("rec", "read_id", *columns), keys=("file", *keys)).withColumn("ord", F.struct("file", "rec"))
    name = once(seq.normalize_id("read_id"))
    side = lambda which: read(F.col("side") == which, (), ("idx",)).select(name.alias("read_name"), "ord", "idx").where("read_name is not null")
    tagged = read(F.col("side").startswith("refs/"), ("seq", "qual"), ("side",)).withColumn("tag", once(seq.ref_tag("read_id"))).where("tag is not null").withColumn("read_name", name).where("read_name is not null")
    refs = tagged.select("read_name", "ord", seq.with_direction(F.substring_index("side", "/", -1), "tag").alias("ref_name"), F.col("seq").alias("read_seq"), F.col("qual").alias("read_qual"))
    return side("fbc"), side("rbc"), refs


def create_read_df(spark: SparkSession, root: str, glob: str = "*.fastq*", range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(reads, failures) of a demultiplexed tree: reads as of assemble_reads(); failures (kind, files) has the files of fbc, rbc and ref that end at a broken record.

    fbc and rbc numbers come from the first barcodeNN of a path; paths with
    "unclassified" or no number are passed over. A name's last record wins, in the
    order of (direction,) path and place in the file. Records before a file's failure
    stay, later ones are not read.
    """
    from ..operators.demux import assemble_reads

    tree = scan_tree(spark, root, glob, range_bytes)
    return assemble_reads(*_sides(tree)), tree_failures(tree)


def stream_fastq(spark: SparkSession, root: str, glob: str = "*.{fastq,fq}*", max_files: int = 1000) -> DataFrame:
    """read_fastq()'s columns of FASTQ files that arrive under root, as a stream: each file once, max_files a batch at most.

    Spark's file source keeps what has been seen in the query's checkpoint. A file is
    framed by one task as a stream of records, so files should arrive whole (written
    elsewhere, then moved) and in the sizes of a sequencer's chunks.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(root)
    whole = files.select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(0).cast("long").alias("line"), F.lit(None).cast("long").alias("most"))
    return whole.mapInArrow(_frame(), _RECORD)
