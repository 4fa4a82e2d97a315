"""Barcode search, trimming and batch demultiplexing, failing files and named sinks, by brute force."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateforge.functions import seq
from plateforge.operators import barcodes
from plateforge.sources import records


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def nearest(code, text):
    """(distance, end, length): the least distance, then the first end, then the shortest substring."""
    return min((edits(code, text[e - n : e]), e, n) for e in range(len(text) + 1) for n in range(e + 1))


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def spoilt(r, code, times):
    for _ in range(times):
        at = r.randrange(max(1, len(code)))
        code = r.choice([code[:at] + r.choice("ACGT") + code[at:], code[:at] + code[at + 1 :], code[:at] + r.choice("ACGT") + code[at + 1 :]])
    return code


def test_search_is_the_least_distance_and_place():
    r = random.Random(3)
    codes = [dna(r, n) for n in (1, 7, 12, 12, 64)]
    texts = ["", "A"] + [dna(r, r.randint(0, 6)) + spoilt(r, r.choice(codes), r.randint(0, 4)) + dna(r, r.randint(0, 6)) for _ in range(40)]
    matrix, lengths = barcodes._window([t.encode() for t in texts], 90)
    best, end = barcodes.search(matrix, lengths, [c.encode() for c in codes])
    for k, code in enumerate(codes):
        begin = barcodes.starts(matrix, end[k].astype(np.int64), np.full(len(texts), k), best[k], [c.encode() for c in codes])
        for i, t in enumerate(texts):
            if len(code) == 64 and len(t) > 30 and i % 4:
                continue
            d, e, n = nearest(code, t)
            assert (best[k, i], end[k, i], end[k, i] - begin[i]) == (d, e, n), (code, t)


@pytest.mark.parametrize("ends", ["front", "either", "both"])
def test_calls_equal_brute_force(spark, ends):
    r = random.Random(7)
    kit = [(i, f"B{i}", dna(r, 10)) for i in range(5)]
    turn = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = []
    for i in range(60):
        code = kit[i % 5][2]
        front, rear = spoilt(r, code, r.randint(0, 3)) if i % 3 else "", turn(spoilt(r, kit[(i + (i % 7 == 0)) % 5][2], r.randint(0, 2))) if i % 4 else ""
        reads.append(("same", dna(r, r.randint(0, 3)) + front + dna(r, 15) + rear + dna(r, r.randint(0, 3))))
    rows = [(*x, "I" * len(x[1]) if i % 2 else None, i, "mine") for i, x in enumerate(reads)] + [("e", "", "", 60, "mine"), ("n", None, None, 61, None)]
    frame = spark.createDataFrame(rows, "read_name string, read_seq string, read_qual string, n int, idx string").repartition(3)
    found = barcodes.demultiplex(frame, spark.createDataFrame(kit, "idx int, name string, barcode string"), window=20, most=2, ends=ends)
    assert found.columns == ["read_name", "read_seq", "read_qual", "n", *barcodes.ADDED]
    got = {x.n: x for x in found.collect()}
    assert len(got) == 62
    for _, text, qual, n, _ in rows:
        text, x = text or "", got[n]
        sides = [[nearest(c, text[:20]) for *_, c in kit], [nearest(c, turn(text)[:20]) for *_, c in kit]]
        d = [a[0] if ends == "front" else (min if ends == "either" else max)(a[0], b[0]) for a, b in zip(*sides, strict=True)]
        order = sorted(range(5), key=lambda k: (d[k], k))
        clear = d[order[0]] <= 2 and d[order[1]] > d[order[0]]
        assert (x.distance, x.next_distance) == (d[order[0]], d[order[1]])
        if not clear:
            assert (x.idx, x.barcode, x.front_end, x.rear_start) == (None, "unclassified", None, None) and (x.read_seq or "") == text
            continue
        k = order[0]
        front, rear = sides[0][k], sides[1][k]
        lo = front[1] if front[0] <= 2 else None
        hi = len(text) - rear[1] if ends != "front" and rear[0] <= 2 else None
        assert (x.idx, x.barcode, x.front_end, x.rear_start) == (k, f"B{k}", lo, hi)
        assert x.front_start == (None if lo is None else lo - front[2]) and x.rear_end == (None if hi is None else hi + rear[2])
        cut = slice(lo or 0, len(text) if hi is None else max(hi, lo or 0))
        assert x.read_seq == text[cut] and x.read_qual == (qual and qual[cut])


def test_kits_and_summaries(spark):
    kit = spark.createDataFrame([(0, "FB01", "ACGTACGTAC"), (1, "FB02", "TTGGCCAATT")], "idx int, name string, barcode string")
    none = spark.createDataFrame([], "read_name string, read_seq string")
    called = barcodes.demultiplex(none, kit)
    assert called.count() == 0 and {(r.barcode, r.reads, r.share) for r in barcodes.barcode_summary(called, kit).collect()} == {("FB01", 0, 0.0), ("FB02", 0, 0.0), ("unclassified", 0, 0.0)}
    reads = spark.createDataFrame([("a", "ACGTACGTACGG"), ("b", "ACGTACGTAC" + "GGC" * 50_000), ("c", "CCC")], "read_name string, read_seq string")
    got = {r.barcode: (r.reads, round(r.share, 6), r.bases) for r in barcodes.barcode_summary(barcodes.demultiplex(reads, kit), kit).collect()}
    assert got == {"FB01": (2, 0.666667, 150_002), "FB02": (0, 0.0, 0), "unclassified": (1, 0.333333, 3)}
    for bad in ([], [(0, "x", "")], [(0, "x", "A" * 65)]):
        with pytest.raises(ValueError):
            barcodes.demultiplex(reads, spark.createDataFrame(bad, "idx int, name string, barcode string"))


def record(name, bases, qual):
    return f"@{name}\n{bases}\n+\n{qual}\n"


def test_first_reads_of_every_file(spark, tmp_path):
    import gzip

    kit = spark.createDataFrame([(0, "B0", "ACGTACGTAC")], "idx int, name string, barcode string")
    (tmp_path / "in/x").mkdir(parents=True)
    sizes = {"in/a.fastq": 90, "in/x/b.fastq": 7, "in/c.fastq.gz": 50, "in/d.fastq": 0}
    for name, n in sizes.items():
        text = "".join(record(f"r{i}", "ACGTACGTAC" * (i % 3 > 0) + "GG" * (i % 5), "I" * (10 * (i % 3 > 0) + 2 * (i % 5))) for i in range(n))
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    found = barcodes.batch_demux(spark, f"{tmp_path}/in", kit, 20, range_bytes=333)
    assert {(r.source_file, r.n, r.last) for r in found.groupBy("source_file").agg(F.count("*").alias("n"), F.max("rec").alias("last")).collect()} == {("a", 20, 19), ("b", 7, 6), ("c.fastq", 20, 19)}
    assert barcodes.batch_demux(spark, f"{tmp_path}/in/a.fastq", kit, range_bytes=100).count() == 90
    barcodes.write_demux(found, f"{tmp_path}/out")
    again = records.read_fastq(spark, f"{tmp_path}/out", "*.txt").groupBy(F.regexp_extract("path", "source_file=([^/]+)/barcode=([^/]+)", 2).alias("b")).count().collect()
    assert {r.b: r["count"] for r in again} == {r.barcode: r["count"] for r in found.groupBy("barcode").count().collect()}


@pytest.mark.parametrize("size", [20, 45, 10_000])
def test_files_end_at_their_first_failure(spark, tmp_path, size):
    for side, lot, bad in (("fbc", "barcode01", 12), ("fbc", "barcode02", None), ("rbc", "barcode03", 2), ("refs/fwd", "x", None), ("refs/rev", "x", 4), ("fbc", "unclassified", 0)):
        (tmp_path / side / lot).mkdir(parents=True)
        text = "".join(record(f"r{i}|ref=g{i % 2}", "ACG", "II" if i == bad else "III") for i in range(20))
        (tmp_path / side / lot / "f.fastq").write_text(text + record(" ", "A", "I") if side == "refs/fwd" else text)
    reads, failures = records.create_read_df(spark, str(tmp_path), range_bytes=size)
    got = {r.read_name: (r.fbc, r.rbc, r.ref_name) for r in reads.collect()}
    assert got == {f"r{i}": (1, 2 if i < 2 else None, f"{'rev' if i < 4 else 'fwd'}:g{i % 2}") for i in range(20)}
    assert {(r.kind, r.files) for r in failures.collect()} == {("fbc", 1), ("rbc", 1), ("ref", 1)}
    names = records.read_names(records.read_fastq(spark, f"{tmp_path}/refs", range_bytes=size), skip_failing=True).first()
    assert (names.names, names.malformed) == (20, 1)


def test_named_files(spark, tmp_path):
    rows = [(w, f"@{w}{i}", i) for w in ("1A1", "2B2", "w/ x") for i in range(50)] + [(None, "lost", 0)]
    df = spark.createDataFrame(rows, "name string, value string, n int").repartition(7)
    for _ in range(2):  # the second time over the first's files
        assert records.write_named(df, f"file://{tmp_path}/wells", ".fastq", order=("n",)) == ["1A1.fastq", "2B2.fastq", "w%2F x.fastq"]
    assert (tmp_path / "wells/1A1.fastq").read_text().split() == [f"@1A1{i}" for i in range(50)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["wells"]
    records.write_named(df.where("name = '2B2'"), f"file://{tmp_path}/maps", ".csv", header="read", order=("n",))
    assert (tmp_path / "maps/2B2.csv").read_text().split() == ["read"] + [f"@2B2{i}" for i in range(50)]


def test_turned_letters():
    assert bytes(barcodes._TURN[np.frombuffer(b"ACGTN", np.uint8)][::-1]).decode() == "NACGT" and len(seq.IUPAC) == len(seq.COMPLEMENT)


def test_files_that_arrive_are_read_once(spark, tmp_path):
    """Two runs of a streamed query over a growing folder have every record of each file once, as a whole read has them."""
    def add(i):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{i}.fastq").write_text("".join(f"@r{i}.{j}\nACGT\n+\n{'III' if j == 3 else 'IIII'}\n" for j in range(5)) + "@cut\nAC\n")
        with gzip.open(tmp_path / "in" / f"g{i}.fastq.gz", "wt") as f:
            f.write(f"@g{i}\nA\n+\nI\n")

    def run():
        rows = records.stream_fastq(spark, str(tmp_path / "in"), max_files=3)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect()))

    for i in range(4):
        add(i)
    assert len(run()) == 4 * 7
    add(4)
    found = run()
    assert found == sorted(map(repr, records.read_fastq(spark, str(tmp_path / "in")).collect())) and len(found) == 5 * 7


@pytest.mark.parametrize("size", [11, 333])
def test_short_ranges_share_tasks(spark, tmp_path, size):
    """Tasks are dealt by bytes: thousands of short ranges are few tasks, with the same records."""
    (tmp_path / "a.fastq").write_text("".join(record(f"r{i}", "A" * (i % 9), "I" * (i % 9)) for i in range(2000)))
    rows = records.read_fastq(spark, str(tmp_path), range_bytes=size)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((r.rec, r.read_id, len(r.seq)) for r in rows.collect()) == [(i, f"r{i}", i % 9) for i in range(2000)]


def test_tasks_grow_with_bytes(spark):
    """Not with the number of ranges; compressed bytes weigh more, and a few ranges get a task each."""
    cores = spark.sparkContext.defaultParallelism
    ranges = lambda n, size, name: spark.range(n).select(F.lit(name).alias("path"), (F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("end"))
    tasks = lambda *x: records.task_count(ranges(*x))
    assert tasks(100_000, 10_000, "a.txt") == -(-10**9 // records.TASK_BYTES) and tasks(100, 10**7, "b.txt.gz") == 100
    assert tasks(5000, 10, "c") == cores and tasks(1, 10, "c") == 1 and tasks(0, 10, "c") == 1


def test_summary_passes_over_the_reads_once(spark):
    """Kit names without reads, groups of their own, and reads that are made once."""
    kit = spark.createDataFrame([("B0",), ("B1",)], "name string")
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(1, "B0", 2, "ACG"), (1, "B0", 4, "A"), (1, "unclassified", None, None), (2, "B1", 1, "AC")], "lot int, barcode string, distance int, read_seq string")
    found = barcodes.barcode_summary(rows.mapInArrow(seen, rows.schema), kit, ("lot",)).collect()
    assert made.value == 4
    assert {(r.lot, r.barcode, r.reads, round(r.share, 3), r.mean_distance, r.bases) for r in found} == {
        (1, "B0", 2, 0.667, 3.0, 4), (1, "B1", 0, 0.0, None, 0), (1, "unclassified", 1, 0.333, None, 0), (2, "B0", 0, 0.0, None, 0), (2, "B1", 1, 1.0, 1.0, 2), (2, "unclassified", 0, 0.0, None, 0)
    }
    assert sorted((r.barcode, r.reads) for r in barcodes.barcode_summary(rows.limit(0), kit).collect()) == [("B0", 0), ("B1", 0), ("unclassified", 0)]


def test_records_are_cut_like_their_text(spark, tmp_path):
    """Blocks of plain records are cut as arrays, others as text: either way these records, in any ranges; odd ones alone on demand; ids cut in the tasks."""
    heads = ["r0|ref=g1 x", "r1\tb", " r2", "", " ", "r5/1", "\x1c", "r7\x0bq"]
    text = "".join(record(h, "ACG"[: i % 4], "I" * (i % 4 + (i == 5))) for i, h in enumerate(heads))
    expected = [(i, re.split(r"[ \t\x0b]", h)[0], h, "ACG"[: i % 4], "I" * (i % 4 + (i == 5)), i == 5 or not h.strip(), i == 5) for i, h in enumerate(heads)]
    for name, body in {"plain": text, "returns": text.replace("\n", "\r\n"), "wide": text.replace("q\n", "é\n")}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.fastq").write_bytes(body.encode())
        wanted = [tuple(x.replace("q", "é") if name == "wide" and isinstance(x, str) else x for x in r) for r in expected]
        for size in (7, 10_000):
            rows = records.read_fastq(spark, str(tmp_path / name), range_bytes=size)
            assert sorted(tuple(r)[1:] for r in rows.collect()) == wanted
            odd = records.read_fastq(spark, str(tmp_path / name), range_bytes=size, odd=True)
            assert sorted(tuple(r)[1:] for r in odd.collect()) == [r for r in wanted if r[-1] or not r[3]]
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_taken_in_the_order_of_their_paths(spark, tmp_path):
    """f.fastq0 comes after f.fastq; an end that is no broken record is found too, and failures are those of the odd records."""
    for path, text in {"fbc/barcode02/f.fastq": record("r0", "A", "I"), "rbc/barcode03/f.fastq": record("r0", "A", "I") + record("r1", "A", ""), "refs/fwd/f.fastq": record("r0|ref=g1", "A", "I"), "refs/fwd/f.fastq0": record("r0|ref=g2", "C", "I") + record("r1|ref=g2", "", "") + record("r2|ref=g2", "C", "I"), "refs/rev/none.fastq": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    reads, failures = records.create_read_df(spark, str(tmp_path))
    assert [(r.read_name, r.fbc, r.rbc, r.ref_name, r.read_seq) for r in reads.collect()] == [("r0", 1, 2, "fwd:g2", "C")]
    assert {(r.kind, r.files) for r in failures.collect()} == {("fbc", 0), ("rbc", 1), ("ref", 1)}
    read = lambda odd: records.read_fastq(spark, f"{tmp_path}/rbc", odd=odd)
    assert records.read_names(read(False), True, read(True)).first() == records.read_names(read(False), True).first() == (0, 0)


@pytest.mark.parametrize("size", [9, 10_000])
def test_tree_is_passed_over_once(spark, tmp_path, size):
    """Names and malformed records of whole files and the ends of all kinds, from one scan: records are framed once more, without their texts, and files that end early not at all."""
    good, bad = record("r0/1 x", "A", "I") + record(" ", "A", "I") + record("r1", "", ""), record("r2", "AC", "I")
    for path, text in {"fbc/barcode01/a.fastq": good, "fbc/unclassified/a.fastq": good.replace("r0", "r7"), "fbc/unclassified/b.fastq": bad, "fbc/barcode02/a.fastq": record("r3", "A", "I") + bad + good, "refs/fwd/a.fastq": good + record("r1|ref=g", "", ""), "rbc/x/a.fastq": bad, "refs/rev/b.fastq": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    tree = records.scan_tree(spark, str(tmp_path), range_bytes=size)
    names = records.tree_names(tree)
    assert names._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in names.collect()} == {("fbc", 3, 2), ("rbc", 0, 0), ("ref", 3, 1)}
    for kind, side in (("fbc", "fbc"), ("rbc", "rbc"), ("ref", "refs")):
        assert records.read_names(records.read_fastq(spark, f"{tmp_path}/{side}", range_bytes=size), skip_failing=True).first() == names.where(F.col("kind") == kind).drop("kind").first()
    assert {tuple(r) for r in records.tree_failures(tree).collect()} == {("fbc", 1), ("rbc", 0), ("ref", 1)}


def test_tree_failures_frames_its_files_once(spark):
    from plateforge.plans import catalog

    found = catalog.queries()["tree_failures"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
