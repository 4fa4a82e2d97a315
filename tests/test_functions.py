"""Golden values of sequences, wells, costs and records."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateforge.functions import seq, stats
from plateforge.operators import costs, demux, simulate
from plateforge.sources import records
from plateforge.streaming.wells import well_depths


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_wells(spark):
    pairs = [("FB01", "RB01", "1A1"), ("FB01", "RB02", "1A2"), ("FB01", "RB03", "1B1"), ("FB01", "RB04", "1B2"), ("FB12", "RB01", "1A23"), ("FB13", "RB05", "2C1"), ("FB96", "RB32", "8P24"), ("FB97", "RB01", None), (None, "RB01", None)]
    rows = spark.createDataFrame(pairs, "f string, r string, w string").select("w", seq.barcode_to_well("f", "r").alias("got")).collect()
    assert [r.got for r in rows] == [r.w for r in rows]
    grid = spark.range(96).select(F.format_string("FB%02d", F.col("id") + 1).alias("f")).crossJoin(spark.range(32).select(F.format_string("RB%02d", F.col("id") + 1).alias("r")))
    assert grid.select(seq.barcode_to_well("f", "r").alias("w")).distinct().count() == 3072


def test_strings(spark):
    ids = [("r1|ref=abc", "r1"), ("r1/1", "r1"), ("r1_pool_plates_x", "r1"), ("r1 desc", "r1"), ("", None), (None, None)]
    rows = spark.createDataFrame(ids, "a string, b string").select("b", seq.normalize_id("a").alias("got")).collect()
    assert [r.got for r in rows] == [r.b for r in rows]
    r = one(spark, q=seq.mean_quality(F.lit("II!")), rc=seq.reverse_complement(F.lit("ACGTN")), t=seq.translate_codons(F.lit("ATGGCCTAAN")), x=seq.translate_codons(F.lit("ANG")), f=seq.fill_quality(F.lit(""), F.lit("ACG")), e=seq.phred_encode(F.array(F.lit(40), F.lit(0))))
    assert (round(r.q, 6), r.rc, r.t, r.x, r.f, r.e) == (26.666667, "NACGT", "MA*", "X", "III", "I!")
    r = one(spark, a=seq.human_number(F.lit(12345)), b=seq.human_number(F.lit(2.5e12)), c=seq.reads_label(F.lit(1500)), d=seq.barcode_index(F.lit("x/barcode07/y")), s=seq.strip_direction(F.lit("fwd:a:b")), p=seq.last_part(F.lit("fwd:a:b")))
    assert (r.a, r.b, r.c, r.d, r.s, r.p) == ("12k", "2.5T", "1.5k", 6, "a:b", "b")


def test_costs(spark):
    want = {(100, 300): 1726, (500, 300): 3793, (1000, 300): 6204, (2000, 300): 10513, (1000, 135): 4944, (1000, 600): 13144, (3000, 600): 11429, (5000, 600): 30672}
    rows = spark.createDataFrame(list(want), "n int, length int")
    assert {(r.n, r.length): r.cost for r in rows.select("n", "length", costs.pooled_total().alias("cost")).collect()} == want
    commercial = {(100, 300): [5234, 3834, 4434], (1000, 300): [47849, 33849, 39849], (1000, 400): [47849, 47849, 48849], (2000, 600): [109199, 109199, 133199]}
    got = costs.commercial_costs(spark.createDataFrame(list(commercial), "n int, length int")).collect()
    order = {"Gene Fragments": 0, "eBlocks": 1, "gBlocks": 2}
    assert {k: [r.cost for r in sorted((r for r in got if (r.n, r.length) == k), key=lambda r: order[r["product"]])] for k in commercial} == commercial
    with pytest.raises(ValueError):
        costs.fragment_assembly("n", "glue")


def test_recovery_and_funnel(spark):
    pool = simulate.lognormal_pool(spark, 50, 4)
    assert abs(pool.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    assert simulate.sample_counts(pool, 500).agg(F.sum("n")).first()[0] == 500
    ys = [r.y for r in simulate.recovery_with_resynthesis(pool, 40, 40, True, 5).orderBy("x").collect()]
    assert len(ys) == 80 and ys == sorted(ys) and ys[-1] <= 1
    for bad in ((None, 1, False), (-1, 1, False), (5, 0, True)):
        with pytest.raises(ValueError):
            simulate.recovery_with_resynthesis(pool, bad[0], bad[1], bad[2])
    assert simulate.recovery_with_resynthesis(pool, 0, 0).count() == 0
    a = simulate.funnel(spark, 20, 60, scale=2, fold=1, semantics="documented").orderBy("sim").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert a == simulate.funnel(spark, 20, 60, scale=2, fold=1, semantics="documented").orderBy("sim").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    mean = sum(r["unique"] for r in a) / len(a)
    assert 15 < mean < 60
    sweep = simulate.coverage_sweep(spark, [1.0, 3.0], 40, 5, scale=5, semantics="documented")
    assert sweep.where("fold = 0").agg(F.sum("unique")).first()[0] == 0 and sweep.count() == 15
    x = spark.createDataFrame([(1,), (100,)], "x long")
    assert [round(r.y, 3) > 0 for r in simulate.expected_curve(pool, x).collect()] == [True, True]


def test_interpolation_and_maps(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0)], "x double, y double")
    got = stats.interpolate(spark.createDataFrame([(-1.0,), (5.0,), (10.0,), (12.0,)], "x double"), curve)
    assert [r.y for r in got.orderBy("x").collect()] == [0.0, 10.0, 20.0, 20.0]
    diff = spark.createDataFrame([("a", 1.0, -1.0), ("a", 3.0, 1.0), ("a", 5.0, -1.0), ("b", 1.0, 1.0)], "k string, x double, d double")
    assert [tuple(r) for r in stats.crossover(diff, ["k"]).collect()] == [("a", 2.0)]
    reads = [("a", "1A1")] * 90 + [("a", "1A2")] * 10 + [("b", "1A3")] * 49 + [("c", "1A4")] * 89 + [("c", "1A5")] * 11 + [("d", "1A6")] * 48 + [("d", "1A7")]
    got = demux.reference_map(spark.createDataFrame(reads, "ref_name string, well string"), spark.createDataFrame([(x,) for x in "abcde"], "ref_id string"))
    assert {r.Reference: (r.Well, r.Flag) for r in got.collect()} == {"a": ("1A1", False), "b": ("1A3", True), "c": ("1A4", True), "e": ("Missed", True)}


@pytest.mark.parametrize("shares", [3, 1000])
def test_ordered_passes_over_shares(spark, monkeypatch, shares):
    """Interpolation, crossover and quantiles equal plain loops, however many shares the rows are cut into and whatever share has no point."""
    monkeypatch.setattr(stats, "SHARES", shares)
    monkeypatch.setattr(stats, "NARROW", 20)
    rng = random.Random(5)
    curve = {k: sorted((float(x), rng.uniform(-5, 5)) for x in rng.sample(range(0, 300, 3), n)) for k, n in (("a", 40), (None, 7), ("one", 1))}
    asks = [(k, float(rng.randrange(-20, 320))) for k in ("a", None, "one", "none") for _ in range(120)] + [("a", 5.0)] * 200
    got = stats.interpolate(spark.createDataFrame(asks, "k string, x double"), spark.createDataFrame([(k, *p) for k, c in curve.items() for p in c], "k string, x double, y double"), ["k"]).collect()
    want = [(k, x, float(np.interp(x, *zip(*curve[k], strict=True))) if k in curve else None) for k, x in asks]
    show = lambda rows: sorted(repr((k, x, y if y is None else round(y, 9) + 0.0)) for k, x, y in rows)
    assert show(got) == show(want)
    found = {r.k: r.crossover for r in stats.crossover(spark.createDataFrame([(k, *p) for k, c in curve.items() for p in c], "k string, x double, d double"), ["k"]).collect()}
    for k, c in curve.items():
        first = [x - y * (x1 - x) / (y1 - y) for (x, y), (x1, y1) in zip(c, c[1:]) if np.sign(y) != np.sign(y1)][:1]
        assert ([found[k]] if k in found else []) == pytest.approx(first)
    values = [rng.choice([1, 2, 2**31, -7, rng.randrange(1000)]) for _ in range(500)] + [10**12]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "x long")
    for p in (0.0, 0.01, 0.25, 0.5, 0.9, 0.999):
        assert stats.floor_quantile(frame, "x", p).first().q == sorted(values)[int(501 * p)]
    assert stats.floor_quantile(frame, "x", 1.0).first().q is None and stats.floor_quantile(frame.limit(0), "x", 0.5).first().q is None


def test_barcodes_and_seeds(spark):
    kit = spark.createDataFrame([(0, "FB01", "ACGTACGTAC"), (1, "FB02", "TTGGCCAATT")], "idx int, name string, barcode string")
    reads = spark.createDataFrame([("r1", "GGACGTACGTACCC"), ("r2", "TTGGCCTATTGGGG"), ("r3", "CCCCCCCCCCCCCC")], "read_name string, read_seq string")
    assert {r.read_name: r.idx for r in demux.classify_barcodes(reads, kit, most=3).collect()} == {"r1": 0, "r2": 1, "r3": None}
    refs = spark.createDataFrame([("x", "ACGGTTCAGATTACAGGCATCG"), ("y", "TTTTGGGGCCCCAAAATTTTGG")], "ref_id string, ref_seq string")
    reads = spark.createDataFrame([("r1", "TTCAGATTACAGGCA"), ("r2", "TGCCTGTAATCTGAA")], "read_name string, read_seq string")
    got = {r.read_name: (r.ref_id, r.strand, r.offset) for r in demux.align_by_seeds(reads, refs).collect()}
    assert got == {"r1": ("x", "fwd", 4), "r2": ("x", "rev", 4)}


def test_records(spark, tmp_path):
    for d, name, text in (("fbc/barcode01", "a.fastq", "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\nI!\n"), ("rbc/barcode02", "a.fastq", "@r1\nACGT\n+\nIIII\n@bad\nAC\n+\nI\n"), ("refs/fwd", "a.fastq", "@r1|ref=g1\nACGT\n+\nII!!\n"), ("refs/rev", "a.fastq", "@r3|ref=g2\nACGT\n+\nIIII\n"), ("fbc/unclassified", "b.fastq", "@r9\nA\n+\nI\n")):
        (tmp_path / d).mkdir(parents=True, exist_ok=True)
        (tmp_path / d / name).write_text(text)
    (tmp_path / "k.fasta").write_text(">g1 d\nACG\nT\n>g2\nTTTT\n")
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\tg1\t1\t9\t4M\t*\t0\t0\tACGT\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    root = str(tmp_path)
    assert records.read_fastq(spark, root).count() == 7
    assert records.read_names(records.read_fastq(spark, f"{root}/rbc")).first().malformed == 1
    assert {r.ref_id: r.ref_seq for r in records.read_fasta(spark, f"{root}/k.fasta").collect()} == {"g1": "ACGT", "g2": "TTTT"}
    reads = {r.read_name: r for r in demux.assemble_reads(*records.demux_tree(spark, root)).collect()}
    assert set(reads) == {"r1", "r2", "r3"}
    assert (reads["r1"].fbc, reads["r1"].rbc, reads["r1"].ref_name, reads["r1"].avg_qual) == (0, 1, "fwd:g1", 20.0)
    assert (reads["r2"].rbc, reads["r3"].fbc, reads["r3"].ref_name) == (None, None, "rev:g2")
    assert [r.value for r in records.tagged_fastq(records.read_sam(spark, f"{root}/a.sam")).collect()] == ["@r1|ref=g1\nACGT\n+\nIIII"]
    kit = spark.createDataFrame([(i, f"FB{i + 1:02d}") for i in range(3)], "idx int, name string")
    rkit = spark.createDataFrame([(i, f"RB{i + 1:02d}") for i in range(3)], "idx int, name string")
    refs = records.read_fasta(spark, f"{root}/k.fasta")
    formatted = demux.format_reads(demux.assemble_reads(*records.demux_tree(spark, root)), kit, rkit, refs).collect()
    assert [(r.read_name, r.well_pos, r.ref_id, r.ref_len) for r in formatted] == [("r1", "1A2", "g1", 4)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "FB01", "RB01"), (2, "FB01", "RB01"), (3, "FB97", "RB01")], "s long, fbc_name string, rbc_name string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = well_depths(stream).writeStream.outputMode("complete").format("memory").queryName("depths").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.well_pos, r.depth) for r in spark.table("depths").collect()] == [("1A1", 2)]


def test_resynthesis_does_not_broadcast_the_pool(spark):
    """No copy of the pool is sent to every executor: a broadcast of over 200 kB fails here."""
    pool = spark.range(30_000).select(F.col("id").alias("variant"), F.lit(1.0).alias("weight"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxBroadcastTableSize": "200k"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        ys = [r.y for r in simulate.recovery_with_resynthesis(pool, 5, 5, True, 2).orderBy("x").collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(ys) == 10 and ys == sorted(ys) and abs(ys[-1] - 10 / 30_000) < 1 / 30_000


def test_ranks_of_the_unseen_are_no_broadcast(spark, tmp_path):
    """A pool that Spark takes for small is repeated for the replicates: what is left of it may not go to the driver whole."""
    spark.range(300).select(F.col("id").alias("variant"), F.lit(1.0).alias("weight")).write.parquet(f"{tmp_path}/pool")
    found = simulate.recovery_with_resynthesis(spark.read.parquet(f"{tmp_path}/pool"), 300, 200, True, 4)
    plan = re.sub(r"#\d+L?", "", found._jdf.queryExecution().sparkPlan().toString())
    assert "SortMergeJoin [rep, r], [rep, r]" in plan and "BroadcastHashJoin [rep, r]" not in plan
    ys = [r.y for r in found.orderBy("x").collect()]
    assert len(ys) == 500 and ys == sorted(ys) and ys[299] < 0.7 < ys[-1] <= 1


def test_reads_are_not_dealt_by_reference(spark, monkeypatch):
    """Two references of all reads are no two tasks: they go to the reads. Larger tables are joined by a shuffle, with the same rows."""
    reads = spark.range(1000).select(F.col("id").cast("string").alias("read_name"), F.lit("FB01").alias("fbc_name"), F.lit("RB01").alias("rbc_name"), F.concat(F.lit("fwd:g"), (F.col("id") % 3).cast("string")).alias("ref_name"))
    references = spark.createDataFrame([("g0", "ACGT"), ("g1", "AC"), (None, "A"), ("g9", None)], "ref_id string, ref_seq string")

    def run():
        found = demux.format_reads(reads, references=references)
        return "SortMergeJoin" in found._jdf.queryExecution().sparkPlan().toString(), sorted((r.read_name, r.ref_id, r.ref_seq or "", r.ref_len or 0) for r in found.collect())

    merged, rows = run()
    assert not merged and len(rows) == 1000 and {r[1:] for r in rows} == {("g0", "ACGT", 4), ("g1", "AC", 2), ("g2", "", 0)}
    monkeypatch.setattr(demux, "REFERENCE_BYTES", 100)
    assert run() == (True, rows)
