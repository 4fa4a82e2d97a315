"""Read assembly, plates, wells, consensus and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..functions.stats import once
from .barcodes import demultiplex

EMPTY = "empty"
#: Bytes of references up to which they are sent to all tasks; larger ones are joined by a shuffle of the reads.
REFERENCE_BYTES = 32 << 20


def assemble_reads(fbc: DataFrame, rbc: DataFrame, refs: DataFrame) -> DataFrame:
    """Full outer assembly by read name, last write wins, in one shuffle.

    fbc and rbc have read_name, ord, idx; refs has read_name, ord, ref_name, read_seq, read_qual.
    The three sides are tagged, united and reduced by key, so a key is dealt once.
    """
    parts = (fbc.select("read_name", F.struct("ord", "idx").alias("f")), rbc.select("read_name", F.struct("ord", "idx").alias("r")), refs.select("read_name", F.struct("ord", "ref_name", "read_seq", "read_qual").alias("m")))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).where("read_name is not null")
    # Dealt before they are reduced: names are rare within a task, so reducing there would sort all rows for nothing.
    rows = rows.repartition("read_name")
    last = rows.groupBy("read_name").agg(*(F.max_by(c, F.col(f"{c}.ord")).alias(c) for c in "frm"))
    return last.select("read_name", F.col("f.idx").alias("fbc"), F.col("r.idx").alias("rbc"), "m.ref_name", "m.read_seq", "m.read_qual", seq.mean_quality("m.read_qual").alias("avg_qual"))


def name_overlap(fwd: DataFrame, rev: DataFrame) -> DataFrame:
    """One row: reads of each direction, distinct names and names met in both (one grouped pass)."""
    rows = fwd.select("read_name", F.lit(1).alias("f"), F.lit(0).alias("r")).union(rev.select("read_name", F.lit(0), F.lit(1)))
    names = rows.groupBy("read_name").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    count = lambda c: F.count_if(c).cast("long")
    named = F.col("read_name").isNotNull() & (F.col("read_name") != "")
    return names.agg(
        F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("fwd_reads"), F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("rev_reads"), count(named & (F.col("f") > 0)).alias("fwd_names"), count(named & (F.col("r") > 0)).alias("rev_names"),
        count(named & (F.col("f") > 0) & (F.col("r") > 0)).alias("both"), F.coalesce(F.sum(F.when(~named, F.col("f") + F.col("r"))), F.lit(0)).cast("long").alias("malformed"),
    )


def alignment_stats(total: DataFrame, overlap: DataFrame) -> DataFrame:
    """Mapped shares in percent (one decimal, ties to even) of the `n` of total; null where there are no reads."""
    share = lambda c: F.when(F.col("n") > 0, F.bround(100 * c / F.col("n"), 1))
    both = overlap.crossJoin(total.agg(F.sum("n").alias("n")))  # one row each
    return both.select("n", (F.col("fwd_reads") + F.col("rev_reads")).alias("mapped"), share(F.col("fwd_reads")).alias("fwd_pct"), share(F.col("rev_reads")).alias("rev_pct"), share(F.col("both")).alias("both_pct"))


def format_reads(reads: DataFrame, fbc: DataFrame | None = None, rbc: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Barcode names and well positions of complete reads, sorted by plate, row and column; references adds ref_id, ref_seq, ref_len.

    The barcode tables (96 and 32 rows of idx, name) are broadcast, and so are references of REFERENCE_BYTES in all,
    measured at the call: reads name few of them, so a shuffle by reference would give
    most reads to a few tasks. Beyond that, adaptive execution splits such tasks.
    """
    for table, side in ((fbc, "fbc"), (rbc, "rbc")):
        if table is not None:
            reads = reads.join(F.broadcast(table.select(F.col("idx").alias(side), F.col("name").alias(f"{side}_name"))), side, "left")
        elif f"{side}_name" not in reads.columns:
            raise ValueError(f"reads has no {side}_name and no {side} table is given")
    reads = reads.dropna(subset=["fbc_name", "rbc_name", "ref_name"]).withColumn("well_pos", seq.barcode_to_well("fbc_name", "rbc_name"))
    columns = [c for c in ("read_name", "fbc_name", "rbc_name", "well_pos", "ref_name", "read_seq", "read_qual", "avg_qual") if c in reads.columns]
    reads = reads.select(*columns)
    if references is not None:
        references = references.select("ref_id", "ref_seq")
        letters = F.octet_length(F.concat_ws("", "ref_id", "ref_seq"))
        if (references.agg(F.sum(64 + letters)).first()[0] or 0) <= REFERENCE_BYTES:  # 64 for a row itself
            references = F.broadcast(references)
        reads = reads.withColumn("ref_id", seq.strip_direction("ref_name")).join(references, "ref_id", "left").withColumn("ref_len", F.length("ref_seq"))
        reads = reads.select(*columns, "ref_id", "ref_seq", "ref_len")
    return reads.withColumn("_w", seq.parse_well("well_pos")).orderBy(*(F.col(f"_w.{k}").asc_nulls_last() for k in ("plate", "row", "col"))).drop("_w")


def _counts(reads: DataFrame, well: str, ref: str, extra: list[Column] = ()) -> DataFrame:
    """Counts by well and reference with the well's depth and the reference's rank (n down, then name)."""
    # The label is made once a read: no filter above pulls its expression down.
    named = reads.withColumns({"well_pos": once(F.col(well)), "ref_name": F.col(ref)})
    counts = named.where("well_pos is not null and ref_name is not null").groupBy("well_pos", "ref_name").agg(F.count("*").alias("n"), *extra)
    by_well = Window.partitionBy("well_pos")
    return counts.withColumn("depth", F.sum("n").over(by_well)).withColumn("rank", F.row_number().over(by_well.orderBy(F.desc("n"), "ref_name")))


def well_summary(reads: DataFrame) -> DataFrame:
    """Depth, dominant reference and its share per well. Rows are reduced by (well, reference) before any window."""
    extra = [F.first(c).alias(c) for c in ("ref_len", "ref_seq") if c in reads.columns]
    top = _counts(reads, "well_pos", "ref_name", extra).where("rank = 1").withColumn("w", seq.parse_well("well_pos"))
    return top.select(F.col("w.plate").alias("plate"), seq.well_label("w.row", "w.col").alias("well"), F.col("well_pos").alias("global_well"), "depth", F.col("ref_name").alias("major_ref"), (F.col("n") / F.col("depth")).alias("major_freq"), *(c for c in ("ref_len", "ref_seq") if c in reads.columns))


def plate_map(reads: DataFrame, max_lines: int = 6, min_reads: int | None = None) -> DataFrame:
    """All 384 wells of every plate met: tooltip of the largest references, reads and the dominant share.

    With min_reads, `clipped` is the number of reads up to that, for a colour scale.
    Reads are counted once; labels are parsed once a well; the wells of a plate (384
    at most, others are on no plate) meet in one row, which is laid out again.
    """
    counts = _counts(reads, "well_pos", "ref_name")
    line = F.concat("ref_name", F.lit(" "), F.bround(100 * F.col("n") / F.col("depth"), 0).cast("int").cast("string"), F.lit("%"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= max_lines, F.struct("rank", line.alias("line"))))), lambda x: x["line"])
    wells = counts.groupBy("well_pos", "depth").agg(lines.alias("lines"), (F.max("n") / F.col("depth")).alias("frac")).withColumn("w", once(seq.parse_well("well_pos")))
    wells = wells.select("w.*", "lines", F.col("depth").alias("reads"), "frac").where("plate is not null and length(row) = 1 and col between 1 and 24")
    at = (F.ascii("row") - 65) * 24 + F.col("col") - 1
    plates = wells.groupBy("plate").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.struct("lines", "reads", "frac").alias("well")))).alias("wells"))
    grid = plates.select("plate", "wells", F.explode(F.sequence(F.lit(0), F.lit(383))).alias("at"))
    row, col = F.char(F.floor(F.col("at") / 24) + 65), (F.col("at") % 24 + 1).cast("int")
    filled = grid.select("plate", row.alias("row"), col.alias("col"), F.try_element_at("wells", "at").alias("x")).withColumn("well", seq.well_label("row", "col"))
    tooltip = F.array_join(F.concat(F.array(F.concat(F.lit("<b>"), F.col("well"), F.lit("</b>"))), F.col("x.lines")), "<br/>")
    reads_there = F.coalesce("x.reads", F.lit(0)).cast("long")
    clipped = [] if min_reads is None else [F.least(reads_there, F.lit(min_reads).cast("long")).alias("clipped")]
    return filled.select("plate", "row", "col", "well", F.coalesce(tooltip, F.lit(EMPTY)).alias("tooltip"), reads_there.alias("reads"), F.coalesce("x.frac", F.lit(0.0)).alias("frac"), *clipped)


def plate_map_json(plates: DataFrame) -> DataFrame:
    """(plate, json): the wells of a plate, in order, as one JSON array for a viewer."""
    well = F.struct("row", "col", "well", "tooltip", "reads", "frac")
    return plates.groupBy("plate").agg(F.to_json(F.array_sort(F.collect_list(well))).alias("json"))


def wells_with(wells: DataFrame, reads: DataFrame) -> DataFrame:
    """The wells that have any read."""
    return wells.join(reads.select("well_pos").distinct(), F.col("global_well") == F.col("well_pos"), "left_semi")


def well_map(wells: DataFrame) -> DataFrame:
    """wells sorted by plate, row and column, for export."""
    w = seq.parse_well("global_well")
    return wells.withColumn("_w", w).orderBy(*(F.col(f"_w.{k}").asc_nulls_last() for k in ("plate", "row", "col"))).drop("_w")


def reference_map(reads: DataFrame, references: DataFrame, least: int = 50, include_ambiguous: bool = False) -> DataFrame:
    """One row per reference: its top well, a flag and a note; low and mixed references go unless include_ambiguous."""
    counts = reads.where("well is not null").groupBy("ref_name", "well").agg(F.count("*").alias("n"))
    w = seq.parse_well("well")
    order = [F.desc("n"), w["plate"].asc_nulls_last(), w["row"].asc_nulls_last(), w["col"].asc_nulls_last(), "well"]
    top = counts.groupBy("ref_name").agg(F.sum("n").alias("total"), F.max("n").alias("n")).join(
        counts.withColumn("k", F.row_number().over(Window.partitionBy("ref_name").orderBy(*order))).where("k = 1").select("ref_name", "well"), "ref_name"
    )
    rows = references.select(F.col("ref_id").alias("Reference")).join(top, F.col("Reference") == F.col("ref_name"), "left")
    pure, high = F.col("n") * 10 >= F.col("total") * 9, F.col("n") >= least
    alone = F.col("n") == F.col("total")
    percent = F.format_string("%.1f%%", F.bround(100 * F.col("n") / F.col("total"), 1))
    missed = F.col("n").isNull()
    note = (
        F.when(missed, F.lit("Missed")).when(high & ~pure, F.concat(F.lit("Mixed reads: aligned to "), percent, F.lit(" of reads"))).when(~high & alone, F.concat(F.lit("Low reads ("), F.col("n").cast("string"), F.lit("), but homogeneous")))
    )
    kept = rows if include_ambiguous else rows.where(missed | high | alone)
    return kept.select("Reference", F.when(missed, F.lit("Missed")).otherwise(F.col("well")).alias("Well"), (missed | ~(high & pure)).alias("Flag"), note.alias("Note"))


def classify_consensus(wells: DataFrame) -> DataFrame:
    """cons_check from CIGAR, cons_seq, ref_seq and ref_len; identity says whether the sequences are equal."""
    same_length = F.length("cons_seq") == F.col("ref_len")
    same_protein = seq.translate_codons("cons_seq") == seq.translate_codons("ref_seq")
    single = seq.single_match("CIGAR")
    check = (
        F.when(F.col("CIGAR").isNull(), "Error").when(single & (seq.cigar_length("CIGAR") == F.col("ref_len")), "Perfect Match").when(single, "Partial Match").when(same_length & same_protein, "Silent Mutation").when(same_length, "Other Error").otherwise("Error")
    )
    return wells.withColumn("cons_check", check).withColumn("identity", F.col("cons_seq") == F.col("ref_seq"))


def pileup_consensus(aligned: DataFrame, least_depth: int = 1) -> DataFrame:
    """Majority base per (well, position) of (well, pos, seq), joined in order; N below least_depth.

    Bases are counted by (well, position, base) with map-side combining, so a deep well is no hot spot.
    """
    bases = aligned.select("well", F.posexplode(F.split("seq", "")).alias("i", "base"), "pos").select("well", (F.col("pos") + F.col("i")).alias("at"), "base")
    counts = bases.where("base <> ''").groupBy("well", "at", "base").agg(F.count("*").alias("n"))
    best = counts.groupBy("well", "at").agg(F.min(F.struct((-F.col("n")).alias("n"), "base")).alias("b"), F.sum("n").alias("depth"))
    call = F.when(F.col("depth") >= least_depth, F.col("b.base")).otherwise(F.lit("N"))
    return best.groupBy("well").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", call.alias("c")))), lambda x: x["c"]), "").alias("cons_seq"), F.min("at").alias("first"), F.max("at").alias("last"))


def classify_barcodes(reads: DataFrame, barcodes: DataFrame, window: int = 40, most: int = 4, margin: int = 1, both_ends: bool = False) -> DataFrame:
    """(read_name, idx, distance): the best barcode near each read's start (or, with both_ends, at either end), null without a clear winner."""
    return demultiplex(reads, barcodes, window, most, margin, "either" if both_ends else "front", trim=False).select("read_name", "idx", "distance")


def align_by_seeds(reads: DataFrame, references: DataFrame, k: int = 11, least_votes: int = 2, most: int = 1000) -> DataFrame:
    """Reference, strand and offset with the most shared k-mers of each read: an equi-join on seeds, then votes. Seeds with over `most` places don't vote."""
    seeds = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    strands = F.explode(F.array(F.struct(F.lit("fwd").alias("strand"), F.col("read_seq").alias("s")), F.struct(F.lit("rev").alias("strand"), seq.reverse_complement("read_seq").alias("s"))))
    left = reads.where(F.length("read_seq") >= k).select("read_name", strands.alias("x")).select("read_name", "x.strand", F.posexplode(seeds(F.col("x.s"))).alias("at", "seed"))
    right = references.where(F.length("ref_seq") >= k).select("ref_id", F.posexplode(seeds(F.col("ref_seq"))).alias("ref_at", "seed"))
    right = right.join(right.groupBy("seed").agg(F.count("*").alias("hits")).where(F.col("hits") <= most), "seed")
    votes = left.join(right, "seed").groupBy("read_name", "ref_id", "strand", (F.col("ref_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("read_name").agg(F.max_by(F.struct("ref_id", "strand", "offset", "votes"), F.struct("votes", "strand", "ref_id", "offset")).alias("b"))
    return best.select("read_name", "b.*").where(F.col("votes") >= least_votes)
