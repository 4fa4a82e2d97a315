"""Sequence, quality and label expressions: Column -> Column, JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC complements and the standard codon table in TCAG order.
IUPAC = "ACGTUNRYKMSWBVDHacgtunrykmswbvdh"
COMPLEMENT = "TGCAANYRMKSWVBHDtgcaanyrmkswvbhd"
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_id(read_id: Column | str) -> Column:
    """First white-space token without |ref=..., mate or pool suffixes; empty becomes null."""
    token = F.split(F.trim(_c(read_id)), r"\s+")[0]
    name = F.regexp_replace(token, r"\|ref=.*|/[12]$|_pool_plates.*", "")
    # As an element the name is made once; nullif() repeats the expression that it tests.
    return F.transform(F.array(name), lambda x: F.nullif(x, F.lit("")))[0]


def barcode_index(path: Column | str) -> Column:
    """Zero-based number of the first barcodeNN in a path; null without one."""
    return F.regexp_extract(_c(path), r"barcode(\d+)", 1).try_cast("int") - 1


def ref_tag(read_id: Column | str) -> Column:
    text = _c(read_id)
    return F.when(text.contains("|ref="), F.nullif(F.regexp_extract(text, r"\|ref=([^\s|]+)", 1), F.lit("")))


def with_direction(direction: Column | str, ref: Column | str) -> Column:
    return F.concat(_c(direction), F.lit(":"), _c(ref))


def strip_direction(ref: Column | str) -> Column:
    """Text after the first colon."""
    return F.regexp_replace(_c(ref), r"^[^:]*:", "")


def last_part(ref: Column | str) -> Column:
    return F.substring_index(_c(ref), ":", -1)


def phred_encode(quals: Column | str) -> Column:
    return F.array_join(F.transform(_c(quals), lambda q: F.char(q + 33)), "")


def phred_decode(qual: Column | str) -> Column:
    q = _c(qual)
    return F.when(F.length(q) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda ch: F.ascii(ch) - 33))


def mean_quality(qual: Column | str) -> Column:
    """Arithmetic mean of the phred values; null for empty strings."""
    q = _c(qual)
    total = F.aggregate(F.split(q, ""), F.lit(0).cast("long"), lambda acc, x: acc + F.ascii(x))
    return F.when(F.length(q) > 0, (total - 33 * F.length(q)) / F.length(q))


def fill_quality(qual: Column | str, seq: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(qual), F.lit("")), F.repeat(F.lit("I"), F.length(F.coalesce(_c(seq), F.lit("")))))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), IUPAC, COMPLEMENT))


def translate_codons(seq: Column | str) -> Column:
    """Protein of the whole codons; X where a base is not one of ACGT (U reads as T)."""
    s = F.replace(F.upper(_c(seq)), F.lit("U"), F.lit("T"))

    # The codons are cut once, so the work is linear in the sequence.
    def amino(codon: Column) -> Column:
        digit = lambda k: F.instr(F.lit(BASES), F.substring(codon, k, 1)) - 1
        known = (digit(1) >= 0) & (digit(2) >= 0) & (digit(3) >= 0)
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), digit(1) * 16 + digit(2) * 4 + digit(3) + 1, F.lit(1))).otherwise(F.lit("X"))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)..."), F.lit(0)), amino), "")


def single_match(cigar: Column | str) -> Column:
    return _c(cigar).rlike(r"^\d+[Mm]$")


def cigar_length(cigar: Column | str) -> Column:
    return F.regexp_extract(_c(cigar), r"^(\d+)", 1).try_cast("int")


def barcode_to_well(fbc: Column | str, rbc: Column | str) -> Column:
    """FBnn and RBnn (96 x 32) to plate, row and column of 8 plates of 384 wells; null outside."""
    # Cut by place, not by a pattern: this runs for every read.
    fb, rb = (F.when(F.substring(_c(x), 1, 2).isin("FB", "RB"), F.substring(_c(x), 3, 12)).otherwise(_c(x)).try_cast("int") - 1 for x in (fbc, rbc))
    row = 2 * F.floor(fb / 12) + F.when(rb % 4 < 2, 1).otherwise(2)
    col = 2 * (fb % 12) + F.when(rb % 2 == 0, 1).otherwise(2)
    label = F.concat((F.floor(rb / 4) + 1).cast("string"), F.char(64 + row), col.cast("string"))
    return F.when(fb.between(0, 95) & rb.between(0, 31), label)


def parse_well(well: Column | str) -> Column:
    """Struct of plate, row and col; null fields where the label doesn't begin as one."""
    part = lambda k: F.nullif(F.regexp_extract(_c(well), r"^(\d+)([A-P]+)(\d+)", k), F.lit(""))
    return F.struct(part(1).try_cast("int").alias("plate"), part(2).alias("row"), part(3).try_cast("int").alias("col"))


def well_label(row: Column | str, col: Column | str) -> Column:
    return F.concat(_c(row), _c(col).cast("int").cast("string"))


def human_number(n: Column | str) -> Column:
    """Thousands as k, M, B without decimals (ties to even), then T with one."""
    x = _c(n).cast("double")
    whole = lambda p, unit: F.concat(F.bround(x / 10**p, 0).cast("bigint").cast("string"), F.lit(unit))
    size = F.abs(x)
    return F.when(size < 1e3, whole(0, "")).when(size < 1e6, whole(3, "k")).when(size < 1e9, whole(6, "M")).when(size < 1e12, whole(9, "B")).otherwise(F.concat(F.bround(x / 1e12, 1).cast("string"), F.lit("T")))


def reads_label(n: Column | str) -> Column:
    """Thousands as k and millions as M with one decimal; a decimal tie is rounded up."""
    x = _c(n).cast("double")
    return F.when(x < 1e3, x.cast("bigint").cast("string")).when(x < 1e6, F.concat(F.format_string("%.1f", x / 1e3), F.lit("k"))).otherwise(F.concat(F.format_string("%.1f", x / 1e6), F.lit("M")))
