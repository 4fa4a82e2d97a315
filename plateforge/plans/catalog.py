"""Query catalogue of the sequencing, simulation and cost operators.

The test tables hold no sequencing data, so order lines stand in for reads, part
keys for grid points and document texts for sequences; the SQL reads the same
stand-ins.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import seq, stats
from ..operators import align, barcodes, costs, demux, index, simulate
from ..sources import bam, records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes texts of.
SPREAD_ROWS = 200_000


def _tasks(rows: DataFrame) -> int:
    """Tasks to deal rows to, so that these grow with the rows: a file is read by a task a row group, and may be one group whatever its size."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    ref = F.concat(F.when(F.col("l_linestatus") == "F", "fwd:").otherwise("rev:"), "l_returnflag")
    rows = rows.select(F.format_string("FB%02d", F.col("l_partkey") % 96 + 1).alias("fbc_name"), F.format_string("RB%02d", F.col("l_suppkey") % 32 + 1).alias("rbc_name"), ref.alias("ref_name"))
    return rows.withColumn("well_pos", seq.barcode_to_well("fbc_name", "rbc_name"))


_READS_SQL = """
reads AS (
  SELECT (rb // 4 + 1) AS plate, chr(CAST(64 + 2 * (fb // 12) + CASE WHEN rb % 4 < 2 THEN 1 ELSE 2 END AS INT)) AS row, CAST(2 * (fb % 12) + CASE WHEN rb % 2 = 0 THEN 1 ELSE 2 END AS INT) AS col, ref
  FROM (SELECT l_partkey % 96 AS fb, l_suppkey % 32 AS rb, CASE WHEN l_linestatus = 'F' THEN 'fwd:' ELSE 'rev:' END || l_returnflag AS ref FROM lineitem)
),
counted AS (SELECT plate, row, col, ref, count(*) AS n FROM reads GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY plate, row, col) AS depth, row_number() OVER (PARTITION BY plate, row, col ORDER BY n DESC, ref) AS rk FROM counted)
"""


def well_summary(spark, sf_dir):
    return demux.well_summary(_reads(spark, sf_dir))


WELL_SUMMARY = f"""WITH {_READS_SQL}
SELECT CAST(plate AS INT) AS plate, row || col AS well, plate || row || col AS global_well, CAST(depth AS BIGINT) AS depth, ref AS major_ref, n / depth AS major_freq FROM ranked WHERE rk = 1"""


def plate_map(spark, sf_dir):
    return demux.plate_map(_reads(spark, sf_dir))


PLATE_MAP = f"""WITH {_READS_SQL},
lines AS (SELECT plate, row, col, depth, max(n) AS top, '<b>' || row || col || '</b><br/>' || string_agg(ref || ' ' || CAST(round_even(100.0 * n / depth, 0) AS INT) || '%', '<br/>' ORDER BY rk) FILTER (rk <= 6) AS tooltip FROM ranked GROUP BY plate, row, col, depth),
layout AS (SELECT plate, chr(CAST(65 + r AS INT)) AS row, CAST(c AS INT) AS col FROM (SELECT DISTINCT plate FROM lines), range(16) a(r), range(1, 25) b(c))
SELECT CAST(plate AS INT) AS plate, row, col, row || col AS well, coalesce(tooltip, 'empty') AS tooltip, CAST(coalesce(depth, 0) AS BIGINT) AS reads, coalesce(top / depth, 0.0) AS frac FROM layout LEFT JOIN lines USING (plate, row, col)"""


def reference_map(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    r = F.col("l_partkey") % 300
    # Every line is a read; those of the other suppliers align to references that are not asked about.
    mine = F.when(F.col("l_suppkey") < r % 100, F.lit("ref")).otherwise(F.lit("host"))
    at = F.when(F.col("l_orderkey") % 100 < 100 - (r % 4) * 5, r).otherwise(r + 1)
    well = F.concat((F.floor(at / 384) + 1).cast("string"), F.char(65 + F.floor(at / 24)), (at % 24 + 1).cast("string"))
    reads = rows.select(F.concat(mine, r.cast("string")).alias("ref_name"), well.alias("well"))
    return demux.reference_map(reads, spark.range(300).select(F.concat(F.lit("ref"), F.col("id").cast("string")).alias("ref_id")))


REFERENCE_MAP = """WITH r AS (SELECT CASE WHEN l_suppkey < l_partkey % 300 % 100 THEN l_partkey % 300 ELSE -1 - l_partkey % 300 END AS r, l_partkey % 300 AS spot, l_orderkey FROM lineitem),
w AS (SELECT r, CASE WHEN l_orderkey % 100 < 100 - (spot % 4) * 5 THEN spot ELSE spot + 1 END AS a FROM r),
c AS (SELECT r, a, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT r, a, n, sum(n) OVER (PARTITION BY r) AS tot, row_number() OVER (PARTITION BY r ORDER BY n DESC, a) AS k FROM c),
j AS (SELECT 'ref' || g AS Reference, a, n, tot FROM range(300) x(g) LEFT JOIN (SELECT * FROM t WHERE k = 1) ON g = r)
SELECT Reference, CASE WHEN n IS NULL THEN 'Missed' ELSE (a // 384 + 1) || chr(CAST(65 + a // 24 AS INT)) || (a % 24 + 1) END AS Well, n IS NULL OR NOT (n >= 50 AND n * 10 >= tot * 9) AS Flag,
  CASE WHEN n IS NULL THEN 'Missed' WHEN n >= 50 AND n * 10 < tot * 9 THEN 'Mixed reads: aligned to ' || format('{:.1f}', round_even(100.0 * n / tot, 1)) || '% of reads' WHEN n < 50 AND n = tot THEN 'Low reads (' || n || '), but homogeneous' END AS Note
FROM j WHERE n IS NULL OR n >= 50 OR n = tot"""


def _lines(spark, sf_dir):
    name = F.concat_ws("_", F.lit("r"), *(F.col(c).cast("string") for c in _KEY[:2]))
    order = F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), 12, "0") for c in _KEY), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 14, "0"), F.date_format("l_shipdate", "yyyyMMddHHmmss"))
    return _table(spark, sf_dir, "lineitem").withColumn("read_name", name).withColumn("ord", order)


_LINES_SQL = """lines AS (SELECT *, 'r_' || l_orderkey || '_' || l_linenumber AS read_name, lpad(l_orderkey::VARCHAR, 12, '0') || ':' || lpad(l_linenumber::VARCHAR, 12, '0') || ':' || lpad(l_partkey::VARCHAR, 12, '0') || ':' || lpad(l_suppkey::VARCHAR, 12, '0') || ':' || lpad(CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, 14, '0') || ':' || strftime(l_shipdate, '%Y%m%d%H%M%S') AS ord FROM lineitem)"""


def read_assembly(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    # Every line is on every side; some sides know a read by a name of their own, so that names lack sides.
    side = lambda odd, mark: F.when(odd, F.concat(F.col("read_name"), F.lit(mark))).otherwise(F.col("read_name")).alias("read_name")
    fbc = rows.select(side(F.col("l_partkey") % 5 == 0, "f"), "ord", (F.col("l_partkey") % 96).cast("int").alias("idx"))
    rbc = rows.select(side(F.col("l_suppkey") % 4 == 0, "r"), "ord", (F.col("l_suppkey") % 32).cast("int").alias("idx"))
    bases = F.translate(F.substring(F.md5("ord"), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT")
    refs = rows.select(side(F.col("l_quantity") <= 5, "m"), "ord", seq.with_direction(F.lit("fwd"), "l_returnflag").alias("ref_name"), bases.alias("read_seq"), F.concat("l_linestatus", F.lit("I!I")).alias("read_qual"))
    return demux.assemble_reads(fbc, rbc, refs)


READ_ASSEMBLY = f"""WITH {_LINES_SQL},
f AS (SELECT read_name || CASE WHEN l_partkey % 5 = 0 THEN 'f' ELSE '' END AS read_name, arg_max(l_partkey % 96, ord) AS fbc FROM lines GROUP BY 1), r AS (SELECT read_name || CASE WHEN l_suppkey % 4 = 0 THEN 'r' ELSE '' END AS read_name, arg_max(l_suppkey % 32, ord) AS rbc FROM lines GROUP BY 1),
m AS (SELECT read_name || CASE WHEN l_quantity <= 5 THEN 'm' ELSE '' END AS read_name, 'fwd:' || arg_max(l_returnflag, ord) AS ref_name, translate(substr(md5(max(ord)), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS read_seq, arg_max(l_linestatus, ord) || 'I!I' AS read_qual FROM lines GROUP BY 1)
SELECT read_name, CAST(fbc AS INT) AS fbc, CAST(rbc AS INT) AS rbc, ref_name, read_seq, read_qual, (ascii(read_qual) - 33 + 40 + 0 + 40) / 4.0::DOUBLE AS avg_qual FROM f FULL JOIN r USING (read_name) FULL JOIN m USING (read_name)"""


def name_overlap_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return demux.name_overlap(rows.where("l_quantity < 30").select("read_name"), rows.where("l_quantity > 20").select("read_name"))


NAME_OVERLAP = f"""WITH {_LINES_SQL}, f AS (SELECT read_name FROM lines WHERE l_quantity < 30), r AS (SELECT read_name FROM lines WHERE l_quantity > 20)
SELECT (SELECT count(*) FROM f) AS fwd_reads, (SELECT count(*) FROM r) AS rev_reads, (SELECT count(DISTINCT read_name) FROM f) AS fwd_names, (SELECT count(DISTINCT read_name) FROM r) AS rev_names, (SELECT count(*) FROM (SELECT read_name FROM f INTERSECT SELECT read_name FROM r)) AS both, 0::BIGINT AS malformed"""


def normalize_ids(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("q"), k, F.lit("|ref=a b"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("q"), k, F.lit("/1 x"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("q"), k, F.lit("_pool_plates_7"))).otherwise(F.lit("|ref=z"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", seq.normalize_id(raw).alias("read_name"), seq.ref_tag(raw).alias("tag"))


NORMALIZE_IDS = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'q' || o_orderkey END AS read_name, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 3 THEN 'z' END AS tag FROM orders"""

_DNA_SQL = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _dna(spark, sf_dir):
    letters = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return _table(spark, sf_dir, "documents").select("doc_id", letters.alias("s"))


def revcomp(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", F.md5(seq.reverse_complement("s")).alias("digest"))


REVCOMP = f"SELECT doc_id, md5(reverse(translate({_DNA_SQL}, 'ACGT', 'TGCA'))) AS digest FROM documents"


def codon_translate(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", F.md5(seq.translate_codons("s")).alias("digest"))


CODON_TRANSLATE = f"""WITH d AS (SELECT doc_id, {_DNA_SQL} AS s FROM documents)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(range(length(s) // 3), lambda i: substr('{seq.AMINO_ACIDS}', CAST((instr('TCAG', substr(s, i * 3 + 1, 1)) - 1) * 16 + (instr('TCAG', substr(s, i * 3 + 2, 1)) - 1) * 4 + instr('TCAG', substr(s, i * 3 + 3, 1)) AS BIGINT), 1)), ''), '')) AS digest FROM d"""

_PHRED_SQL = "regexp_replace(coalesce(text, ''), '[^!-I]', '', 'g')"


def _quality(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-I]", "").alias("q"))


def mean_quality(spark, sf_dir):
    return _quality(spark, sf_dir).select("doc_id", seq.mean_quality("q").alias("avg_qual"))


MEAN_QUALITY = f"SELECT doc_id, list_sum(list_transform(string_split(q, ''), lambda x: ascii(x) - 33))::DOUBLE / length(q) AS avg_qual FROM (SELECT doc_id, nullif({_PHRED_SQL}, '') AS q FROM documents)"


def length_hist(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "documents"), F.length("text")).select("bin", F.round("lo", 6).alias("lo"), "n")


LENGTH_HIST = """WITH v AS (SELECT length(text)::DOUBLE AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT bin, round(any_value(lo + bin * (hi - lo) / 50), 6) AS lo, count(*) AS n FROM (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INT) AS bin, lo, hi FROM v, e) GROUP BY bin"""


def length_frame(spark, sf_dir):
    """The length histogram with its labels, as a plot shows it."""
    return stats.length_frame(_table(spark, sf_dir, "documents"), F.col("text")).withColumn("lo", F.round("lo", 6))


LENGTH_FRAME = f"""WITH h AS ({LENGTH_HIST}), m AS (SELECT median(length(text))::DOUBLE AS median, count(text) AS n FROM documents)
SELECT h.*, median, 'N reads = ' || CASE WHEN m.n < 1000 THEN m.n::VARCHAR WHEN m.n < 1000000 THEN format('{{:.1f}}', m.n / 1e3::DOUBLE) || 'k' ELSE format('{{:.1f}}', m.n / 1e6::DOUBLE) || 'M' END AS reads_label, 'Median = ' || CAST(trunc(median) AS BIGINT) || ' bp' AS median_label FROM h, m"""


def quality_quantiles(spark, sf_dir):
    rows = mean_quality(spark, sf_dir)
    return rows.agg(F.round(F.percentile("avg_qual", F.lit(0.1)), 6).alias("q10"), F.round(F.percentile("avg_qual", F.lit(0.5)), 6).alias("median"), F.count("avg_qual").alias("n"))


QUALITY_QUANTILES = f"SELECT round(quantile_cont(avg_qual, 0.1), 6) AS q10, round(quantile_cont(avg_qual, 0.5), 6) AS median, count(avg_qual) AS n FROM ({MEAN_QUALITY})"


def classify_consensus(spark, sf_dir):
    d, s = F.col("doc_id"), F.col("s")
    # The consensus has another length, another letter at one of two places, or none of these; what that does to its protein is up to the text.
    change = lambda at: F.concat(F.substring(s, 1, at - 1), F.translate(F.substring(s, at, 1), "ACGT", "CATG"), F.substring(s, at + 1, 30 - at))
    cons = F.when(d % 5 == 0, F.substring(s, 1, 29)).when(d % 5 == 1, change(9)).when(d % 5 == 2, change(10)).otherwise(F.substring(s, 1, 30))
    cigar = F.when(d % 4 == 0, F.concat(F.length(cons).cast("string"), F.lit("M"))).when(d % 4 == 1, F.lit("4M1D1I25M")).when(d % 4 == 2, F.lit("3M2I25m")).otherwise(F.when(d % 3 > 0, F.lit("30m")))
    wells = _dna(spark, sf_dir).select("doc_id", cigar.alias("CIGAR"), cons.alias("cons_seq"), F.substring("s", 1, 30).alias("ref_seq"), F.lit(30).alias("ref_len"))
    return demux.classify_consensus(wells).select("doc_id", "cons_check", "identity")


_PROTEIN = "coalesce(array_to_string(list_transform(range(length({0}) // 3), lambda i: substr('" + seq.AMINO_ACIDS + "', CAST((instr('TCAG', substr({0}, i * 3 + 1, 1)) - 1) * 16 + (instr('TCAG', substr({0}, i * 3 + 2, 1)) - 1) * 4 + instr('TCAG', substr({0}, i * 3 + 3, 1)) AS BIGINT), 1)), ''), '')"
CLASSIFY_CONSENSUS = f"""WITH d AS (SELECT doc_id, {_DNA_SQL} AS s FROM documents),
c AS (SELECT doc_id, substr(s, 1, 30) AS ref, CASE doc_id % 5 WHEN 0 THEN substr(s, 1, 29) WHEN 1 THEN substr(s, 1, 8) || translate(substr(s, 9, 1), 'ACGT', 'CATG') || substr(s, 10, 21) WHEN 2 THEN substr(s, 1, 9) || translate(substr(s, 10, 1), 'ACGT', 'CATG') || substr(s, 11, 20) ELSE substr(s, 1, 30) END AS cons FROM d),
g AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN length(cons) || 'M' WHEN 1 THEN '4M1D1I25M' WHEN 2 THEN '3M2I25m' ELSE CASE WHEN doc_id % 3 > 0 THEN '30m' END END AS cigar FROM c)
SELECT doc_id, CASE WHEN cigar IS NULL THEN 'Error' WHEN regexp_full_match(lower(cigar), '[0-9]+m') THEN CASE WHEN CAST(regexp_extract(cigar, '^[0-9]+') AS INT) = 30 THEN 'Perfect Match' ELSE 'Partial Match' END
  WHEN length(cons) <> 30 THEN 'Error' WHEN {_PROTEIN.format('cons')} = {_PROTEIN.format('ref')} THEN 'Silent Mutation' ELSE 'Other Error' END AS cons_check, cons = ref AS identity FROM g"""


def _grid(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    return rows.select((60 + 12 * F.col("p_size")).cast("int").alias("length"), (F.col("p_partkey") % 97 * 211 + 50).cast("int").alias("n")).distinct()


_GRID_SQL = "grid AS (SELECT DISTINCT CAST(60 + 12 * p_size AS INT) AS length, CAST(p_partkey % 97 * 211 + 50 AS INT) AS n FROM part)"
_SHARED_SQL = "(trunc(10.72::DOUBLE * n + 165.0::DOUBLE / 1200 * 10 * n) + trunc(n / 384.0::DOUBLE * 97.73::DOUBLE) + CASE WHEN n * 100.0::DOUBLE * (length + 100) / 1e9 > 1 THEN 550 ELSE 500 END)"
_COMMERCIAL_SQL = f"""{_GRID_SQL}, costs AS (
  SELECT length, n, 'Twist' AS provider, 'Gene Fragments' AS product, CAST(trunc(CASE WHEN length < 300 THEN NULL WHEN length <= 500 THEN 35.0::DOUBLE * n ELSE length::DOUBLE * n * 0.07::DOUBLE END) + {_SHARED_SQL} AS BIGINT) AS cost FROM grid
  UNION ALL SELECT length, n, 'IDT', 'eBlocks', CAST(trunc(CASE WHEN length > 300 AND length <= 500 THEN 35.0::DOUBLE * n ELSE length::DOUBLE * n * 0.07::DOUBLE END) + {_SHARED_SQL} AS BIGINT) FROM grid
  UNION ALL SELECT length, n, 'IDT', 'gBlocks', CAST(trunc(length::DOUBLE * n * 0.09::DOUBLE) + {_SHARED_SQL} AS BIGINT) FROM grid)"""


def commercial_costs(spark, sf_dir):
    return costs.commercial_costs(_grid(spark, sf_dir))


COMMERCIAL_COSTS = f"WITH {_COMMERCIAL_SQL} SELECT * FROM costs"


def commercial_stats(spark, sf_dir):
    return costs.cost_stats(costs.commercial_costs(_grid(spark, sf_dir))).withColumn("mean_cost", F.round("mean_cost", 4))


COMMERCIAL_STATS = f"WITH {_COMMERCIAL_SQL} SELECT length, n, min(cost) AS min_cost, round(avg(cost), 4) AS mean_cost, max(cost) AS max_cost, count(cost) AS n_products FROM costs GROUP BY length, n"

_TIERS_SQL = "tiers(lo, hi, len, usd) AS (VALUES " + ", ".join(f"({lo}, {hi}, {length}, {usd}::DOUBLE)" for (lo, hi), row in costs.TIERS.items() for length, usd in zip(costs.TIER_LENGTHS, row, strict=True)) + ")"


def total_cost(spark, sf_dir):
    return _grid(spark, sf_dir).select("length", "n", costs.pooled_total().alias("cost"))


TOTAL_COST = f"""WITH {_GRID_SQL}, {_TIERS_SQL},
near AS (SELECT length, n, usd, row_number() OVER (PARTITION BY length, n ORDER BY abs(len - length), len) AS k FROM grid JOIN tiers ON n BETWEEN lo AND hi)
SELECT length, n, CAST(trunc(CASE WHEN length <= 350 THEN coalesce(usd * (2.0::DOUBLE / 3), 0) WHEN n < 3000 THEN 0.015::DOUBLE * length * n WHEN n > 3000 AND n < 30000 AND length <= 549 THEN 0.002::DOUBLE * length * n WHEN n > 3000 AND n < 30000 AND length BETWEEN 550 AND 2050 THEN 0.004::DOUBLE * length * n ELSE 0 END
  + 53.6::DOUBLE + (30 * (8 * n // 384) + 60) / 60.0::DOUBLE * 135 + (8 * n // 384) * 97.73::DOUBLE + CASE WHEN 8.0::DOUBLE * n * 100 * (length + 100) / 1e9 > 1 THEN 550 ELSE 500 END + 0.128::DOUBLE * n + ceil(n / 384.0::DOUBLE) * 7.84::DOUBLE) AS BIGINT) AS cost
FROM grid LEFT JOIN (SELECT * FROM near WHERE k = 1) USING (length, n)"""


def cost_crossover(spark, sf_dir):
    points = _grid(spark, sf_dir)
    own = points.select("length", "n", costs.pooled_total().alias("cost"))
    return costs.cost_crossover(costs.cost_stats(costs.commercial_costs(points)), own).withColumn("crossover", F.round("crossover", 4))


COST_CROSSOVER = f"""WITH {COMMERCIAL_COSTS[5:].rsplit(' SELECT', 1)[0]}, own AS ({TOTAL_COST}),
m AS (SELECT length, n, avg(cost) AS y FROM costs GROUP BY ALL), d AS (SELECT length, n::DOUBLE AS x, y - cost AS d FROM m JOIN own USING (length, n)),
p AS (SELECT *, lead(x) OVER w AS x1, lead(d) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY length ORDER BY x)),
c AS (SELECT length, arg_min(x - d * (x1 - x) / (d1 - d), x) AS crossover FROM p WHERE x1 IS NOT NULL AND sign(d) <> sign(d1) GROUP BY length)
SELECT length, round(crossover, 4) AS crossover FROM (SELECT DISTINCT length FROM grid) LEFT JOIN c USING (length)"""


def cost_zoom(spark, sf_dir):
    """Both cost curves near where they meet, or near their start where they never do."""
    points = _grid(spark, sf_dir)
    own = points.select("length", "n", costs.pooled_total().alias("cost"))
    rows = costs.cost_zoom(costs.cost_stats(costs.commercial_costs(points)), own)
    return rows.select("length", "curve", "x", *(F.round(c, 4).alias(c) for c in ("y", "crossover_x", "crossover_y", "x_lo", "x_hi", "y_hi")))


COST_ZOOM = f"""{COST_CROSSOVER.rsplit("SELECT length", 1)[0].rstrip()}, e AS (SELECT length, crossover AS cx FROM (SELECT DISTINCT length FROM grid) LEFT JOIN c USING (length)),
g AS (SELECT length, arg_max(n, n) FILTER (n <= cx) AS n0, arg_max(cost, n) FILTER (n <= cx) AS y0, arg_min(n, n) FILTER (n >= cx) AS n1, arg_min(cost, n) FILTER (n >= cx) AS y1 FROM own JOIN e USING (length) GROUP BY length),
w AS (SELECT length, cx, CASE WHEN n1 > n0 THEN y0 + (cx - n0) * (y1 - y0) / (n1 - n0)::DOUBLE ELSE y0 END AS cy FROM e LEFT JOIN g USING (length)),
z AS (SELECT length, cx, cy, CASE WHEN cx IS NULL THEN 0 ELSE greatest(0, cx - 50) END AS x_lo, CASE WHEN cx IS NULL THEN 200 ELSE cx + 50 END AS x_hi, CASE WHEN cx IS NULL THEN 5000 ELSE 1.5 * cy END AS y_hi FROM w),
a AS (SELECT length, 'commercial' AS curve, n::DOUBLE AS x, y FROM m UNION ALL SELECT length, 'own', n::DOUBLE, cost::DOUBLE FROM own)
SELECT z.length, curve, x, round(y, 4) AS y, round(cx, 4) AS crossover_x, round(cy, 4) AS crossover_y, round(x_lo::DOUBLE, 4) AS x_lo, round(x_hi::DOUBLE, 4) AS x_hi, round(y_hi::DOUBLE, 4) AS y_hi FROM z LEFT JOIN a ON a.length = z.length AND x BETWEEN x_lo AND x_hi AND y BETWEEN 0 AND y_hi"""


def _pool(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), F.round(F.col("p_retailprice")).alias("weight"))


def weighted_sample(spark, sf_dir):
    draws = _table(spark, sf_dir, "orders").select(simulate.uniform(F.lit(7), "o_orderkey").alias("u"))
    return simulate.draw(draws, _pool(spark, sf_dir)).groupBy("variant").agg(F.count("*").alias("n"))


_UNIFORM = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_CUTS_SQL = "pool AS (SELECT p_partkey AS variant, round(p_retailprice) AS weight FROM part), cuts AS (SELECT variant, (sum(weight) OVER (ORDER BY variant) - weight) / sum(weight) OVER () AS lo, CASE WHEN variant = max(variant) OVER () THEN 2 ELSE sum(weight) OVER (ORDER BY variant) / sum(weight) OVER () END AS hi FROM pool)"
WEIGHTED_SAMPLE = f"WITH {_CUTS_SQL}, u AS (SELECT {_UNIFORM.format(chr(39) + '7:' + chr(39) + ' || o_orderkey')} AS u FROM orders) SELECT variant, count(*) AS n FROM u JOIN cuts ON u >= lo AND u < hi GROUP BY variant"


def recovery_curve(spark, sf_dir):
    draws = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("rep"), (F.floor(F.col("o_orderkey") / 10) + 1).alias("k"), (F.col("o_custkey") % 200).alias("variant"))
    return simulate.recovery_curve(draws, 200).withColumn("y", F.round("y", 9))


RECOVERY_CURVE = """WITH d AS (SELECT o_orderkey % 10 AS rep, o_orderkey // 10 + 1 AS k, o_custkey % 200 AS v FROM orders), f AS (SELECT rep, v, min(k) AS k FROM d GROUP BY ALL), n AS (SELECT k, count(*) AS n FROM f GROUP BY k)
SELECT k AS x, round(sum(coalesce(n, 0)) OVER (ORDER BY k) / (SELECT count(DISTINCT rep) FROM d)::DOUBLE / 200, 9) AS y FROM (SELECT DISTINCT k FROM d) LEFT JOIN n USING (k)"""


def resynthesis_curve(spark, sf_dir):
    """Draws in proportion to the pool, the whole of part: three for every two variants, then a third of a variant each; as many replicates as the reference makes."""
    pool = _pool(spark, sf_dir)
    size = pool.count()
    return simulate.recovery_with_resynthesis(pool, size * 3 // 2, size // 3, True, 100, 3).withColumn("y", F.round("y", 9))


RESYNTHESIS_CURVE = f"""WITH {_CUTS_SQL}, size AS (SELECT count(*) * 3 // 2 AS t1, count(*) // 3 AS t2 FROM pool), reps AS (SELECT g AS rep FROM range(100) a(g)), ks AS (SELECT unnest(range(1, t1 + t2 + 1)) AS k FROM size), steps AS (SELECT rep, k, {_UNIFORM.format("'3:' || rep || ':' || k")} AS u FROM reps, ks),
one AS (SELECT rep, k, variant FROM steps JOIN cuts ON u >= lo AND u < hi WHERE k <= (SELECT t1 FROM size)),
un AS (SELECT rep, variant, row_number() OVER (PARTITION BY rep ORDER BY variant) - 1 AS r, count(*) OVER (PARTITION BY rep) AS m FROM (SELECT rep, variant FROM reps, pool EXCEPT SELECT rep, variant FROM one)),
two AS (SELECT s.rep, k, variant FROM (SELECT s.rep, k, CAST(floor(u * m) AS BIGINT) AS r FROM steps s JOIN (SELECT DISTINCT rep, m FROM un) USING (rep) WHERE k > (SELECT t1 FROM size)) s JOIN un ON s.rep = un.rep AND s.r = un.r),
f AS (SELECT rep, variant, min(k) AS k FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL), n AS (SELECT k, count(*) AS n FROM f GROUP BY k)
SELECT k AS x, round(sum(coalesce(n, 0)) OVER (ORDER BY k) / 100.0::DOUBLE / (SELECT count(*) FROM pool), 9) AS y FROM ks LEFT JOIN n USING (k)"""


def recovery_comparison(spark, sf_dir):
    """Recovery of the pool, the whole of part, with a resynthesis and without one, and where it was; ten replicates."""
    pool = _pool(spark, sf_dir)
    size = pool.count()
    return simulate.recovery_comparison(pool, size * 3 // 2, size // 3, 10, 3).withColumn("y", F.round("y", 9))


_TEN_SQL = RESYNTHESIS_CURVE.replace("range(100)", "range(10)").replace("100.0::DOUBLE", "10.0::DOUBLE")
RECOVERY_COMPARISON = f"""WITH again AS ({_TEN_SQL}), {RESYNTHESIS_CURVE[5:].split("one AS", 1)[0].replace("range(100)", "range(10)")}
first_seen AS (SELECT rep, variant, min(k) AS k FROM steps JOIN cuts ON u >= lo AND u < hi GROUP BY ALL), seen AS (SELECT k, count(*) AS n FROM first_seen GROUP BY k)
SELECT 'resynthesis' AS curve, x, y FROM again UNION ALL SELECT 'marker', x, y FROM again WHERE x = (SELECT t1 FROM size)
UNION ALL SELECT 'simple', k, round(sum(coalesce(n, 0)) OVER (ORDER BY k) / 10.0::DOUBLE / (SELECT count(*) FROM pool), 9) FROM ks LEFT JOIN seen USING (k)"""


def lognormal_fold(spark, sf_dir):
    s = simulate.sigma_of(4)
    rows = _table(spark, sf_dir, "orders").select(F.floor(F.log10(1000 * F.exp(-s * s / 2 + s * simulate.normal(F.lit(1), "o_orderkey"))) * 1e6).alias("x"))
    q = {p: stats.floor_quantile(rows, "x", p).withColumnRenamed("q", f"q{int(p * 100)}") for p in (0.1, 0.9)}
    return q[0.1].crossJoin(q[0.9]).select(F.round(F.pow(10.0, (F.col("q90") - F.col("q10")) / 1e6), 3).alias("fold"))  # one row each


LOGNORMAL_FOLD = f"""WITH s AS (SELECT ln(4) / (2 * {simulate.Z90}::DOUBLE) AS s), x AS (SELECT log10(1000 * exp(-s * s / 2 + s * sqrt(-2 * ln(greatest({_UNIFORM.format("'1:' || o_orderkey || ':a'")}, 1.1102230246251565e-16))) * cos(2 * pi() * {_UNIFORM.format("'1:' || o_orderkey || ':b'")}))) AS x FROM orders, s),
k AS (SELECT floor(x * 1e6) AS x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM x)
SELECT round(pow(10, (max(x) FILTER (i = floor(n * 0.9)) - max(x) FILTER (i = floor(n * 0.1))) / 1e6), 3) AS fold FROM k"""


def pileup(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("well"), (F.col("l_suppkey") % 40).cast("int").alias("pos"), F.translate(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in _KEY))), 1, 12), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    return demux.pileup_consensus(rows).select("well", "cons_seq", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


PILEUP = """WITH r AS (SELECT l_partkey % 50 AS well, l_suppkey % 40 AS pos, translate(substr(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM lineitem),
b AS (SELECT well, pos + i AS place, substr(s, i + 1, 1) AS base, count(*) AS n FROM r, range(12) x(i) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY well, place ORDER BY n DESC, base) AS k FROM b)
SELECT well, string_agg(base, '' ORDER BY place) AS cons_seq, CAST(min(place) AS INT) AS first, CAST(max(place) AS INT) AS last FROM t WHERE k = 1 GROUP BY well"""


def funnel(spark, sf_dir):
    return simulate.funnel(spark)


def coverage_sweep(spark, sf_dir):
    """The reference's defaults as coded: its number of simulations is not handed on, so each fold has the funnel's own."""
    return simulate.coverage_sweep(spark, n_sims=10_000)


def streamed_depths(spark, sf_dir):
    from ..streaming.wells import well_depths

    rows = _table(spark, sf_dir, "events").select("ts", F.format_string("FB%02d", F.col("user_id") % 96 + 1).alias("fbc_name"), F.format_string("RB%02d", F.col("event_id") % 32 + 1).alias("rbc_name"))
    return well_depths(rows).select(F.col("window.start").alias("window_start"), "well_pos", "depth")


STREAMED_DEPTHS = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, (rb // 4 + 1) || chr(CAST(64 + 2 * (fb // 12) + CASE WHEN rb % 4 < 2 THEN 1 ELSE 2 END AS INT)) || (2 * (fb % 12) + CASE WHEN rb % 2 = 0 THEN 1 ELSE 2 END) AS well_pos, count(*) AS depth FROM (SELECT ts, user_id % 96 AS fb, event_id % 32 AS rb FROM events) GROUP BY ALL"""

_LETTERS = "translate(substr(md5({}), 1, {}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_FASTQ_NAME = "CASE WHEN o_orderkey % 3 = 0 THEN '|ref=g' || o_orderkey % 7 ELSE '/1 lane' END"


def fastq_scan(spark, sf_dir):
    """Orders as FASTQ text, half of it compressed, written, found, split at places that fall inside records, read and counted."""
    k = F.col("o_orderkey")
    bases = F.translate(F.substring(F.md5(k.cast("string")), 1, (k % 20 + 1).cast("int")), "0123456789abcdef", "ACGTACGTACGTACGT")
    qual = F.translate(F.substring(F.md5(k.cast("string")), 1, (k % 20 + F.when(k % 50 == 0, 2).otherwise(1)).cast("int")), "0123456789abcdef", "!#%'@+-/13579;=I")
    name = F.concat(F.lit("r"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("|ref=g"), (k % 7).cast("string"))).otherwise(F.lit("/1 lane")))
    orders = _table(spark, sf_dir, "orders").select(k)
    root, n = storage.scratch(spark), _tasks(orders)

    def write(left, to, **options):
        # A compressed file is read by one task, so files are many.
        orders.where(k % 2 == left).repartition(n, k).select(F.concat_ws("\n", F.concat(F.lit("@"), name), bases, F.lit("+"), qual).alias("value")).write.options(**options).text(f"{root}/{to}")

    write(0, "plain")
    write(1, "packed", compression="gzip")
    reads = records.read_fastq(spark, root, "*.txt*", range_bytes=10_007, columns=("read_id", "seq", "qual", "malformed"))
    quality = F.when(~F.col("malformed"), F.round(seq.mean_quality("qual"), 6))
    reads = reads.select(stats.once(seq.normalize_id("read_id")).alias("name"), "malformed", seq.ref_tag("read_id").isNotNull().alias("tagged"), "seq", quality.alias("quality"))
    # Dealt before they are reduced: names are rare within a task, so reducing there would sort all rows for nothing.
    named = reads.repartition("name").groupBy("name").agg(F.count("*").alias("n"), F.count_if("malformed").alias("malformed"), F.count_if("tagged").alias("tagged"), F.sum(F.length("seq")).alias("bases"), F.max("quality").alias("best"), F.min("seq").alias("least"))
    sums = [F.sum(c).alias(c) for c in ("malformed", "tagged", "bases")]
    return named.groupBy((F.crc32("name") % 100).alias("lot")).agg(F.sum("n").alias("n"), F.count("name").alias("names"), *sums, F.max("best").alias("best"), F.min("least").alias("least"))


FASTQ_SCAN = """WITH r AS (SELECT o_orderkey AS k, 'r' || o_orderkey AS name, translate(substr(md5(o_orderkey::VARCHAR), 1, CAST(o_orderkey % 20 + 1 AS INT)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s, translate(substr(md5(o_orderkey::VARCHAR), 1, CAST(o_orderkey % 20 + CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END AS INT)), '0123456789abcdef', '!#%''@+-/13579;=I') AS q FROM orders),
b AS (SELECT *, (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(name)), lambda i: ascii(substr(name, i + 1, 1))::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))) AS crc FROM r)
SELECT xor(crc, 4294967295::BIGINT) % 100 AS lot, count(*) AS n, count(DISTINCT name) AS names, count(*) FILTER (k % 50 = 0) AS malformed, count(*) FILTER (k % 3 = 0) AS tagged, CAST(sum(length(s)) AS BIGINT) AS bases, max(round(list_sum(list_transform(string_split(q, ''), lambda x: ascii(x) - 33))::DOUBLE / length(q), 6)) FILTER (k % 50 <> 0) AS best, min(s) AS least FROM b GROUP BY lot"""


def streamed_fastq(spark, sf_dir):
    """Orders as FASTQ files, streamed a few files a batch until all are read: each file's records, lengths and tags."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("@r"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("|ref=g"), (k % 7).cast("string"))).otherwise(F.lit("")))
    bases = _letters(k.cast("string"), (k % 20 + 1).cast("int"))
    root, out, marks = (storage.scratch(spark) for _ in range(3))
    rows = _table(spark, sf_dir, "orders").select((k % 12).alias("lot"), F.concat_ws("\n", name, bases, F.lit("+"), F.when(k % 50 == 0, F.lit("")).otherwise(F.translate(bases, "ACGT", "I?5+"))).alias("value"))
    rows.repartition("lot").write.partitionBy("lot").text(root)
    reads = records.stream_fastq(spark, root, "*.txt", 5)
    reads.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    lot = F.regexp_extract("path", "lot=([0-9]+)", 1).cast("long")
    return spark.read.parquet(out).groupBy(lot.alias("lot")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.count_if("malformed").alias("malformed"), F.count(seq.ref_tag("read_id")).alias("tagged"), F.min("read_id").alias("least"))


STREAMED_FASTQ = f"""WITH r AS (SELECT o_orderkey AS k, CAST(o_orderkey % 20 + 1 AS BIGINT) AS n, 'r' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '|ref=g' || o_orderkey % 7 ELSE '' END AS id FROM orders)
SELECT k % 12 AS lot, count(*) AS n, CAST(sum(n) AS BIGINT) AS bases, count(*) FILTER (k % 50 = 0) AS malformed, count(*) FILTER (k % 3 = 0) AS tagged, min(id) AS least FROM r GROUP BY lot"""


def _tree_of_orders(spark, sf_dir):
    """A demultiplexed tree whose file ends are broken: fbc and rbc by barcode, refs by direction; two orders share a name. The path and the first order that may break."""
    k = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders").select(k)
    # In the order of their numbers, as the files have them.
    made = orders.repartitionByRange(_tasks(orders), k).select(k, F.concat(F.lit("r"), F.floor(k / 2).cast("string")).alias("name"), _letters(k.cast("string"), (k % 15 + 1).cast("int")).alias("bases"))
    # The parts of an order's record are made once, for all four sides.
    rows = storage.keep(made.withColumn("qual", F.translate("bases", "ACGT", "I?5+")))
    late = rows.agg(F.max("o_orderkey")).first()[0] // 10 * 9
    root = storage.scratch(spark)

    def write(side, lots, lot, name, breaks):
        # A file is a lot, the orders of one remainder, and is written by a task of its own.
        short = F.when((k > late) & breaks, F.lit("")).otherwise(F.col("qual"))
        text = F.concat_ws("\n", F.concat(F.lit("@"), name), "bases", F.lit("+"), short)
        dealt = rows.select(lot.alias("lot"), k, text.alias("value")).repartitionById(lots, (k % lots).cast("int"))
        dealt.sortWithinPartitions("lot", "o_orderkey").select("lot", "value").write.partitionBy("lot").text(f"{root}/{side}")

    part = lambda lots: F.concat(F.lit("part"), (k % lots).cast("string"))
    code = lambda lots: F.concat(F.lit("barcode0"), (k % lots + 1).cast("string"))
    sides = (
        ("fbc", 10, F.when(k % 10 == 9, "unclassified").otherwise(code(10)), F.concat("name", F.lit("/1")), (k % 100 == 7) | (k % 100 == 33)),
        ("rbc", 6, code(6), F.col("name"), k % 600 == 55),
        ("refs/fwd", 3, part(3), F.when(k % 4 == 0, F.concat("name", F.lit("|ref=g"), (k % 7).cast("string"))).otherwise(F.col("name")), k % 300 == 100),
        ("refs/rev", 2, part(2), F.when(k % 5 == 0, F.concat("name", F.lit("|ref=h"), (k % 3).cast("string"))).otherwise(F.col("name")), F.lit(False)),
    )
    # The sides are written beside each other: each has few files.
    with ThreadPoolExecutor(len(sides)) as pool:
        list(pool.map(lambda x: write(*x), sides))
    return root


def read_tree(spark, sf_dir):
    """A tree written, read in ranges up to each file's failure, and assembled: last record of each name wins."""
    reads, _ = records.create_read_df(spark, _tree_of_orders(spark, sf_dir), "*.txt", 30_011)
    return reads.withColumn("avg_qual", F.round("avg_qual", 9))


_TREE_SQL = f"""o AS (SELECT o_orderkey AS k, 'r' || o_orderkey // 2 AS name, substr({_LETTERS.format("o_orderkey::VARCHAR", 32)}, 1, CAST(o_orderkey % 15 + 1 AS INT)) AS s, o_orderkey > (SELECT max(o_orderkey) // 10 * 9 FROM orders) AS late FROM orders),
f AS (SELECT *, min(CASE WHEN late AND k % 100 IN (7, 33) THEN k END) OVER (PARTITION BY k % 10) AS bad FROM o WHERE k % 10 <> 9),
r AS (SELECT *, min(CASE WHEN late AND k % 600 = 55 THEN k END) OVER (PARTITION BY k % 6) AS bad FROM o),
m AS (SELECT *, 'fwd' AS side, k % 3 AS lot, min(CASE WHEN late AND k % 300 = 100 THEN k END) OVER (PARTITION BY k % 3) AS bad, CASE WHEN k % 4 = 0 THEN 'fwd:g' || k % 7 END AS ref FROM o UNION ALL SELECT *, 'rev', k % 2, NULL, CASE WHEN k % 5 = 0 THEN 'rev:h' || k % 3 END FROM o)"""
READ_TREE = f"""WITH {_TREE_SQL},
a AS (SELECT name, CAST(arg_max(k % 10, (k % 10, k)) AS INT) AS fbc FROM f WHERE bad IS NULL OR k < bad GROUP BY name), b AS (SELECT name, CAST(arg_max(k % 6, (k % 6, k)) AS INT) AS rbc FROM r WHERE bad IS NULL OR k < bad GROUP BY name),
c AS (SELECT name, arg_max(ref, (side, lot, k)) AS ref_name, arg_max(s, (side, lot, k)) AS read_seq FROM m WHERE ref IS NOT NULL AND (bad IS NULL OR k < bad) GROUP BY name)
SELECT name AS read_name, fbc, rbc, ref_name, read_seq, translate(read_seq, 'ACGT', 'I?5+') AS read_qual, round(list_sum(list_transform(string_split(translate(read_seq, 'ACGT', 'I?5+'), ''), lambda x: ascii(x) - 33))::DOUBLE / length(read_seq), 9) AS avg_qual FROM a FULL JOIN b USING (name) FULL JOIN c USING (name)"""


def tree_failures(spark, sf_dir):
    """Files of each kind that end at a broken record, and the names and malformed records of the whole files of each side."""
    tree = records.scan_tree(spark, _tree_of_orders(spark, sf_dir), "*.txt", 30_011)
    return records.tree_failures(tree).join(records.tree_names(tree).select("kind", "names"), "kind")


TREE_FAILURES = f"""WITH {_TREE_SQL}, z AS (SELECT *, min(CASE WHEN late AND k % 100 IN (7, 33) THEN k END) OVER (PARTITION BY k % 10) AS bad FROM o)
SELECT 'fbc' AS kind, (SELECT count(DISTINCT k % 10) FROM f WHERE bad IS NOT NULL) AS files, (SELECT count(DISTINCT name) FROM z WHERE bad IS NULL) AS names
UNION ALL SELECT 'rbc', (SELECT count(DISTINCT k % 6) FROM r WHERE bad IS NOT NULL), (SELECT count(DISTINCT name) FROM r WHERE bad IS NULL)
UNION ALL SELECT 'ref', (SELECT count(DISTINCT (side, lot)) FROM m WHERE bad IS NOT NULL), (SELECT count(DISTINCT coalesce(name || '|ref=' || ref[5:], name)) FROM m WHERE bad IS NULL)"""


def reference_files(spark, sf_dir):
    """Parts as multi-line FASTA text, written and read back, with the lengths of their sequences."""
    k = F.col("p_partkey")
    text = F.concat(F.lit(">g"), k.cast("string"), F.lit(" "), F.col("p_brand"), F.lit("\n"), _letters(k.cast("string"), (k % 20 + 1).cast("int")), F.lit("\n"), _letters(F.col("p_name"), 12))
    path = storage.scratch(spark)
    _table(spark, sf_dir, "part").select(text.alias("value")).write.text(path)
    return records.read_fasta(spark, path).select("ref_id", "ref_seq", F.length("ref_seq").alias("ref_len"))


REFERENCE_FILES = f"""SELECT 'g' || p_partkey AS ref_id, s AS ref_seq, CAST(length(s) AS INT) AS ref_len FROM (SELECT p_partkey, substr({_LETTERS.format("p_partkey::VARCHAR", 32)}, 1, CAST(p_partkey % 20 + 1 AS INT)) || {_LETTERS.format("p_name", 12)} AS s FROM part)"""


def kit_files(spark, sf_dir):
    """Suppliers as a barcode CSV, read back with their places and written as a kit's FASTA text; fewer than a hundred numbers have two digits."""
    path = storage.scratch(spark)
    rows = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.concat(F.lit("FB"), F.col("s_suppkey").cast("string")).alias("name"), _letters(F.col("s_name"), 16).alias("refseq"))
    records.write_csv(rows, path)
    kit = records.read_barcodes(spark, path)
    return kit.select("idx", "name", "barcode").join(records.barcode_fasta(kit, "fbc").select(F.col("value").alias("fasta"), F.element_at(F.split("value", "\n"), -1).alias("barcode")), "barcode")


KIT_FILES = f"""SELECT CAST(i AS INT) AS idx, 'FB' || s_suppkey AS name, b AS barcode, '>{records.KIT}-fbc-' || CASE WHEN i < 9 THEN '0' ELSE '' END || (i + 1) || chr(10) || b AS fasta FROM (SELECT s_suppkey, {_LETTERS.format("s_name", 16)} AS b, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier)"""


def sam_fastq(spark, sf_dir):
    """Orders as SAM text, read back; mapped reads of each direction as tagged FASTQ, the reverse ones turned."""
    k = F.col("o_orderkey")
    bases = F.when(k % 11 == 0, F.lit("*")).otherwise(F.translate(F.substring(F.md5(k.cast("string")), 1, 9), "0123456789abcdef", "ACGTNCGTACRTACGY"))
    qual = F.when(k % 5 == 0, F.lit("*")).otherwise(F.translate(F.substring(F.md5(k.cast("string")), 1, 9), "0123456789abcdef", "!#%'@+-/13579;=I"))
    line = F.concat_ws("\t", F.concat(F.lit("q"), k.cast("string")), F.when(k % 7 == 0, "4").otherwise("0"), F.concat(F.lit("g"), (k % 3).cast("string")), F.lit("1"), F.lit("60"), F.lit("9M"), F.lit("*"), F.lit("0"), F.lit("0"), bases, qual)
    path = storage.scratch(spark)
    _table(spark, sf_dir, "orders").select(F.when(k % 100 == 0, F.concat(F.lit("@CO\t"), k.cast("string"))).otherwise(line).alias("value")).write.text(path)
    sam = records.read_sam(spark, path)
    return records.tagged_fastq(sam.where("rname = 'g0'")).unionByName(records.tagged_fastq(sam.where("rname <> 'g0'"), "reverse")).withColumnRenamed("value", "record")


SAM_FASTQ = """WITH s AS (SELECT o_orderkey AS k, translate(substr(md5(o_orderkey::VARCHAR), 1, 9), '0123456789abcdef', 'ACGTNCGTACRTACGY') AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'IIIIIIIII' ELSE translate(substr(md5(o_orderkey::VARCHAR), 1, 9), '0123456789abcdef', '!#%''@+-/13579;=I') END AS q FROM orders WHERE o_orderkey % 100 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
SELECT '@q' || k || '|ref=g' || k % 3 || chr(10) || CASE WHEN k % 3 = 0 THEN s ELSE reverse(translate(s, 'ACGTRY', 'TGCAYR')) END || chr(10) || '+' || chr(10) || CASE WHEN k % 3 = 0 THEN q ELSE reverse(q) END AS record FROM s"""


def bam_reads(spark, sf_dir):
    """Orders as alignments written to BAM files, read back in ranges that fall inside blocks and records."""
    k = F.col("o_orderkey")
    n = (k % 32 + 1).cast("int")
    rows = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("q"), k.cast("string")).alias("qname"), F.when(k % 7 == 0, 4).otherwise(16 * (k % 2)).cast("int").alias("flag"), F.when(k % 7 > 0, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("rname"),
        F.when(k % 7 == 0, 0).otherwise(k % 1000 + 1).cast("int").alias("pos"), F.when(k % 7 > 0, F.concat(n.cast("string"), F.lit("M"))).alias("cigar"), F.when(k % 11 > 0, _letters(k.cast("string"), n)).alias("seq"),
        F.when((k % 11 > 0) & (k % 5 > 0), F.translate(_letters(k.cast("string"), n), "ACGT", "I?5+")).alias("qual"),
    )
    path = storage.scratch(spark)
    bam.write_bam(rows, path, [(f"g{i}", 2000) for i in range(3)])
    return bam.read_bam(spark, path, range_bytes=50_021).drop("path", "mapq")


BAM_READS = f"""WITH s AS (SELECT o_orderkey AS k, CAST(o_orderkey % 32 + 1 AS INT) AS n, substr({_LETTERS.format("o_orderkey::VARCHAR", 32)}, 1, CAST(o_orderkey % 32 + 1 AS INT)) AS s FROM orders)
SELECT 'q' || k AS qname, CAST(CASE WHEN k % 7 = 0 THEN 4 ELSE 16 * (k % 2) END AS INT) AS flag, CASE WHEN k % 7 > 0 THEN 'g' || k % 3 END AS rname, CAST(CASE WHEN k % 7 = 0 THEN 0 ELSE k % 1000 + 1 END AS INT) AS pos, CASE WHEN k % 7 > 0 THEN n || 'M' END AS cigar,
  CASE WHEN k % 11 > 0 THEN s END AS seq, CASE WHEN k % 11 > 0 AND k % 5 > 0 THEN translate(s, 'ACGT', 'I?5+') END AS qual FROM s"""


def formatted_reads(spark, sf_dir):
    """Reads with barcode names, wells and references looked up; incomplete ones go."""
    reads = _lines(spark, sf_dir).select("read_name", F.when(F.col("l_quantity") > 2, F.col("l_partkey") % 100).alias("fbc"), (F.col("l_suppkey") % 32).alias("rbc"), F.when(F.col("l_tax") > 0, F.concat(F.lit("rev:x:"), "l_returnflag")).alias("ref_name"))
    kit = lambda name, n: spark.range(n).select(F.col("id").alias("idx"), F.format_string(f"{name}%02d", F.col("id") + 1).alias("name"))
    references = spark.createDataFrame([("x:A", "ACGT"), ("x:R", "ACGTACG")], "ref_id string, ref_seq string")
    found = demux.format_reads(reads, kit("FB", 96), kit("RB", 32), references)
    return found.select("read_name", "fbc_name", "rbc_name", "well_pos", "ref_id", "ref_seq", F.col("ref_len").cast("long").alias("ref_len"))


FORMATTED_READS = f"""WITH {_LINES_SQL}, k AS (SELECT read_name, l_partkey % 100 AS fb, l_suppkey % 32 AS rb, l_returnflag AS f FROM lines WHERE l_quantity > 2 AND l_tax > 0 AND l_partkey % 100 < 96)
SELECT read_name, 'FB' || lpad((fb + 1)::VARCHAR, 2, '0') AS fbc_name, 'RB' || lpad((rb + 1)::VARCHAR, 2, '0') AS rbc_name, (rb // 4 + 1) || chr(CAST(64 + 2 * (fb // 12) + CASE WHEN rb % 4 < 2 THEN 1 ELSE 2 END AS INT)) || (2 * (fb % 12) + CASE WHEN rb % 2 = 0 THEN 1 ELSE 2 END) AS well_pos, 'x:' || f AS ref_id, CASE f WHEN 'A' THEN 'ACGT' WHEN 'R' THEN 'ACGTACG' END AS ref_seq, CAST(CASE f WHEN 'A' THEN 4 WHEN 'R' THEN 7 END AS BIGINT) AS ref_len FROM k"""


def well_export(spark, sf_dir):
    """The wells that reads of the first plate's small lines name, as the sorted well map."""
    reads = _reads(spark, sf_dir)
    guard = _table(spark, sf_dir, "supplier").select(seq.barcode_to_well(F.lit("FB01"), F.format_string("RB%02d", F.col("s_suppkey") % 40 + 1)).alias("well_pos"))
    return demux.well_map(demux.wells_with(demux.well_summary(reads), guard)).select("plate", "well", "global_well", "depth")


WELL_EXPORT = f"""WITH {_READS_SQL} SELECT CAST(plate AS INT) AS plate, row || col AS well, plate || row || col AS global_well, CAST(depth AS BIGINT) AS depth FROM ranked
WHERE rk = 1 AND plate || row || col IN (SELECT (rb // 4 + 1) || chr(CAST(64 + CASE WHEN rb % 4 < 2 THEN 1 ELSE 2 END AS INT)) || CASE WHEN rb % 2 = 0 THEN 1 ELSE 2 END FROM (SELECT s_suppkey % 40 AS rb FROM supplier) WHERE rb < 32)"""


def labels(spark, sf_dir):
    """Numbers, labels, paths and qualities as text."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    big = F.floor(price) * F.element_at(F.array(*(F.lit(10**e).cast("long") for e in (0, 1, 4, 7, 9))), (k % 5 + 1).cast("int"))
    tie = (big % 100 == 50) & (big < 10**6) & (big >= 1000) | (big % 10**5 == 50_000) & (big >= 10**6)  # engines round these apart
    path = F.concat(F.lit("run/"), F.when(k % 6 == 0, "unclassified").otherwise("barcode"), F.format_string("%02d", k % 130), F.lit("/barcode99.fastq"))
    ref = F.concat(F.lit("fwd:"), "o_orderpriority", F.lit(":"), "o_orderstatus")
    quals = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: ((k + i * 7) % 42).cast("int"))
    rows = _table(spark, sf_dir, "orders").where(~path.contains("unclassified"))
    return rows.select(
        "o_orderkey", seq.human_number(big).alias("human"), F.when(~tie, seq.reads_label(big)).alias("reads"), seq.barcode_index(path).alias("barcode"), seq.strip_direction(ref).alias("ref_id"), seq.last_part(ref).alias("last"), seq.phred_encode(quals).alias("qual"),
        F.array_join(seq.phred_decode(seq.phred_encode(F.reverse(quals))), ",").alias("turned"), seq.fill_quality(F.when(k % 2 == 0, seq.phred_encode(quals)), F.repeat(F.lit("A"), (k % 4).cast("int"))).alias("filled"),
    )


LABELS = """WITH o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) * [1, 10, 10000, 10000000, 1000000000][o_orderkey % 5 + 1]::BIGINT AS big, list_transform(range(o_orderkey % 9 + 1), lambda i: CAST((o_orderkey + i * 7) % 42 AS INT)) AS q FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_orderkey, CASE WHEN big < 1000 THEN big::VARCHAR WHEN big < 1e6::DOUBLE THEN CAST(round_even(big / 1e3::DOUBLE, 0) AS BIGINT) || 'k' WHEN big < 1e9::DOUBLE THEN CAST(round_even(big / 1e6::DOUBLE, 0) AS BIGINT) || 'M' WHEN big < 1e12::DOUBLE THEN CAST(round_even(big / 1e9::DOUBLE, 0) AS BIGINT) || 'B' ELSE format('{:.1f}', round_even(big / 1e12::DOUBLE, 1)) || 'T' END AS human,
  CASE WHEN big >= 1000000 AND big % 100000 = 50000 OR big BETWEEN 1000 AND 999999 AND big % 100 = 50 THEN NULL WHEN big < 1000 THEN big::VARCHAR WHEN big < 1000000 THEN format('{:.1f}', big / 1e3::DOUBLE) || 'k' ELSE format('{:.1f}', big / 1e6::DOUBLE) || 'M' END AS reads, CAST(o_orderkey % 130 - 1 AS INT) AS barcode, o_orderpriority || ':' || o_orderstatus AS ref_id, o_orderstatus AS last,
  array_to_string(list_transform(q, lambda x: chr(x + 33)), '') AS qual, array_to_string(list_reverse(q), ',') AS turned, CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(list_transform(q, lambda x: chr(x + 33)), '') ELSE repeat('I', o_orderkey % 4) END AS filled FROM o"""


def quality_hist(spark, sf_dir):
    """Mean qualities in 50 bins with densities, and the labels that go with them."""
    rows = mean_quality(spark, sf_dir)
    bins = stats.histogram(rows, F.col("avg_qual"), density=True).select("bin", F.round("lo", 6).alias("lo"), "n", F.round("density", 6).alias("density"))
    marks = rows.agg(F.round(F.median("avg_qual"), 6).alias("median"), F.concat(F.lit("90% above Q"), F.floor(F.percentile("avg_qual", F.lit(0.1))).cast("string")).alias("label"))
    return bins.crossJoin(F.broadcast(marks))  # one row


QUALITY_HIST = f"""WITH v AS (SELECT avg_qual AS x FROM ({MEAN_QUALITY}) WHERE avg_qual IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS total, round(median(x), 6) AS median, '90% above Q' || CAST(floor(quantile_cont(x, 0.1)) AS INT) AS label FROM v),
b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INT) AS bin, * FROM v, e)
SELECT bin, round(any_value(lo + bin * ((hi - lo) / 50)), 6) AS lo, count(*) AS n, round(count(*) / any_value(total * ((hi - lo) / 50)), 6) AS density, any_value(median) AS median, any_value(label) AS label FROM b GROUP BY bin"""


def alignment_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    overlap = demux.name_overlap(rows.where("l_quantity < 30").select("read_name"), rows.where("l_quantity > 20").select("read_name"))
    return demux.alignment_stats(rows.agg(F.count("*").alias("n")), overlap)


ALIGNMENT_STATS = f"""WITH o AS ({NAME_OVERLAP}), t AS (SELECT count(*) AS n FROM lineitem)
SELECT n, fwd_reads + rev_reads AS mapped, round_even(100.0::DOUBLE * fwd_reads / n, 1) AS fwd_pct, round_even(100.0::DOUBLE * rev_reads / n, 1) AS rev_pct, round_even(100.0::DOUBLE * "both" / n, 1) AS both_pct FROM o, t"""


def _letters(text, n):
    return F.translate(F.substring(F.md5(text), 1, n), "0123456789abcdef", "ACGTACGTACGTACGT")


def _kit(spark, n=12):
    name = F.concat(F.lit("kit"), F.col("id").cast("string"))
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("B"), F.col("id").cast("string")).alias("name"), _letters(name, 16).alias("barcode"))


def _code(number, kind):
    """A barcode of the kit, or one of two that it lacks, whole, with a letter changed, or one lost."""
    code = _letters(F.concat(F.lit("kit"), number.cast("string")), 16)
    return F.when(kind == 0, code).when(kind == 1, F.concat(F.substring(code, 1, 7), F.lit("A"), F.substring(code, 9, 8))).otherwise(F.concat(F.substring(code, 1, 4), F.substring(code, 6, 11)))


def _coded_reads(spark, sf_dir):
    k = F.col("o_orderkey")
    read = F.concat(F.repeat(F.lit("G"), (k % 5).cast("int")), _code(k % 14, k % 3), _letters(k.cast("string"), 12))
    return _table(spark, sf_dir, "orders").select(k, k.cast("string").alias("read_name"), read.alias("read_seq"), F.translate(read, "ACGT", "I?5+").alias("read_qual"))


def barcode_calls(spark, sf_dir):
    """Barcodes of reads whose starts have one with a letter changed, lost or neither, or none: distance, place, and what is left of the read."""
    found = demux.demultiplex(_coded_reads(spark, sf_dir), _kit(spark))
    return found.select("read_name", "idx", F.when(F.col("distance") <= 4, F.col("distance")).alias("distance"), "front_start", "front_end", "read_seq", "read_qual")


_KIT_SQL = f"kit AS (SELECT CAST(g AS INT) AS idx, 'B' || g AS name, {_LETTERS.format("'kit' || g", 16)} AS code FROM range(12) a(g))"


def _code_sql(number, kind):
    code = _LETTERS.format(f"'kit' || {number}", 16)
    return f"CASE {kind} WHEN 0 THEN {code} WHEN 1 THEN substr({code}, 1, 7) || 'A' || substr({code}, 9, 8) ELSE substr({code}, 1, 4) || substr({code}, 6, 11) END"


def _near_sql(reads, text):
    """(k, idx, p: distance up to four, end, length) of the substring of each text that is nearest to each code: the least distance, then the first end, then the shortest."""
    return f"""(SELECT * FROM (SELECT k, idx, min({{'d': levenshtein(substr(s, CAST(e - l + 1 AS INT), CAST(l AS INT)), code), 'e': e, 'l': l}}) AS p FROM (SELECT k, {text} AS s FROM {reads}), kit, range(12, 41) x(e), range(12, 21) y(l) WHERE l <= e AND e <= length(s) GROUP BY k, idx) WHERE p.d <= 4)"""


_CODED_SQL = f"r AS (SELECT o_orderkey AS k, repeat('G', o_orderkey % 5) || {_code_sql('o_orderkey % 14', 'o_orderkey % 3')} || {_LETTERS.format('o_orderkey::VARCHAR', 12)} AS s FROM orders)"
_CALLED_SQL = f"""{_KIT_SQL}, {_CODED_SQL}, d AS {_near_sql("r", "substr(s, 1, 40)")},
o AS (SELECT k, idx, p, row_number() OVER w AS rk, lead(p.d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY k ORDER BY p.d, idx)),
c AS (SELECT r.k, s, p.d AS distance, CASE WHEN coalesce(d2 - p.d, 1) >= 1 THEN idx END AS idx, p FROM r LEFT JOIN (SELECT * FROM o WHERE rk = 1) o ON r.k = o.k)"""
BARCODE_CALLS = f"""WITH {_CALLED_SQL}
SELECT k::VARCHAR AS read_name, idx, CAST(distance AS INT) AS distance, CASE WHEN idx IS NOT NULL THEN CAST(p.e - p.l AS INT) END AS front_start, CASE WHEN idx IS NOT NULL THEN CAST(p.e AS INT) END AS front_end,
  CASE WHEN idx IS NULL THEN s ELSE substr(s, CAST(p.e + 1 AS INT)) END AS read_seq, translate(CASE WHEN idx IS NULL THEN s ELSE substr(s, CAST(p.e + 1 AS INT)) END, 'ACGT', 'I?5+') AS read_qual FROM c"""


def barcode_both_ends(spark, sf_dir):
    """Reads that need the barcode at both ends, the rear one turned; some have another there, or none."""
    k = F.col("o_orderkey")
    rear = seq.reverse_complement(_code(F.when(k % 7 == 0, (k + 1) % 14).otherwise(k % 14), k % 4))
    reads = _coded_reads(spark, sf_dir).select("read_name", F.concat("read_seq", F.when(k % 11 == 0, F.lit("")).otherwise(rear), F.repeat(F.lit("T"), (k % 3).cast("int"))).alias("read_seq"))
    found = demux.demultiplex(reads, _kit(spark), window=24, ends="both")
    return found.where("idx is not null").select("read_name", "barcode", "distance", "front_start", "front_end", "rear_start", "rear_end", "read_seq")


_TURN_SQL = "reverse(translate({}, 'ACGT', 'TGCA'))"
BARCODE_BOTH_ENDS = f"""WITH {_KIT_SQL}, {_CODED_SQL}, t AS (SELECT k, s || CASE WHEN k % 11 = 0 THEN '' ELSE {_TURN_SQL.format(_code_sql("CASE WHEN k % 7 = 0 THEN (k + 1) % 14 ELSE k % 14 END", "k % 4"))} END || repeat('T', k % 3) AS s FROM r),
f AS {_near_sql("t", "substr(s, 1, 24)")}, b AS {_near_sql("t", "substr(" + _TURN_SQL.format("s") + ", 1, 24)")},
d AS (SELECT k, idx, greatest(f.p.d, b.p.d) AS d, f.p AS f, b.p AS b FROM f JOIN b USING (k, idx)),
o AS (SELECT *, row_number() OVER w AS rk, lead(d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY k ORDER BY d, idx))
SELECT k::VARCHAR AS read_name, 'B' || idx AS barcode, CAST(d AS INT) AS distance, CAST(f.e - f.l AS INT) AS front_start, CAST(f.e AS INT) AS front_end, CAST(length(s) - b.e AS INT) AS rear_start, CAST(length(s) - b.e + b.l AS INT) AS rear_end,
  substr(s, CAST(f.e + 1 AS INT), CAST(greatest(length(s) - b.e - f.e, 0) AS INT)) AS read_seq FROM o JOIN t USING (k) WHERE rk = 1 AND coalesce(d2 - d, 1) >= 1"""


def batch_demux(spark, sf_dir):
    """Reads in files of very unequal sizes, written, framed by ranges, the first of each demultiplexed: a row a file and barcode."""
    k = F.col("o_orderkey")
    reads = _coded_reads(spark, sf_dir)
    lot = F.when(k % 2 == 0, 0).when(k % 4 == 1, 1).when(k % 8 == 3, 2).otherwise(3).alias("lot")
    root = storage.scratch(spark)
    # All rows of a lot are written by one task, in order, as one file.
    reads.select(lot, "o_orderkey", records.record_text().alias("value")).repartition(4, "lot").sortWithinPartitions("lot", "o_orderkey").select("lot", "value").write.partitionBy("lot").text(root)
    most = reads.count() // 8
    called = barcodes.batch_demux(spark, root, _kit(spark), most, "*.txt", 20_011)
    by = F.regexp_extract("path", r"lot=(\d+)", 1).cast("int").alias("lot")
    found = barcodes.barcode_summary(called.select(by, "barcode", F.when(F.col("idx").isNotNull(), F.col("distance")).alias("distance"), "read_seq"), _kit(spark), ("lot",))
    return found.select("lot", "barcode", "reads", F.round("share", 9).alias("share"), F.round("mean_distance", 9).alias("mean_distance"), "bases")


BATCH_DEMUX = f"""WITH {_CALLED_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY k) AS i FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 0 WHEN k % 4 = 1 THEN 1 WHEN k % 8 = 3 THEN 2 ELSE 3 END AS lot FROM c)),
m AS (SELECT lot, coalesce('B' || idx, 'unclassified') AS barcode, count(*) AS reads, avg(distance) FILTER (idx IS NOT NULL) AS mean_distance, CAST(sum(length(s) - CASE WHEN idx IS NULL THEN 0 ELSE p.e END) AS BIGINT) AS bases FROM n WHERE i <= (SELECT count(*) // 8 FROM orders) GROUP BY ALL),
e AS (SELECT lot, barcode FROM (SELECT DISTINCT lot FROM m), (SELECT name AS barcode FROM kit UNION ALL SELECT 'unclassified'))
SELECT CAST(lot AS INT) AS lot, barcode, coalesce(reads, 0) AS reads, round(coalesce(reads, 0) / sum(reads) OVER (PARTITION BY lot), 9) AS share, round(mean_distance, 9) AS mean_distance, coalesce(bases, 0) AS bases FROM e LEFT JOIN m USING (lot, barcode)"""

_REF_SQL = " || ".join(_LETTERS.format(f"'{part}' || g", 32) for part in "abcd")


def _references(spark, n):
    text = F.concat(*(F.translate(F.md5(F.concat(F.lit(part), F.col("id").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT") for part in "abcd"))
    return spark.range(n).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("ref_id"), text.alias("ref_seq"))


def read_alignment(spark, sf_dir):
    """Reads cut from references at known places, some with a letter changed in their middle, every other one reversed: where they align and how."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(k, F.concat(F.lit("g"), (k % 40).cast("string")).alias("ref_id")).join(F.broadcast(_references(spark, 40)), "ref_id")  # 40 rows
    cut = F.substr("ref_seq", (k % 60 + 1).cast("int"), F.lit(60))
    changed = F.when(k % 3 == 0, F.concat(F.substring(cut, 1, 29), F.translate(F.substring(cut, 30, 1), "ACGT", "CATG"), F.substring(cut, 31, 30))).otherwise(cut)
    reads = rows.select(F.concat(F.lit("q"), k.cast("string")).alias("read_name"), F.when(k % 2 == 0, seq.reverse_complement(changed)).otherwise(changed).alias("read_seq"))
    return align.align_reads(reads, _references(spark, 40)).select("read_name", "ref_id", "strand", "pos", "cigar", "score")


READ_ALIGNMENT = """SELECT 'q' || o_orderkey AS read_name, 'g' || o_orderkey % 40 AS ref_id, CASE WHEN o_orderkey % 2 = 0 THEN 'rev' ELSE 'fwd' END AS strand, CAST(o_orderkey % 60 AS INT) AS pos, '60M' AS cigar, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 59 * 2 - 4 ELSE 120 END AS INT) AS score FROM orders"""


def gapped_alignment(spark, sf_dir):
    """Reads cut from references, whole, with a letter changed, three lost or two gained at some place, every third one reversed, all of one name."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(k, "o_custkey", F.concat(F.lit("g"), (k % 40).cast("string")).alias("ref_id")).join(F.broadcast(_references(spark, 40)), "ref_id")  # 40 rows
    cut, at = F.substr("ref_seq", (F.col("o_custkey") % 60 + 1).cast("int"), F.lit(60)), (20 + k % 17).cast("int")
    left = F.substr(cut, F.lit(1), at)
    changed = F.when(k % 4 == 0, cut).when(k % 4 == 1, F.concat(left, F.translate(F.substr(cut, at + 1, F.lit(1)), "ACGT", "CATG"), F.substr(cut, at + 2))).when(k % 4 == 2, F.concat(left, F.substr(cut, at + 4))).otherwise(F.concat(left, F.lit("CA"), F.substr(cut, at + 1)))
    reads = rows.select(F.lit("read").alias("read_name"), k, F.when(k % 3 == 0, seq.reverse_complement(changed)).otherwise(changed).alias("read_seq"))
    found = index.map_reads(reads, _references(spark, 40), clip=False)
    letters = lambda op: F.aggregate(F.regexp_extract_all("cigar", F.lit(f"(\\d+){op}"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))
    return found.select("read_name", "o_orderkey", "ref_id", "flag", "pos", "score", "edits", letters("I").alias("gained"), letters("D").alias("lost"))


#: The edits are the least distance to any stretch of the reference; the score follows from them and from what kind of gap there is.
GAPPED_ALIGNMENT = f"""WITH r AS (SELECT o_orderkey AS k, o_custkey % 60 AS p, 20 + o_orderkey % 17 AS a, {_REF_SQL.replace("|| g", "|| o_orderkey % 40")} AS ref FROM orders),
c AS (SELECT *, substr(ref, CAST(p + 1 AS INT), 60) AS s FROM r),
t AS (SELECT k, p, ref, CASE k % 4 WHEN 0 THEN s WHEN 1 THEN left(s, CAST(a AS INT)) || translate(substr(s, CAST(a + 1 AS INT), 1), 'ACGT', 'CATG') || substr(s, CAST(a + 2 AS INT)) WHEN 2 THEN left(s, CAST(a AS INT)) || substr(s, CAST(a + 4 AS INT)) ELSE left(s, CAST(a AS INT)) || 'CA' || substr(s, CAST(a + 1 AS INT)) END AS s FROM c),
e AS (SELECT k, p, min(levenshtein(s, substr(ref, CAST(x + 1 AS INT), CAST(n AS INT)))) AS edits FROM t, range(68) u(x), range(57, 63) v(n) WHERE abs(x - p) <= 4 GROUP BY k, p)
SELECT 'read' AS read_name, k AS o_orderkey, 'g' || k % 40 AS ref_id, CAST(CASE WHEN k % 3 = 0 THEN 16 ELSE 0 END AS INT) AS flag, CAST(p AS INT) AS pos, CAST(CASE k % 4 WHEN 2 THEN 2 * 57 - 4 - 2 * edits WHEN 3 THEN 2 * 60 - 4 - 2 * edits ELSE 2 * 60 - 6 * edits END AS INT) AS score,
  CAST(edits AS INT) AS edits, CAST(CASE WHEN k % 4 = 3 THEN edits ELSE 0 END AS INT) AS gained, CAST(CASE WHEN k % 4 = 2 THEN edits ELSE 0 END AS INT) AS lost FROM e"""


def quality_consensus(spark, sf_dir):
    """Wells of reads with an error each in two of three, mapped, piled up by quality: letters and the odds of each call."""
    k, w, start = F.col("o_orderkey"), F.col("o_custkey") % 60, (F.floor(F.col("o_totalprice")) % 68).cast("int")
    at = (k % 60).cast("int")
    rows = _table(spark, sf_dir, "orders").select(k, w.alias("w"), start.alias("start")).join(F.broadcast(_references(spark, 60).withColumn("w", F.expr("CAST(substr(ref_id, 2) AS BIGINT)"))), "w")  # 60 rows
    cut = F.substr("ref_seq", F.col("start") + 1, F.lit(60))
    read = F.when(k % 3 == 0, cut).otherwise(F.concat(F.substr(cut, F.lit(1), at), F.translate(F.substr(cut, at + 1, F.lit(1)), "ACGT", "GTAC"), F.substr(cut, at + 2)))
    level = F.element_at(F.array(*(F.lit(x) for x in "5?I")), (k % 7 % 3 + 1).cast("int"))
    qual = F.concat(F.repeat(level, at), F.when(k % 5 == 0, level).otherwise(F.lit("+")), F.repeat(level, 59 - at))
    reads = rows.select(F.col("w").cast("string").alias("well"), F.col("ref_id").alias("own"), read.alias("read_seq"), F.when(k % 11 > 0, qual).alias("read_qual"))
    aligned = index.map_reads(reads, _references(spark, 60), direction="forward", clip=False).where("ref_id = own")
    return align.gapped_consensus(aligned, weighted=True)


QUALITY_CONSENSUS = f"""WITH r AS (SELECT o_orderkey AS k, o_custkey % 60 AS w, CAST(floor(o_totalprice) AS BIGINT) % 68 AS start, o_orderkey % 60 AS spot FROM orders), s AS (SELECT g, {_REF_SQL.replace("|| g", "|| x.g")} AS s FROM range(60) x(g)),
b AS (SELECT w, start + i AS place, CASE WHEN i = spot AND k % 3 > 0 THEN translate(substr(s, CAST(start + i + 1 AS INT), 1), 'ACGT', 'GTAC') ELSE substr(s, CAST(start + i + 1 AS INT), 1) END AS base,
  CASE WHEN k % 11 = 0 THEN 40 WHEN i = spot AND k % 5 > 0 THEN 10 ELSE [20, 30, 40][k % 7 % 3 + 1] END AS q FROM r JOIN s ON g = w, range(60) y(i)),
n AS (SELECT w, place, base, count(*) AS n, sum(round(1000 * log10(3 * (1 - pow(10, -q / 10.0::DOUBLE)) / pow(10, -q / 10.0::DOUBLE)))) AS v FROM b GROUP BY ALL),
o AS (SELECT *, row_number() OVER x AS rk, v - coalesce(lead(v) OVER x, 0) AS margin FROM n WINDOW x AS (PARTITION BY w, place ORDER BY v DESC, n DESC, base))
SELECT w::VARCHAR AS well, string_agg(base, '' ORDER BY place) AS cons_seq, string_agg(chr(CAST(33 + least(60, floor(margin / 100)) AS INT)), '' ORDER BY place) AS cons_qual FROM o WHERE rk = 1 GROUP BY w"""


def consensus_check(spark, sf_dir):
    """Wells whose reads agree on a letter changed, lost or gained, aligned, piled up, realigned and classed; one read in ten has an error of its own."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("w"), F.col("l_orderkey").alias("k"), F.concat_ws(":", *(F.col(c).cast("string") for c in _KEY)).alias("name"))
    own = rows.join(F.broadcast(_references(spark, 60).withColumn("w", F.expr("CAST(substr(ref_id, 2) AS BIGINT)"))), "w")  # 60 rows
    s, w = F.col("ref_seq"), F.col("w")
    turned = F.translate(F.substring(s, 50, 1), "ACGT", "CATG")
    truth = F.when(w % 4 == 1, F.concat(F.substring(s, 1, 49), turned, F.substring(s, 51, 78))).when(w % 4 == 2, F.concat(F.substring(s, 1, 49), F.substring(s, 51, 78))).when(w % 4 == 3, F.concat(F.substring(s, 1, 50), turned, F.substring(s, 51, 78))).otherwise(s)
    read = F.when(F.col("k") % 10 == 0, F.concat(F.substring(truth, 1, 19), F.translate(F.substring(truth, 20, 1), "ACGT", "TGCA"), F.substring(truth, 21, 120))).otherwise(truth)
    reads = own.select("name", w.cast("string").alias("well"), "ref_id", read.alias("read_seq"), "ref_seq", F.lit(0).alias("offset"))
    aligned = align.align_pairs(reads)
    wells = _references(spark, 60).select(F.substr("ref_id", F.lit(2)).alias("global_well"), F.col("ref_id").alias("major_ref"), "ref_seq", F.length("ref_seq").alias("ref_len"))
    found = align.well_consensus(wells, aligned)
    return demux.classify_consensus(found).select("global_well", "cons_seq", "cons_check", "identity")


CONSENSUS_CHECK = f"""WITH w AS (SELECT DISTINCT l_partkey % 60 AS g FROM lineitem), s AS (SELECT x.g, {_REF_SQL.replace("|| g", "|| x.g")} AS s, w.g IS NOT NULL AS there FROM range(60) x(g) LEFT JOIN w ON x.g = w.g),
c AS (SELECT g, s, CASE WHEN there THEN CASE g % 4 WHEN 1 THEN substr(s, 1, 49) || translate(substr(s, 50, 1), 'ACGT', 'CATG') || substr(s, 51) WHEN 2 THEN substr(s, 1, 49) || substr(s, 51) WHEN 3 THEN substr(s, 1, 50) || translate(substr(s, 50, 1), 'ACGT', 'CATG') || substr(s, 51) ELSE s END END AS cons FROM s)
SELECT g::VARCHAR AS global_well, cons AS cons_seq, CASE WHEN cons IS NULL THEN 'Error' WHEN g % 4 < 2 THEN 'Perfect Match' ELSE 'Error' END AS cons_check, cons = s AS identity FROM c"""


def sample_recovery(spark, sf_dir):
    """Distinct variants among as many draws as the pool, the whole of part, has variants."""
    pool = _pool(spark, sf_dir)
    return simulate.recovered(simulate.take_sample(pool, pool.count(), 11), pool)


SAMPLE_RECOVERY = f"WITH {_CUTS_SQL}, u AS (SELECT {_UNIFORM.format(chr(39) + '11:' + chr(39) + ' || k')} AS u FROM (SELECT unnest(range(1, count(*) + 1)) AS k FROM part)) SELECT count(DISTINCT variant) AS n, count(DISTINCT variant) / (SELECT count(*) FROM pool)::DOUBLE AS share FROM u JOIN cuts ON u >= lo AND u < hi"


def uniform_recovery(spark, sf_dir):
    """Orders as ten replicates of uniform draws from 500 variants: mean and deviation at each twentieth of a replicate's draws."""
    orders = _table(spark, sf_dir, "orders")
    draws = orders.select((F.col("o_orderkey") % 10).alias("rep"), (F.floor(F.col("o_orderkey") / 10) + 1).alias("k"), (F.col("o_custkey") % 500).alias("variant"))
    most = draws.agg(F.max("k")).first()[0] or 0
    # The last step reaches the last draw.
    most = -(-most // max(100, most // 20)) * max(100, most // 20)
    return simulate.uniform_recovery(draws, 500, most).select("x", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


UNIFORM_RECOVERY = """WITH d AS (SELECT o_orderkey % 10 AS rep, o_orderkey // 10 + 1 AS k, o_custkey % 500 AS v FROM orders), m AS (SELECT max(k) AS most, greatest(100, max(k) // 20) AS step FROM d),
z AS (SELECT greatest(100, (most + step - 1) // step * step // 20) AS step, (most + step - 1) // step * step AS most FROM m), x AS (SELECT unnest(range(step, most + 1, step)) AS x FROM z),
n AS (SELECT x, rep, count(DISTINCT v) FILTER (k <= x) AS n FROM d, x GROUP BY ALL) SELECT x, round(avg(n / 500.0::DOUBLE), 9) AS mean, round(stddev_pop(n / 500.0::DOUBLE), 9) AS std FROM n GROUP BY x"""


def recovery_marks(spark, sf_dir):
    """Ticks at whole multiples of a library of 200 and the marker of 333.5 draws on the recovery curve of the orders."""
    return simulate.coverage_ticks(recovery_curve(spark, sf_dir), 200, 333.5)


RECOVERY_MARKS = f"""WITH c AS ({RECOVERY_CURVE}), m AS (SELECT 'marker' AS kind, min(x) AS x, arg_min(y, x) AS y FROM c WHERE x >= 333.5)
SELECT 'tick' AS kind, k * 200 AS x, NULL::DOUBLE AS y FROM (SELECT unnest(range(1, max(x) // 200 + 1)) AS k FROM c) UNION ALL SELECT * FROM m WHERE x IS NOT NULL"""


def expected_curve(spark, sf_dir):
    """The exact expected share of the pool, the whole of part, after each customer segment's number of draws."""
    totals = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("x")).select("x").distinct()
    return simulate.expected_curve(_pool(spark, sf_dir), totals).withColumn("y", F.round("y", 8))


EXPECTED_CURVE = """WITH p AS (SELECT round(p_retailprice) / (SELECT sum(round(p_retailprice)) FROM part) AS p FROM part), t AS (SELECT DISTINCT count(*) AS x FROM customer GROUP BY c_nationkey) SELECT x, round(avg(1 - pow(1 - p, x)), 8) AS y FROM p, t GROUP BY x"""


def model_counts(spark, sf_dir):
    """As many lognormal abundances as there are parts: their quantile ratio and bins of log10 of whole counts."""
    model = simulate.model_distribution(spark, _table(spark, sf_dir, "part").count(), 5, 2)
    logs = model.select(F.log10(F.floor(1000 * F.col("weight"))).alias("x")).where("x is not null")
    q = logs.agg(*(F.percentile("x", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.1, 0.9))).select(F.round(F.pow(10.0, F.col("q90") - F.col("q10")), 6).alias("fold"))
    return stats.histogram(logs, F.col("x"), 100).select("bin", "n").crossJoin(F.broadcast(q))  # one row


MODEL_COUNTS = f"""WITH s AS (SELECT ln(5) / (2 * {simulate.Z90}::DOUBLE) AS s), v AS (SELECT log10(floor(1000 * exp(-s * s / 2 + s * sqrt(-2 * ln(greatest({_UNIFORM.format("'2:' || k || ':a'")}, 1.1102230246251565e-16))) * cos(2 * pi() * {_UNIFORM.format("'2:' || k || ':b'")})))) AS x FROM (SELECT unnest(range(count(*))) AS k FROM part), s),
e AS (SELECT min(x) AS lo, max(x) AS hi, round(pow(10, quantile_cont(x, 0.9) - quantile_cont(x, 0.1)), 6) AS fold FROM v)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 100)), 99) ELSE 0 END AS INT) AS bin, count(*) AS n, any_value(fold) AS fold FROM v, e GROUP BY bin"""


def fold_savings(spark, sf_dir):
    """Commercial mean over own cost at the library size that most of the grid has."""
    points = _grid(spark, sf_dir)
    own = points.select("length", "n", costs.pooled_total().alias("cost"))
    return costs.fold_savings(costs.cost_stats(costs.commercial_costs(points, "goldengate")), own, 1105).withColumn("fold", F.round("fold", 6))


FOLD_SAVINGS = f"""WITH {_COMMERCIAL_SQL.replace("10.72::DOUBLE", "4.74::DOUBLE")}, own AS ({TOTAL_COST}), m AS (SELECT length, n, avg(cost) AS y FROM costs GROUP BY ALL)
SELECT length, round(y / cost, 6) AS fold FROM m JOIN own USING (length, n) WHERE n = 1105"""

_CATALOG = {
    "well_summary": (well_summary, WELL_SUMMARY),
    "plate_map": (plate_map, PLATE_MAP),
    "reference_map": (reference_map, REFERENCE_MAP),
    "read_assembly": (read_assembly, READ_ASSEMBLY),
    "name_overlap_stats": (name_overlap_stats, NAME_OVERLAP),
    "normalize_ids": (normalize_ids, NORMALIZE_IDS),
    "revcomp": (revcomp, REVCOMP),
    "codon_translate": (codon_translate, CODON_TRANSLATE),
    "mean_quality": (mean_quality, MEAN_QUALITY),
    "quality_quantiles": (quality_quantiles, QUALITY_QUANTILES),
    "length_hist": (length_hist, LENGTH_HIST),
    "length_frame": (length_frame, LENGTH_FRAME),
    "classify_consensus": (classify_consensus, CLASSIFY_CONSENSUS),
    "commercial_costs": (commercial_costs, COMMERCIAL_COSTS),
    "commercial_stats": (commercial_stats, COMMERCIAL_STATS),
    "total_cost": (total_cost, TOTAL_COST),
    "cost_crossover": (cost_crossover, COST_CROSSOVER),
    "cost_zoom": (cost_zoom, COST_ZOOM),
    "weighted_sample": (weighted_sample, WEIGHTED_SAMPLE),
    "recovery_curve": (recovery_curve, RECOVERY_CURVE),
    "resynthesis_curve": (resynthesis_curve, RESYNTHESIS_CURVE),
    "recovery_comparison": (recovery_comparison, RECOVERY_COMPARISON),
    "lognormal_fold": (lognormal_fold, LOGNORMAL_FOLD),
    "pileup_consensus": (pileup, PILEUP),
    "streamed_depths": (streamed_depths, STREAMED_DEPTHS),
    "fastq_scan": (fastq_scan, FASTQ_SCAN),
    "streamed_fastq": (streamed_fastq, STREAMED_FASTQ),
    "read_tree": (read_tree, READ_TREE),
    "tree_failures": (tree_failures, TREE_FAILURES),
    "reference_files": (reference_files, REFERENCE_FILES),
    "kit_files": (kit_files, KIT_FILES),
    "sam_fastq": (sam_fastq, SAM_FASTQ),
    "bam_reads": (bam_reads, BAM_READS),
    "formatted_reads": (formatted_reads, FORMATTED_READS),
    "well_export": (well_export, WELL_EXPORT),
    "labels": (labels, LABELS),
    "quality_hist": (quality_hist, QUALITY_HIST),
    "alignment_stats": (alignment_stats, ALIGNMENT_STATS),
    "barcode_calls": (barcode_calls, BARCODE_CALLS),
    "barcode_both_ends": (barcode_both_ends, BARCODE_BOTH_ENDS),
    "batch_demux": (batch_demux, BATCH_DEMUX),
    "read_alignment": (read_alignment, READ_ALIGNMENT),
    "gapped_alignment": (gapped_alignment, GAPPED_ALIGNMENT),
    "consensus_check": (consensus_check, CONSENSUS_CHECK),
    "quality_consensus": (quality_consensus, QUALITY_CONSENSUS),
    "sample_recovery": (sample_recovery, SAMPLE_RECOVERY),
    "uniform_recovery": (uniform_recovery, UNIFORM_RECOVERY),
    "recovery_marks": (recovery_marks, RECOVERY_MARKS),
    "expected_curve": (expected_curve, EXPECTED_CURVE),
    "model_counts": (model_counts, MODEL_COUNTS),
    "fold_savings": (fold_savings, FOLD_SAVINGS),
    "funnel": (funnel, None),
    "coverage_sweep": (coverage_sweep, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOG.items() if sql}
