"""Secret scans with multipart credential linking (operator 7), in DataFrame expressions only.

Strong kinds (assign, access, hex) are reported wherever they match. Weak parts
(identifiers, mail addresses, unlabelled random strings, endpoints and hosts) are
reported only where their complements lie within SCOPE code points: the interval
join of a document's parts is a sorted sweep over its own array, which carries the
nearest part of each role from either side, so it lists no pairs and needs no
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import once, quoted

SCOPE = 400
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint", "mail", "host")
#: Ranks of the kinds that play each role.
ROLES = {"key": (0, 2), "access": (1,), "labelled": (3,), "mail": (6,), "weak": (4,), "place": (5, 7)}
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the length in the pattern finds what dropping short matches would leave.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)\b(?:user(?:name|_?id)?|login|client_?id|account|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""(?i)\b(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]{4,}"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HOST = rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])(?::[0-9]{{1,5}}+)?"
_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, WEAK, ENDPOINT, MAIL, HOST), strict=True))
#: What every match of a kind has in it: a search for these bytes spares most texts the pattern.
_HINTS = {"access": "AKIA", "endpoint": "://", "mail": "@"}
_BLOCK = 128
#: Code points of the pieces that a text is cut into before spans are replaced in it.
_PIECE = 4096


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _before(values: Column, add: Callable[[Column, Column], Column], none: Column) -> Column:
    """What all values before each add up to; in blocks, so that the work stays near linear in their number."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    more = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    whole = F.aggregate(blocks, F.array(none), lambda acc, b: more(acc, F.aggregate(b, none, add)))
    found = F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.get(whole, i)), more), F.lit(1), F.size(b))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit(_HINTS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in _HINTS else found


def _spans(text: str, found: str, pattern: str, kind: str, long_enough: Column | None = None) -> Column:
    """Positions of the matches `found`: between them lie the pieces that split() leaves."""
    m, rank = F.col(found), KINDS.index(kind)
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    widths = F.transform(m, F.length)
    steps = _before(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), widths, lambda g, w: g + w), lambda s, x: s + x, F.lit(0))
    starts = F.zip_with(steps, F.slice(gaps, F.lit(1), F.size(m)), lambda s, g: s + g)
    spans = F.zip_with(starts, widths, lambda s, w: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + w).alias("end")))
    if long_enough is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), long_enough.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    return F.when(F.size(m) > 0, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near(parts: Column, ranks: tuple[int, ...], scope: int) -> Column:
    """For each of the parts, sorted by start, whether another one of the ranks lies within scope of it."""
    far = 1 << 30
    has = lambda p: p["rank"].isin(*ranks)
    # Ends of earlier parts need not be ordered: the furthest one is the nearest.
    left = _before(F.transform(parts, lambda p: F.when(has(p), p["end"]).otherwise(-far)), _larger, F.lit(-far))
    right = F.reverse(_before(F.reverse(F.transform(parts, lambda p: F.when(has(p), p["start"]).otherwise(far))), lambda a, b: F.least(a, b), F.lit(far)))
    return F.zip_with(parts, F.arrays_zip(left.alias("l"), right.alias("r")), lambda p, n: (n["l"] >= p["start"] - scope) | (n["r"] <= p["end"] + scope))


_NO_SPANS = "array<struct<start:int,rank:int,end:int>>"


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every row of docs as struct `row`, with base and linked: arrays of (start, rank of KINDS, end) in code points.

    Within scope of each other, an identifier, a secret and a place to use them make
    a credential. Base spans are strong: a mail address or a labelled identifier is
    linked to a key (assign or hex), an endpoint or host to a key or an access key.
    A weak string is no secret by itself: it is linked if a labelled identifier or
    an access key is near, or both a mail address and a place; identifiers next to
    weak strings only, if a place is near, and places, if an identifier is. What a
    base span covers is not reported again. Null and empty texts have no spans; no
    rows in, no rows out. Repeated rows give repeated results, extra columns pass
    in `row`, texts of any length are scanned whole.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text.alias("t"))
    rows = rows.select("row", "t", *(_matches(F.col("t"), k).alias(f"m_{k}") for k in KINDS))
    rows = rows.withColumn("values", F.when(F.size("m_assign") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))))
    enough = F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.length(v) >= 6)
    rows = rows.select("row", *(_spans("t", f"m_{k}", p, k, enough if k == "assign" else None).alias(k) for k, p in _PATTERNS.items()))
    rows = rows.select("row", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.concat("ident", "weak", "endpoint", "mail", "host").alias("loose"))
    # A lone part has no complement, so only rows with two are swept.
    rows = rows.withColumn("parts", F.when((F.size("loose") > 0) & (F.size("loose") + F.size("base") > 1), F.array_sort(F.concat("base", "loose"))).otherwise(F.array().cast(_NO_SPANS)))
    rows = rows.select("row", "base", "parts", *(F.when(F.size("parts") > 0, _near(F.col("parts"), ranks, scope)).alias(f"near_{r}") for r, ranks in ROLES.items()))
    at = lambda role, i: F.get(F.col(f"near_{role}"), i)

    def linked(p: Column, i: Column) -> Column:
        key, access, labelled, mail, weak, place = (at(r, i) for r in ROLES)
        by_kind = F.when(p["rank"] == 4, labelled | access | (mail & place)).when(p["rank"].isin(3, 6), key | (weak & place)).when(p["rank"].isin(5, 7), key | access | (weak & (labelled | mail)))
        return F.coalesce(by_kind, F.lit(False))

    found = F.filter("parts", linked)
    fresh = F.filter(found, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("row", "base", once(F.when(F.size("parts") > 0, fresh).otherwise(F.array().cast(_NO_SPANS))).alias("linked"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "linked")).alias("spans")
    )


def _piecewise(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut into pieces; only the pieces that they lie in are read."""
    first = F.floor(start / _PIECE).cast("int")
    there = F.slice(pieces, first + 1, F.greatest(F.ceil(end / _PIECE).cast("int") - first, F.lit(0)))
    lo = lambda i: F.greatest(start - (first + i) * _PIECE, F.lit(0))
    return F.array_join(F.transform(there, lambda p, i: F.substring(p, lo(i) + 1, F.greatest(F.least(end - (first + i) * _PIECE, F.lit(_PIECE)) - lo(i), F.lit(0)))), "")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping secret spans replaced by mark; texts without any stay as they are, null ones null.

    n_chars, where there is such a column, is the new length. No rows in, no rows out.
    """
    found = find_secrets(docs).withColumn("s", F.array_sort(F.concat("base", "linked")))
    text = F.col("row.text")
    ends = F.transform("s", lambda s: s["end"])
    found = found.withColumn("upto", F.when(F.size("s") > 0, _before(ends, _larger, F.lit(0)))).withColumn("pieces", F.when(F.size("s") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    # A run begins where all spans before have ended; the text between them stays.
    gaps = F.filter(F.zip_with("s", "upto", lambda s, u: F.struct(u.alias("start"), s["start"].alias("end"))), lambda g: g["end"] >= g["start"])
    kept = F.transform(gaps, lambda g: F.concat(_piecewise(F.col("pieces"), g["start"], g["end"]), F.lit(mark)))
    rest = _piecewise(F.col("pieces"), F.array_max(ends), F.length(text))
    new = F.when(F.size("s") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)
    columns = [F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.withColumn("new", once(new)).select(*columns)
