"""Quality rules with robust multivariate outliers (operator 6), in DataFrame expressions only.

Fixed rules fail short and self-repeating texts. Beyond them, each (language,
source) group gets a minimum-covariance-determinant estimate of its transformed
statistic vectors: from several starts, concentration steps refit mean and
covariance on the three quarters of rows nearest by Mahalanobis distance, and the
fit of the smallest determinant is taken. A group's estimate is then its posterior
mean under its language's, that under the whole corpus's, each prior counting as
PRIOR rows: one rule for groups of one row and of a billion. A consistency factor
makes the median distance that of a chi-square variable; a row far from its
group's estimate is rejected. Medians and quantiles are taken on a grid, so their
state is bounded and merges exactly, whatever a group's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialise

DIMENSIONS = ("v0", "v1", "v2", "v3")
#: Starts: medians with MADs, moments of all rows, medians with the covariance of directions.
STARTS = ("a", "b", "c")
STEPS = 3
CORE = 0.75
#: Rows that the estimate of a language, or the corpus, weighs in that of a group.
PRIOR = 20
#: Standard deviation that every statistic has at least: most are zero in most texts.
FLOOR = 0.12
#: Share of normal rows that may be rejected: below one row by chance in the largest corpora.
TAIL = 3e-12
#: Median of a chi-square variable with four degrees of freedom.
CHI2_MEDIAN = 3.3567
#: Estimates (of some 30 numbers each) up to which their table is broadcast; a larger one is joined by key.
BROADCAST_KEYS = 20_000
_SPLIT = r"[\x20\x09-\x0D]+"
_PAIRS = [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def cut(tail: float = TAIL) -> float:
    """The chi-square quantile of four degrees of freedom that leaves `tail` above: (1 + x / 2) exp(-x / 2) = tail."""
    t = -math.log(tail)
    for _ in range(60):
        t = math.log1p(t) - math.log(tail)
    return 2 * t


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs's doc_id, lang, source with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.filter(F.split("t", _SPLIT, -1), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("lines"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    # Hashes of the 5-word windows; the sorted copy shows which values are there twice.
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("doc_id", "lang", "source", "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("h"))
    at = lambda i: F.get(F.col("h"), i)
    windows = F.when(F.size("h") >= 5, F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4))))
    rows = rows.withColumn("w", F.coalesce(windows, F.array().cast("array<bigint>")))
    rows = rows.withColumn("twice", F.size("w") > F.size(F.array_distinct("w")))
    marked = F.when(F.col("twice"), F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.drop("h").withColumn("m", marked).drop("w")
    same = lambda i, j: F.coalesce(F.get(F.col("m"), i)["x"] == F.get(F.col("m"), j)["x"], F.lit(False))
    rows = rows.withColumn("p", F.array_sort(F.transform(F.filter("m", lambda s, i: same(i - 1, i) | same(i, i + 1)), lambda s: s["i"])))
    # Repeated windows at sorted positions cover five words, less what the next one covers.
    cover = F.aggregate("p", F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("m", "p", "twice")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vector(rows: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    # One repeated line or phrase is common in sound texts, so these weigh less than symbols and are taken against all words.
    values = (F.log(F.greatest("word_chars", F.lit(1)) / words), F.log1p(20 * F.col("n_symbols") / words), F.log1p(F.col("n_dup_lines") / (1 + words / 50)), F.log1p(5 * F.col("n_repeat_words") / words))
    return rows.select("*", *(F.round(v, 3).alias(d) for d, v in zip(DIMENSIONS, values, strict=True)))


def _grid(distance: Column) -> Column:
    return F.round(F.log(distance + 1e-6) * 50).cast("int")


def _distance(mean: dict[str, Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor's columns."""
    y: list[Column] = []
    for i, d in enumerate(DIMENSIONS):
        rest = F.col(d) - mean[d]
        for j in range(i):
            rest = rest - chol[i, j] * y[j]
        y.append(rest / chol[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(cov: DataFrame, start: str = "") -> DataFrame:
    """Columns c_i_j (lower triangle, floored diagonal) to l_i_j, of a start's names."""
    c, f = f"{start}c_", f"{start}l_"
    for j in range(len(DIMENSIONS)):
        for i in range(j, len(DIMENSIONS)):
            rest = F.col(f"{c}{i}_{j}") + (F.lit(FLOOR * FLOOR) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"{f}{i}_{k}") * F.col(f"{f}{j}_{k}")
            cov = cov.withColumn(f"{f}{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR * FLOOR))) if i == j else rest / F.col(f"{f}{j}_{j}"))
    return cov


def _params(start: str = "") -> tuple[dict, dict]:
    return {d: F.col(f"{start}m_{d}") for d in DIMENSIONS}, {(i, j): F.col(f"{start}l_{i}_{j}") for i, j in _PAIRS}


def _joined(rows: DataFrame, estimates: DataFrame, on, how: str = "inner") -> DataFrame:
    """rows with the estimates (a written table) of their key: broadcast up to BROADCAST_KEYS, joined by key beyond, where hot keys are split."""
    return rows.join(F.broadcast(estimates) if estimates.count() <= BROADCAST_KEYS else estimates, on, how)


def _moments(start: str, near: Column | None = None) -> list[Column]:
    only = (lambda d: F.when(near, F.col(d))) if near is not None else F.col
    means = [F.avg(only(d)).alias(f"{start}m_{d}") for d in DIMENSIONS]
    return means + [F.covar_pop(only(DIMENSIONS[i]), only(DIMENSIONS[j])).alias(f"{start}c_{i}_{j}") for i, j in _PAIRS]


def mcd(vectors: DataFrame, steps: int = STEPS, core: float = CORE) -> DataFrame:
    """One row a key with n, the mean (m_v), the covariance (c_i_j) and its determinant, floored as in _cholesky, of the best start's core."""
    by_key = vectors.groupBy("key")
    middle = materialise(by_key.agg(F.count("*").alias("n"), *_moments("b"), *(F.percentile(d, F.lit(0.5)).alias(f"am_{d}") for d in DIMENSIONS)))
    away = lambda d: F.col(d) - F.col(f"am_{d}")
    spread = _joined(vectors, middle, "key").groupBy("key").agg(*(F.percentile(F.round(F.abs(away(d)), 3), F.lit(0.5)).alias(f"s_{d}") for d in DIMENSIONS))
    scaled = middle.join(spread, "key").withColumns({f"s_{d}": F.sqrt(F.pow(F.col(f"s_{d}") * 1.4826, 2) + FLOOR * FLOOR) for d in DIMENSIONS})
    scaled = materialise(scaled)
    z = [away(d) / F.col(f"s_{d}") for d in DIMENSIONS]
    length = F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-9))
    signs = _joined(vectors, scaled, "key").groupBy("key").agg(*(F.avg(z[i] * z[j] / length).alias(f"u_{i}_{j}") for i, j in _PAIRS))
    size = len(DIMENSIONS)
    at = lambda i: F.col(f"s_{DIMENSIONS[i]}")
    fit = scaled.join(signs, "key").withColumns({f"cm_{d}": F.col(f"am_{d}") for d in DIMENSIONS})
    fit = fit.withColumns({f"ac_{i}_{j}": F.pow(at(i), 2) - FLOOR * FLOOR if i == j else F.lit(0.0) for i, j in _PAIRS})
    fit = fit.withColumns({f"cc_{i}_{j}": size * F.col(f"u_{i}_{j}") * at(i) * at(j) for i, j in _PAIRS})
    named = ["key", "n", *(f"{s}m_{d}" for s in STARTS for d in DIMENSIONS), *(f"{s}c_{i}_{j}" for s in STARTS for i, j in _PAIRS), *(f"{s}l_{i}_{j}" for s in STARTS for i, j in _PAIRS)]

    def factored(table: DataFrame) -> DataFrame:
        for s in STARTS:
            table = _cholesky(table, s)
        return materialise(table.select(*named))

    fit = factored(fit)
    for _ in range(steps):
        far = _joined(vectors, fit, "key").select("key", "n", *DIMENSIONS, *(_grid(_distance(*_params(s))).alias(f"g_{s}") for s in STARTS))
        edge = materialise(far.groupBy("key").agg(*(F.percentile(f"g_{s}", F.lit(core)).alias(f"e_{s}") for s in STARTS)))
        inside = [m for s in STARTS for m in _moments(s, F.col(f"g_{s}") <= F.col(f"e_{s}"))]
        fit = factored(_joined(far, edge, "key").groupBy("key").agg(F.first("n").alias("n"), *inside))
    each = []
    for s in STARTS:
        root = math.prod((F.col(f"{s}l_{i}_{i}") for i in range(1, size)), start=F.col(f"{s}l_0_0"))
        each.append(F.struct((root * root).alias("det"), F.lit(s).alias("start"), *(F.col(f"{s}m_{d}").alias(f"m_{d}") for d in DIMENSIONS), *(F.col(f"{s}c_{i}_{j}").alias(f"c_{i}_{j}") for i, j in _PAIRS)))
    return materialise(fit.select("key", "n", F.array_min(F.array(*each)).alias("best")).select("key", "n", "best.*"))


def _posterior(own: DataFrame, above: DataFrame) -> DataFrame:
    """own (key, parent, n, mean, covariance) under above's estimate of the parent as PRIOR rows.

    The posterior of a normal under conjugate priors, but that the gap between the
    means widens the covariance by the square of own's share and not by the share:
    else a lone row, however far, would be the reason to find itself near.
    """
    up = above.select(F.col("key").alias("parent"), *(F.col(f"m_{d}").alias(f"pm_{d}") for d in DIMENSIONS), *(F.col(f"c_{i}_{j}").alias(f"pc_{i}_{j}") for i, j in _PAIRS))
    share = F.col("n") / (F.col("n") + PRIOR)
    gap = [F.col(f"m_{d}") - F.col(f"pm_{d}") for d in DIMENSIONS]
    mean = [(F.col(f"pm_{d}") + share * g).alias(f"m_{d}") for d, g in zip(DIMENSIONS, gap, strict=True)]
    cov = [(share * F.col(f"c_{i}_{j}") + (1 - share) * F.col(f"pc_{i}_{j}") + share * share * (1 - share) * gap[i] * gap[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    return own.join(up, "parent").select("key", "parent", "n", *mean, *cov)


def estimates(vectors: DataFrame) -> DataFrame:
    """(key, mean, factor, scale) of every group of vectors (group, language, statistics), shrunk to its language and that to the corpus."""
    levels = F.array(F.struct(F.col("group").alias("key"), F.col("language").alias("parent"), F.lit(0).alias("level")), F.struct(F.col("language").alias("key"), F.lit("").alias("parent"), F.lit(1).alias("level")), F.struct(F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(2).alias("level")))
    keyed = vectors.select(F.explode(levels).alias("k"), *DIMENSIONS).select("k.*", *DIMENSIONS)
    tree = keyed.groupBy("key").agg(F.first("parent").alias("parent"), F.first("level").alias("level"))
    fitted = materialise(mcd(keyed.drop("parent", "level")).join(tree, "key"))
    corpus = fitted.where("level = 2")
    languages = _posterior(fitted.where("level = 1"), corpus)
    groups = _posterior(fitted.where("level = 0"), languages)
    names = ["key", "parent", "n", *(f"m_{d}" for d in DIMENSIONS), *(f"c_{i}_{j}" for i, j in _PAIRS)]
    shrunk = materialise(_cholesky(corpus.select(*names).unionByName(languages.select(*names)).unionByName(groups.select(*names))))
    middle = _joined(keyed.select("key", *DIMENSIONS), shrunk, "key").groupBy("key").agg(F.percentile(_grid(_distance(*_params())), F.lit(0.5)).alias("g"))
    # The factor too is shrunk, so that the one row of a group does not set its own measure.
    found = materialise(shrunk.join(middle, "key").withColumn("own", F.greatest(F.col("g") / 50 - math.log(CHI2_MEDIAN), F.lit(0.0))))
    up = lambda t: t.select(F.col("key").alias("parent"), F.col("log_scale").alias("up"))
    share = F.col("n") / (F.col("n") + PRIOR)
    under = lambda t, above: t.join(up(above), "parent").withColumn("log_scale", share * F.col("own") + (1 - share) * F.col("up"))
    top = found.where("parent is null").withColumn("log_scale", F.col("own"))
    second = under(found.where("parent = ''"), top)
    third = under(found.where("parent <> ''"), second)
    return materialise(third.select("key", *(f"m_{d}" for d in DIMENSIONS), *(f"l_{i}_{j}" for i, j in _PAIRS), F.exp("log_scale").alias("scale")))


def _name(*columns: str) -> Column:
    """A key of the columns' values, null among them; keys of other columns are others."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base statistics, base_failed, distance and kept of every row of docs.

    Null and empty texts have no words and fail the base rules. A null language or
    source is a group of its own. Estimates come from rows that pass the base
    rules; distance is null in a group that has none, whose rows fail anyway.
    Repeated rows count as often as they stand; extra columns are not looked at.
    Texts of any length are taken whole. No rows in, no rows out.
    """
    rows = materialise(_vector(base_statistics(docs)).withColumn("group", _name("lang", "source")).withColumn("language", _name("lang")))
    found = estimates(rows.where("not base_failed").select("group", "language", *DIMENSIONS))
    far = F.when(F.col("key").isNotNull(), _distance(*_params()) / F.col("scale"))
    rows = _joined(rows, found, F.col("group") == F.col("key"), "left").withColumn("distance", far)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut())).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
