"""Quality scores by random Fourier features (operator 5).

Statistics of each whole text are standardised and mapped by cosines of random
projections, which approximate a Gaussian kernel. Normal equations summed over
partitions give ridge weights; isotonic regression on labelled rows that the
ridge did not see turns its scores into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .runtime import materialise, tree_sum
from .toxicity import fold

FEATURES = 192
GAMMA = 0.02
RIDGE = 1.0
#: Steps of the grid on which scores are counted for the calibration.
GRID = 400
N_STATS = 20

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#*$%&<>|"]] = True
_CLASS[3, [ord(c) for c in ".,;:!?"]] = True
_CLASS[4, 128:] = True
_CLASS[5, [ord(c) for c in "|!"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N_STATS): sizes, character and word shares, repetition and line shapes; zeros for wordless texts."""
    low = kernel.LOWER[data]
    starts, ends, bounds = kernel.words(low, offsets)
    word = kernel.span_hashes(kernel.prefix_sums(low), starts, ends)
    upto = np.concatenate([np.zeros((6, 1), np.int64), np.cumsum(_CLASS[:, data], axis=1)], axis=1)
    shares = upto[:, offsets[1:]] - upto[:, offsets[:-1]]
    odd = _CLASS[2][data[ends - 1]] if len(ends) else np.zeros(0, bool)
    bang = (data[ends - 1] == 33) if len(ends) else odd
    upper = (upto[0][ends] - upto[0][starts]) > 1 if len(ends) else odd
    triples, first = kernel.shingle_hashes(word, bounds, 3)
    out = np.zeros((len(offsets) - 1, N_STATS))
    newline = np.flatnonzero(data == 10)
    for i in range(len(out)):
        lo, hi = bounds[i], bounds[i + 1]
        n = hi - lo
        if not n:
            continue
        size = max(1, offsets[i + 1] - offsets[i])
        w = word[lo:hi]
        _, counts = np.unique(w, return_counts=True)
        t = triples[first[i] : first[i + 1]]
        lengths = (ends - starts)[lo:hi]
        a, b = np.searchsorted(newline, [offsets[i], offsets[i + 1]])
        cuts = np.concatenate([[offsets[i]], newline[a:b] + 1, [offsets[i + 1]]])
        lines = np.diff(cuts)
        sums = np.add.reduceat(w, np.minimum(np.searchsorted(starts[lo:hi], cuts[:-1]), n - 1)) if len(lines) else w[:1]
        out[i] = (
            np.log(n), np.log(size), lengths.mean(), lengths.std(), *(shares[:, i] / size), odd[lo:hi].mean(), bang[lo:hi].mean(), upper[lo:hi].mean(),
            len(counts) / n, counts.max() / n, 1 - len(np.unique(t)) / max(1, len(t)), (w[1:] == w[:-1]).mean() if n > 1 else 0.0, np.log1p(len(lines)), 1 - len(np.unique(sums)) / len(sums), (lines < 20).mean(),
        )
    return out


def _statistics(batches):
    for batch in batches:
        parts = [statistics(data, offsets) for _, _, data, offsets in kernel.blocks(batch.column(1))]
        flat = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, N_STATS), np.float32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_STATS), pa.array(flat.ravel()))], names=["doc_id", "stats"])


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, "doc_id long, stats array<float>")


def _lift(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(5)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FEATURES))
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - centre) / spread, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FEATURES))
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _array(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(batches):
    total = np.zeros(1 + 2 * N_STATS)
    for batch in batches:
        x = _array(batch.column(0))
        total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _equations(centre, spread):
    def run(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = _lift(_array(batch.column(0)), centre, spread)
                a += z.T @ z
                b += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b]).tobytes()], pa.binary())], names=["sums"])

    return run


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over counts at sorted x: knots and non-decreasing values (add-half smoothed)."""
    blocks: list[list[float]] = []
    for v, n, k in zip(x, total, positive, strict=True):
        blocks.append([v, v, n, k])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, hi, n2, k2 = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + n2, blocks[-1][3] + k2]
    knots = np.array([v for b in blocks for v in (b[0], b[1])])
    return knots, np.maximum.accumulate(np.repeat([(b[3] + 0.5) / (b[2] + 1) for b in blocks], 2))


def _score(model):
    centre, spread, weights, knots, values = model

    def run(batches):
        for batch in batches:
            raw = _lift(_array(batch.column(1)), centre, spread) @ weights if batch.num_rows else np.zeros(0)
            score = np.interp(raw, knots, values) if len(knots) else np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1)), pa.array(raw)], names=["doc_id", "score", "raw"])

    return run


_SCORED = "doc_id long, score double, raw double"


def train(stats: DataFrame, labels: DataFrame, label: str = "quality"):
    """The model, from all rows of labels (doc_id, label); a fifth of them, by a hash, calibrates. No labels: score 0.5."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = materialise(stats.join(marks, "doc_id").select("stats", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")))
    sums = tree_sum(rows.select("stats").mapInArrow(_moments, "sums binary"), 1 + 2 * N_STATS)
    n = max(1.0, sums[0])
    centre = sums[1 : 1 + N_STATS] / n
    spread = np.sqrt(np.maximum(sums[1 + N_STATS :] / n - centre**2, 1e-6))
    size = FEATURES + 1
    eq = tree_sum(rows.where("not held").select("stats", "y").mapInArrow(_equations(centre, spread), "sums binary"), size * size + size)
    penalty = np.eye(size) * RIDGE
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(eq[: size * size].reshape(size, size) + penalty, eq[size * size :])
    empty = np.zeros(0)
    scored = rows.where("held").select(F.col("y").cast("long").alias("doc_id"), "stats").mapInArrow(_score((centre, spread, weights, empty, empty)), _SCORED)
    # At most 3 * GRID + 1 rows come back, whatever the number of labels.
    cell = F.round(F.greatest(F.least("raw", F.lit(2.0)), F.lit(-1.0)) * GRID).cast("int")
    counts = sorted(scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("k")).collect())
    if not counts:
        return centre, spread, weights, np.array([0.0]), np.array([0.5])
    return centre, spread, weights, *isotonic(*(np.array([c[i] for c in counts], float) / (GRID if i == 0 else 1) for i in range(3)))


def score(stats: DataFrame, model) -> DataFrame:
    return stats.mapInArrow(_score(model), _SCORED)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have all-zero statistics and are scored by them; repeated rows give repeated results."""
    stats = materialise(text_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    scored = score(stats, train(stats, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
