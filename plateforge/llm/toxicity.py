"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. A sentence's score is a logistic function of
hashed word and word-beginning features; the document's is their noisy-or,
1 - prod(1 - p). Only document labels train it; the sentence scores then say
which sentence offends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

FEATURE_BITS = 18
#: Bytes of a word's beginning that are a feature; inflected words share their stems.
PREFIXES = (4, 6, 8)
#: Labelled documents that the fit may use: those first in the order of a hash of doc_id.
TRAIN_DOCS = 8000
#: Documents that a feature must occur in to have a weight.
LEAST_DOCS = 3
EPOCHS = 60
BATCH_DOCS = 256
RATE = 0.3
#: Of the L1 step: few words offend, so most weights are zero, which is what few labels need.
SPARSITY = 3e-3

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Features of a block: (per word: feature rows), word bounds of sentences, sentence bounds of texts, byte spans."""
    low = kernel.LOWER[data]
    starts, ends, bounds = kernel.words(low, offsets)
    n = len(starts)
    if not n:
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts, ends
    # The characters that close sentences cling to words; features leave them, and punctuation like commas, out.
    letters = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    upto = np.concatenate([[0], np.cumsum(letters)])
    squeezed = low[letters]
    a, b = upto[starts], upto[ends]
    sums = kernel.prefix_sums(squeezed)
    shift = np.uint64(64 - FEATURE_BITS)
    columns = [kernel.span_hashes(sums, a, b) >> shift]
    for k in PREFIXES:
        columns.append(kernel.mix(kernel.span_hashes(sums, a, np.minimum(b, a + k)) + np.uint64(k)) >> shift)
    features = np.stack(columns, axis=1).astype(np.int32)
    closed = np.concatenate([[0], np.cumsum(_ENDS[data])])
    begins = np.zeros(n, bool)
    begins[1:] = closed[starts[1:]] != closed[starts[:-1]]
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    first = np.flatnonzero(begins)
    return features, np.append(first, n), np.searchsorted(first, bounds), starts, ends


def _logits(weights: np.ndarray, bias: float, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros(0)
    return np.add.reduceat(weights[features].sum(axis=1, dtype=np.float64), first[:-1]) + bias


def _noisy_or(z: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log(1 - P) of each text."""
    total = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, z))])
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the noisy-or likelihood, with an L1 proximal step."""
    size = 1 << FEATURE_BITS
    weights, bias = np.zeros(size, np.float32), -5.0
    parts, order = [], np.random.default_rng(2).permutation(len(texts))
    seen = np.zeros(size, np.int32)
    for lo in range(0, len(order), BATCH_DOCS):
        rows = order[lo : lo + BATCH_DOCS]
        for a, b, data, offsets in kernel.blocks(pa.array([texts[i] for i in rows], pa.large_string()), 1 << 62):
            features, first, bounds, _, _ = sentences(data, offsets)
            word_bounds = first[bounds]
            for i in range(b - a):
                seen[np.unique(features[word_bounds[i] : word_bounds[i + 1]])] += 1
            parts.append((features, first, bounds, labels[rows[a:b]]))
    known = (seen >= LEAST_DOCS).astype(np.float32)
    squares, bias_square = np.full(size, 1e-2, np.float32), 1.0
    for _ in range(EPOCHS):
        for features, first, bounds, y in parts:
            if len(first) < 2:
                continue
            z = _logits(weights, bias, features, first)
            left = _noisy_or(z, bounds)
            p = np.exp(-np.logaddexp(0, -z))
            odds = np.exp(left) / np.maximum(-np.expm1(left), 1e-9)
            slope = np.repeat(np.where(y > 0, -odds, 1.0), np.diff(bounds)) * p / len(y)
            per_word = np.repeat(slope, np.diff(first))
            gradient = np.zeros(size)
            for k in range(features.shape[1]):
                gradient += np.bincount(features[:, k], per_word, size)
            gradient = (gradient * known).astype(np.float32)
            squares += gradient * gradient * len(y)
            weights -= RATE * gradient * np.float32(len(y) ** 0.5) / np.sqrt(squares)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - np.float32(SPARSITY) * RATE / np.sqrt(squares), 0)
            g = float(slope.sum())
            bias_square += g * g
            bias -= RATE * g / bias_square**0.5
    return weights, bias


def _train(batches):
    texts, labels = [], []
    for batch in batches:
        texts += [x or "" for x in batch.column(0).to_pylist()]
        labels += batch.column(1).to_pylist()
    weights, bias = fit(texts, np.array(labels, np.int64)) if texts else (np.zeros(1 << FEATURE_BITS, np.float32), -5.0)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Fit on at most train_docs documents that labels marks, first in hash order. Null labels and texts count as none."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # at most train_docs rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    # At most train_docs rows meet in one task, in one order whatever the partitions.
    fitted = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text").select("text", "y").mapInArrow(kernel.lean(_train), "weights binary, bias double").first()
    if fitted is None:  # an empty table may have no partition
        return np.zeros(1 << FEATURE_BITS, np.float32), -5.0
    return np.frombuffer(fitted["weights"], np.float32), fitted["bias"]


def _score(weights: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score, worst = np.zeros(n), np.zeros(n)
            at = np.zeros((2, n), np.int64)
            for lo, hi, data, offsets in kernel.blocks(batch.column(1)):
                features, first, bounds, starts, ends = sentences(data, offsets)
                z = _logits(weights, bias, features, first)
                score[lo:hi] = -np.expm1(_noisy_or(z, bounds))
                for i in range(hi - lo):
                    if bounds[i] < bounds[i + 1]:
                        s = bounds[i] + int(np.argmax(z[bounds[i] : bounds[i + 1]]))
                        worst[lo + i] = np.exp(-np.logaddexp(0, -z[s]))
                        at[:, lo + i] = starts[first[s]] - offsets[i], ends[first[s + 1] - 1] - offsets[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(score, 0, 1)), pa.array(worst), pa.array(at[0]), pa.array(at[1])], names=["doc_id", "score", "worst_score", "worst_start", "worst_end"]
            )

    return run


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score, worst_score, worst_start, worst_end) per row; the last two are bytes of the likeliest sentence.

    Null, empty and wordless texts have no sentence: score 0. Extra columns are
    not looked at; repeated rows give repeated results.
    """
    schema = "doc_id long, score double, worst_score double, worst_start long, worst_end long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel.lean(_score(*model)), schema)


def fold(column: str = "doc_id", folds: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more, learning from all labels; rows with a null doc_id stay."""
    bad = score_toxicity(docs, train(docs, labels)).where("score >= 0.5 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad.withColumnRenamed("doc_id", "bad_id"), F.col("doc_id").cast("long") == F.col("bad_id"), "left_anti")
