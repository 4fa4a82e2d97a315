"""The fitted models against direct computation: isotonic pools, ridge equations, noisy-or scores."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plateforge.llm import kernel, quality_classifier, toxicity


def test_isotonic_is_the_minimum_over_all_pools():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = rng.integers(1, 9)
        n = rng.integers(1, 6, size).astype(float)
        k = np.array([rng.integers(0, m + 1) for m in n.astype(int)], float)
        # The least-squares fit under order: the largest over starts of the smallest over ends of the pools' means.
        level = [max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, size)) for a in range(i + 1)) for i in range(size)]
        knots, values = quality_classifier.isotonic(np.arange(size, dtype=float), n, k)
        blocks = [(int(lo), int(hi)) for lo, hi in zip(knots[::2], knots[1::2], strict=True)]
        edges = [0, *(i for i in range(1, size) if not math.isclose(level[i], level[i - 1])), size]
        assert blocks == [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]
        smooth = np.maximum.accumulate([(k[a : b + 1].sum() + 0.5) / (n[a : b + 1].sum() + 1) for a, b in blocks])
        assert np.allclose(values, np.repeat(smooth, 2))


def test_summed_equations_equal_a_dense_solve(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["one", "two", "THREE", "4", "#", "a b!"]) for _ in range(r.randint(0, 60)))) for i in range(400)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)], "doc_id long, quality boolean").withColumn("quality", F.col("quality").cast("int"))
    stats = quality_classifier.text_statistics(docs)
    centre, spread, weights, _, _ = quality_classifier.train(stats, labels)
    rows = stats.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).orderBy("doc_id").collect()
    x = np.array([row.stats for row in rows], float)
    assert np.allclose(centre, x.mean(axis=0)) and np.allclose(spread, np.sqrt(np.maximum(x.var(axis=0), 1e-6)), atol=1e-6)
    use = np.array([not row.held for row in rows])
    z, y = quality_classifier._lift(x[use], centre, spread), np.array([row.doc_id % 3 == 0 for row in rows], float)[use]
    penalty = np.eye(z.shape[1]) * quality_classifier.RIDGE
    penalty[-1, -1] = 1e-6
    dense = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ weights, z @ dense, atol=1e-5)
    # The ridge objective does not fall in any of many directions.
    loss = lambda w: ((z @ w - y) ** 2).sum() + w @ penalty @ w
    rng = np.random.default_rng(1)
    assert all(loss(weights) <= loss(weights + 1e-3 * rng.normal(size=len(weights))) for _ in range(50))


def cost(z_of, texts, labels):
    """Mean negative log likelihood of the noisy-or, text by text."""
    total = 0.0
    for text, y in zip(texts, labels, strict=True):
        p = 1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in z_of(text))
        total -= math.log(max(p if y else 1 - p, 1e-12))
    return total / len(texts)


def test_noisy_or_scores_and_fit():
    r = random.Random(9)
    texts, labels = [], []
    for i in range(240):
        parts = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 5))]
        if i % 4 == 0:
            parts[r.randrange(len(parts))] += " grumblefy"
        texts.append(". ".join(parts) + ".")
        labels.append(int(i % 4 == 0))
    weights, bias = toxicity.fit(texts, np.array(labels))

    def logits(weights, bias):
        def of(text):
            found = []
            for sentence in re.split(r"(?<=[.!?\n])\s*", text):
                if sentence.strip():
                    features, *_ = toxicity.sentences(np.frombuffer(sentence.encode(), np.uint8), np.array([0, len(sentence.encode())]))
                    found.append(bias + float(weights[features].sum(dtype=np.float64)))
            return found

        return of

    before, after = cost(logits(np.zeros_like(weights), -5.0), texts, labels), cost(logits(weights, bias), texts, labels)
    assert after < 0.25 * before
    batch = pa.RecordBatch.from_arrays([pa.array(range(242), pa.int64()), pa.array([*texts, None, ""], pa.string())], names=["doc_id", "text"])
    got = next(iter(toxicity._score(weights, bias)(iter([batch])))).to_pydict()
    want = [1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in logits(weights, bias)(t)) for t in texts] + [0, 0]
    assert np.allclose(got["score"], want, atol=1e-6)
    # The slope that the fit follows is the objective's, by finite differences over the sentences' logits.
    rng = np.random.default_rng(2)
    z, bounds, y = rng.normal(size=9), np.array([0, 2, 5, 9]), np.array([1, 0, 1])

    def loss(z):
        left = toxicity._noisy_or(z, bounds)
        return -np.where(y > 0, np.log(-np.expm1(left)), left).sum()

    left = toxicity._noisy_or(z, bounds)
    slope = np.repeat(np.where(y > 0, -np.exp(left) / -np.expm1(left), 1.0), np.diff(bounds)) / (1 + np.exp(-z))
    near = [(loss(z + 1e-6 * np.eye(9)[i]) - loss(z - 1e-6 * np.eye(9)[i])) / 2e-6 for i in range(9)]
    assert np.allclose(slope, near, atol=1e-6) and kernel.BLOCK_BYTES
