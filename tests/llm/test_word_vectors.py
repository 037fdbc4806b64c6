"""Word vectors and pooling of the quality classifier against plain versions, word by word."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quarrymill.llm import quality_classifier as qc

TEXTS = ["the cat sat on the mat", "the dog", "one", "", None, "a\tb  c\nthe cat é ü the the", "x " * 5000 + "the end", "the dog"]


def bucket(word):
    return zlib.crc32(word) % qc.BUCKETS


def plain_vectors(texts):
    index = qc.index_vectors().astype(int)
    total = defaultdict(lambda: np.zeros(qc.DIMS, int))
    for t in texts:
        words = (t or "").encode().split()
        for i, w in enumerate(words):
            for j in range(max(0, i - qc.REACH), min(len(words), i + qc.REACH + 1)):
                if j != i:
                    total[bucket(w)] += index[bucket(words[j])]
    return {b: v / max(np.linalg.norm(v), 1e-12) for b, v in total.items()}


def plain_features(text, vectors):
    words = [bucket(w) for w in (text or "").encode().split()]
    if not words:
        return np.zeros(2 * qc.DIMS + 3)
    v = np.array([vectors.get(b, np.zeros(qc.DIMS)) for b in words])
    own = qc.index_vectors()[words].astype(float).mean(axis=0)
    return np.concatenate([v.mean(axis=0), v.std(axis=0), [np.linalg.norm(v.mean(axis=0)), np.linalg.norm(own), 1]])


def test_vectors_and_features_match_plain_ones(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    vectors, plain = qc.word_vectors(df), plain_vectors(TEXTS)
    want = np.zeros_like(vectors)
    for b, v in plain.items():
        want[b] = v
    assert np.abs(vectors - want).max() < 1e-6
    run = qc._features(spark.sparkContext.broadcast(vectors))
    rows = rows_of(qc.map_arrow(df.withColumn("y", F.lit(1.0)), run, "doc_id long, y double, x array<double>"))
    assert len(rows) == len(TEXTS)
    for r in rows:
        # spreads are roots of small differences of single-precision vectors
        assert np.array(r["x"]) == pytest.approx(plain_features(TEXTS[r["doc_id"]], plain), abs=1e-3)


def test_network_scores_are_those_of_its_layers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    net = qc.Network(x, y, np.arange(400) % 4 == 1)
    for row, got in zip(x[:20], net.probability(x[:20]), strict=True):
        z = [(a - m) / s for a, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(z[i] * net.w[0][i, j] for i in range(5)) + net.b[0][j]) for j in range(qc.HIDDEN)]
        logit = sum(h * net.w[1][j, 0] for j, h in enumerate(hidden)) + net.b[1][0]
        assert got == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)))
    assert ((net.probability(x) > 0.5) == y).mean() > 0.95
