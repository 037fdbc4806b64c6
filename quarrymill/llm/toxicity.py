"""Toxicity from character n-grams: a linear classifier whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters and digits becomes one space, and its n-grams of LEAST to MOST
characters, spaces of word borders among them, are hashed to 2^BITS numbers. Spark counts for each number in how
many toxic and how many other labelled texts it occurs; the ratio of the two smoothed shares, as a logarithm, is the
number's scale. Numbers whose ratio is clear (CLEAR standard errors) and large (LARGE) are features. A text's vector
holds the scales of its different features, at length one, and a logistic regression on at most TRAIN_ROWS labelled
rows weighs them. Counts and ratios come from all labelled rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import BROADCAST_IDS, map_arrow, materialize, offsets, slices, strings

LEAST, MOST, BITS = 3, 6, 20
CLEAR, LARGE = 3.0, 1.0
#: Labelled rows that the weights are fitted on at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
STEPS, RATE, DECAY = 200, 0.05, 2e-5
#: Characters that a slice of texts may have, unless one text alone has more; an n-gram takes some forty bytes on the way.
SLICE = 1 << 19
_WORDLIKE: list[np.ndarray] = []


def _wordlike() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    if not _WORDLIKE:
        _WORDLIKE.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _WORDLIKE[0]


def grams(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the different n-grams of each text, sorted; with ``keep`` only of numbers where it is true."""
    texts = [f" {t.lower()} " for t in texts]
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    c = np.where(_wordlike()[c], c, 32)
    first = np.ones(len(c), bool)
    first[1:] = (c[1:] != 32) | (c[:-1] != 32) | (of[1:] != of[:-1])
    c, of = c[first].astype(np.uint64), of[first]
    h, found = c, []
    for n in range(2, MOST + 1):
        if len(c) < n:
            break
        h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[:-1] >> np.uint64(29))) + c[n - 1 :]
        if n < LEAST:
            continue
        k = h * np.uint64(0xD6E8FEB86659FD93)
        k ^= k >> np.uint64(32)
        k = (k * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        there = of[: len(k)] == of[n - 1 :]
        if keep is not None:
            there &= keep[k]
        found.append((of[: len(k)][there] << BITS) | k[there])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, toxic texts, other texts) of one task; number -1 has the texts themselves."""
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for part in slices(batch, "text", limit=SLICE):
            y = part.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            of, k = grams(strings(part, "text"))
            for side in (0, 1):
                n[side, :-1] += np.bincount(k[y[of] == side], minlength=1 << BITS)
                n[side, -1] += (y == side).sum()
    there = np.flatnonzero(n.any(axis=0))
    number = np.where(there == 1 << BITS, -1, there).astype(np.int32)
    for a in range(0, len(there), 1 << 16):
        at = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(n[1, there[at]]), pa.array(n[0, there[at]])], ["number", "toxic", "other"])


def log_count_ratios(rows: DataFrame) -> DataFrame:
    """(number, ratio) of the features, from ``rows`` (y 0 or 1, text); none where a class is absent."""
    counts = map_arrow(rows.select("y", "text"), _count, "number int, toxic long, other long")
    sums = materialize(counts.groupBy("number").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q")), "counts")  # read twice
    totals = sums.where("number = -1").select(F.col("p").alias("ps"), F.col("q").alias("qs"))
    p, q = F.col("p") + 1, F.col("q") + 1
    ratio = F.log(p / (F.col("ps") + 2)) - F.log(q / (F.col("qs") + 2))
    clear = F.abs(F.col("ratio")) >= CLEAR * F.sqrt(1 / p + 1 / q)
    out = sums.where("number >= 0").join(F.broadcast(totals), (F.col("ps") > 0) & (F.col("qs") > 0))  # one row
    return out.withColumn("ratio", ratio).where(clear & (F.abs(F.col("ratio")) >= LARGE)).select("number", "ratio")


class Weights:
    """Scales, weights and bias; ``ratio`` and ``weight`` by number, zero where it is no feature."""

    def __init__(self, number: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float):
        self.number, self.scale, self.weight, self.bias = number, ratio.astype(np.float32), weight, bias
        self._dense: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def probability(self, texts: list[str]) -> np.ndarray:
        if self._dense is None:
            scale, weight = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float64)
            scale[self.number], weight[self.number] = self.scale, self.weight
            self._dense = scale != 0, scale, weight
        keep, scale, weight = self._dense
        of, k = grams(texts, keep)
        v = scale[k].astype(np.float64)
        length = np.sqrt(np.bincount(of, v * v, len(texts)))
        z = np.bincount(of, v * weight[k], len(texts)) / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each feature and bias: logistic regression with Adam on all rows at once; ``rows`` are the features' places in ``ratio``."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    k = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    v = ratio[k]
    v = v / np.maximum(np.sqrt(np.bincount(at, v * v, len(rows))), 1e-9)[at]
    w, b = np.zeros(len(ratio)), 0.0
    m, s = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, v * w[k], len(rows)) + b, -30, 30)))
        d = (p - y) / len(y)
        g = np.append(np.bincount(k, v * d[at], len(ratio)) + DECAY * w, d.sum())
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def _features(number: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[number.value] = True
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                of, k = grams(strings(part, "text"), keep)
                at = offsets(np.bincount(of, minlength=part.num_rows).tolist()).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(np.searchsorted(number.value, k).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "k"])

    return run


class Classifier:
    """Fitted on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from. Labels of one doc_id are averaged
    and rounded (a half is toxic); null labels and rows without doc_id are left out. Where no row is labelled, or all
    are alike, every score is the smoothed share of toxic rows, a half without rows. Labels are broadcast only when
    they are at most BROADCAST_IDS; beyond it they are joined by shuffling.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
        sc = docs.sparkSession.sparkContext
        kind = docs.schema["doc_id"].dataType.simpleString()
        y = labels.groupBy("doc_id").agg(F.avg("toxic").alias("t")).where("t is not null and doc_id is not null")
        y = y.select("doc_id", (F.col("t") >= 0.5).cast("int").alias("y")).where(fold() != HELD_OUT)
        if y.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            y = F.broadcast(y)
        rows = docs.select("doc_id", "text").join(y, "doc_id")
        got = log_count_ratios(rows).toArrow().sort_by("number")  # at most 2^BITS rows
        number, ratio = got.column("number").to_numpy(), got.column("ratio").to_numpy()
        ids = sc.broadcast(number)
        chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # a bounded table
        seen = map_arrow(rows.join(F.broadcast(chosen), "doc_id"), _features(ids), f"doc_id {kind}, y int, k array<int>").toArrow()
        want = seen.column("y").to_numpy().astype(np.float64)
        if not len(number) or len(set(want)) < 2:
            share = (want.sum() + 1) / (len(want) + 2)
            weights, bias = np.zeros(len(number)), float(np.log(share / (1 - share)))
        else:
            order = sorted(range(len(want)), key=lambda i: seen.column("doc_id")[i].as_py())
            rows_k = [np.asarray(seen.column("k")[i].values) for i in order]
            weights, bias = fit(rows_k, want[order], ratio)
        self.model = sc.broadcast(Weights(number, ratio, weights, bias))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) for each row of ``docs``; null texts are empty ones.

        A null doc_id is not held out. Repeated rows each get their row. Other columns are ignored; an empty table gives none.
        """
        kind = docs.schema["doc_id"].dataType.simpleString()
        scored = map_arrow(docs.select("doc_id", "text"), _score(self.model), f"doc_id {kind}, score double")
        return scored.select(
            "doc_id",
            F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )

    def drop_toxic(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` with a score under THRESHOLD, with all their columns; null texts are empty ones, repeated rows are treated alike."""
        return map_arrow(docs, _filter(self.model), docs.schema)


def _score(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.probability(strings(part, "text")))], ["doc_id", "score"])

    return run


def _filter(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit=SLICE):
                yield part.filter(pa.array(model.value.probability(strings(part, "text")) < THRESHOLD))

    return run
