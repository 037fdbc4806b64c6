"""Document quality from random-indexing word vectors and a small network.

Words are hashed into BUCKETS. Each bucket has a sparse random index vector; a word's vector is the
sum of the index vectors around all its occurrences in all texts, which Spark adds up by bucket, so
the table of vectors has a fixed size. A document is the mean and spread of its words' unit vectors and
the length of its mean index vector. A network of two layers is trained with numpy on at most
TRAIN_ROWS labelled rows, and its logits are divided by a temperature fitted on rows left out of training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, offsets, slices, utf8

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled rows that the network is fitted on at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
FOLDS, THRESHOLD, HIDDEN, EPOCHS = 5, 0.3, 32, 60


def index_vectors() -> np.ndarray:
    """NONZERO entries of +1 or -1 in each bucket's DIMS."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    at = rng.random((BUCKETS, DIMS)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return out


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = b = zlib.crc32(word) % BUCKETS
        return b


def _words(part: pa.RecordBatch, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.split() for t in utf8(part, "text")]
    at = offsets([len(ws) for ws in texts])
    return np.fromiter((b for ws in texts for b in map(buckets.__getitem__, ws)), np.int64, int(at[-1])), at


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, buckets = index_vectors(), _Buckets()
    total = np.zeros((BUCKETS, DIMS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            w, at = _words(part, buckets)
            if not len(w):
                continue
            # REACH empty places between texts, so that no text is another's context
            place = np.arange(len(w)) + REACH * (np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
            spread = np.zeros((len(w) + REACH * len(at), DIMS), np.int8)
            spread[place] = index[w]
            near = sum(np.roll(spread, k, axis=0) for k in range(-REACH, REACH + 1) if k)[place]  # 2 * REACH at most
            order = np.argsort(w, kind="stable")
            start = np.flatnonzero(np.diff(w[order], prepend=-1))
            total[w[order][start]] += np.add.reduceat(near[order].astype(np.int32), start, axis=0)
    there = np.flatnonzero(total.any(axis=1))
    if len(there):
        flat = pa.array(total[there].reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, DIMS, dtype=np.int32), flat)],
            ["bucket", "v"],
        )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors by bucket (BUCKETS x DIMS), from all texts; buckets without a context are zero."""
    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)]
    got = map_arrow(docs.select("text"), _contexts, "bucket int, v array<long>").groupBy("bucket").agg(*sums).toArrow()
    out = np.zeros((BUCKETS, DIMS), np.float64)
    if got.num_rows:
        out[got.column("bucket").to_numpy()] = np.stack([got.column(f"v{i}").to_numpy() for i in range(DIMS)], axis=1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(w: np.ndarray, at: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Features of each text: mean, spread, norm of the mean, norm of the mean index vector, has words."""
    out = np.zeros((len(at) - 1, 2 * DIMS + 3))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if a == b:
            continue
        total, squares, own = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS)
        for k in range(a, b, 4096):
            part = w[k : min(b, k + 4096)]
            v = vectors[part]
            total += v.sum(axis=0)
            squares += np.einsum("ij,ij->j", v, v)
            own += index[part].sum(axis=0, dtype=np.int32)
        mean = total / (b - a)
        out[i, :DIMS] = mean
        out[i, DIMS : 2 * DIMS] = np.sqrt(np.maximum(squares / (b - a) - mean**2, 0))
        out[i, 2 * DIMS :] = np.linalg.norm(mean), np.linalg.norm(own) / (b - a), 1
    return out


class Network:
    """Two layers, sigmoid output, Adam; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibration: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        sizes = (z.shape[1], HIDDEN, 1)
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.temperature = 1.0
        fit = np.flatnonzero(~calibration)
        m = [np.zeros_like(p) for p in self.w + self.b]
        s = [np.zeros_like(p) for p in self.w + self.b]
        step = 0
        for _ in range(EPOCHS):
            for i in range(0, len(fit), 256):
                pick = rng.choice(fit, min(256, len(fit)))
                h = np.maximum(z[pick] @ self.w[0] + self.b[0], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[1] + self.b[1], -30, 30)))
                d = (p - y[pick, None]) / len(pick)
                dh = (d @ self.w[1].T) * (h > 0)
                grads = [z[pick].T @ dh + 1e-4 * self.w[0], h.T @ d + 1e-4 * self.w[1], dh.sum(0), d.sum(0)]
                step += 1
                for p_, g, m_, s_ in zip(self.w + self.b, grads, m, s, strict=True):
                    m_ += 0.1 * (g - m_)
                    s_ += 0.001 * (g * g - s_)
                    p_ -= 0.003 * (m_ / (1 - 0.9**step)) / (np.sqrt(s_ / (1 - 0.999**step)) + 1e-8)
        left = np.flatnonzero(calibration)
        if len(left):
            logit, want = self._logit(x[left]), y[left]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            self.temperature = float(
                min(grid, key=lambda t: np.logaddexp(0, -np.where(want > 0, 1, -1) * logit / t).mean())
            )

    def _logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return (np.maximum(z @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -500, 500)))


class Constant:
    """Used where no row is labelled: every text gets the same score."""

    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def _features(vectors: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(*_words(part, buckets), vectors.value, index)
                flat = pa.array(x.reshape(-1))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "x"])

    return run


class Classifier:
    """Word vectors and network, fitted on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Rows whose crc32(doc_id as text) mod FOLDS is 0 are never learned from; of the others those with 1
    calibrate the temperature. Labels of one doc_id are averaged and rounded; null labels are left out.
    Where no row is labelled every score is 0.5.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
        sc = docs.sparkSession.sparkContext
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.vectors = sc.broadcast(word_vectors(docs))
        y = labels.groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q is not null")
        y = y.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"))
        known = docs.select("doc_id").distinct().join(y, "doc_id").where(fold() != 0)
        chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # a bounded table
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        got = map_arrow(rows, _features(self.vectors), f"doc_id {kind}, y double, x array<double>").toPandas()
        got = got.drop_duplicates("doc_id").sort_values("doc_id", kind="stable") if len(got) else got
        if not len(got):
            model = Constant(0.5)
        elif got["y"].nunique() == 1:
            model = Constant(float(0.01 + 0.98 * got["y"].iloc[0]))
        else:
            part = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in got["doc_id"]])
            model = Network(np.stack(got["x"].to_numpy()), got["y"].to_numpy(), part == 1)
        self.model = sc.broadcast(model)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) for each row of ``docs``; null texts are empty ones.

        A null doc_id is not held out. Repeated rows each get their row. Other columns are ignored.
        """
        kind = docs.schema["doc_id"].dataType.simpleString()
        scored = map_arrow(docs.select("doc_id", "text"), _score(self.vectors, self.model), f"doc_id {kind}, score double")
        return scored.select(
            "doc_id",
            F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )

    def keep_good(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` with a score of THRESHOLD or more, with all their columns, whatever their names.

        Null texts are scored as empty ones; repeated rows are scored each by itself; an empty table gives an empty result.
        """
        return map_arrow(docs, _filter(self.vectors, self.model), docs.schema)


def _score(vectors: Broadcast, model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.value.probability(pooled(*_words(part, buckets), vectors.value, index))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return run


def _filter(vectors: Broadcast, model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.value.probability(pooled(*_words(part, buckets), vectors.value, index))
                yield part.filter(pa.array(p >= THRESHOLD))

    return run
