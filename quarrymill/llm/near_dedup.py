"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles is sketched into K min-hashes of 16 bits. The signature is cut into
chunks of CHUNK positions. Two signatures that differ in at most LIMIT positions have, by the
pigeonhole principle, a chunk with at most one differing position; so every chunk gives CHUNK keys,
each leaving out one position (the one allowed error), and every such pair shares a key. With
K = 48 and CHUNK = 4 the guarantee holds up to 23 differing positions; a pair at the lowest similarity
of 0.8 differs in 9.6 on average and in 24 or more with a chance under one in 10^5.

Pairs are not emitted within a bucket: members are linked to the bucket's least id, the links are
confirmed on the full sets, and only members that are then still in different components are compared
with each other: those that share one of their rare shingles early enough, as all pairs that are similar enough do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, materialize, offsets, slices, utf8, with_ids
from quarrymill.llm.components import connected_components

#: Words in a shingle and least similarity; op7_minhash_dedup takes four words.
SHINGLE, PERCENT = 5, 80
K, CHUNK = 48, 4
SLOT_BITS = 20
#: Each of the K / CHUNK chunks allows one error.
LIMIT = 2 * (K // CHUNK) - 1
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2)
_WORD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen lately in a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], size: int = SHINGLE, hashes: _Hashes | None = None) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of each text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle; one without words has none.
    """
    words = [t.lower().split() for t in texts]  # on bytes both touch ASCII only
    at = offsets([len(w) for w in words])
    hash_of = (_Hashes() if hashes is None else hashes).__getitem__
    h = np.fromiter((hash_of(w) for ws in words for w in ws), np.uint64, int(at[-1]))
    n = max(0, len(h) - size + 1)
    windows = np.zeros(n, np.uint64)
    for j in range(size):
        windows += _mix(h[j : j + n] + _WORD[j])
    windows = _mix(windows)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            short = _mix(h[a:b] + _WORD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """K min-hashes, 16 bits of each."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 14):
        np.minimum(least, (shingles[i : i + (1 << 14), None] * _MUL + _ADD).min(axis=0), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(utf8(part, "text"), size, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([min_hashes(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_id", "signature"],
                )

    return run


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature) of each row of ``docs``; set_id is equal for equal sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), _sketch(size), f"doc_id {kind}, n_shingles long, set_id binary, signature binary"
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            batch = whole.slice(i, 4096)
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, K).astype(np.int64)
            out = []
            for c in range(0, K, CHUNK):
                for gone in range(CHUNK):
                    key = np.full(len(sig), c + gone, np.int64)
                    for j in range(CHUNK):
                        if j != gone:
                            key = (key << 16) | sig[:, c + j]
                    out.append(key)
            ids = pa.concat_arrays([batch.column("doc_id")] * K)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), ids], ["key", "doc_id"])


def _near(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, K) for c in ("sig_a", "sig_b")
            )
            yield batch.filter(pa.array((a != b).sum(axis=1) <= limit)).select(["a", "b"])

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, "text_a", "text_b"):
                keep = []
                for x, t in zip(utf8(part, "text_a"), shingle_sets(utf8(part, "text_b"), size, hashes), strict=True):
                    if x != last[0]:
                        last = (x, shingle_sets([x], size, hashes)[0])
                    both = len(np.intersect1d(last[1], t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(last[1]) + len(t) - both))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the candidate ``pairs`` (a, b), those whose full shingle sets are similar enough."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = materialize(
        pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair_ids"
    )
    texts = with_ids(docs.select("doc_id", "text"), ids, "doc_id", "left_semi")
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return map_arrow(joined, _confirm(size, percent), f"a {kind}, b {kind}").distinct()


def similar_links(docs: DataFrame, sketches: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Confirmed links between set representatives that span the components of all similar pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    reps = materialize(
        sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("set_id", "signature")
        .agg(F.min("doc_id").alias("doc_id")),
        "reps",
    )
    keyed = map_arrow(reps.select("doc_id", "signature"), _keys, f"key long, doc_id {kind}")
    shared = (
        keyed.groupBy("key")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
        .where(F.col("a") < F.col("last"))
        .select("key", "a")
    )
    members = materialize(keyed.join(shared, "key").select("key", "a", "doc_id"), "members")
    sig = lambda n: reps.select(F.col("doc_id").alias(n), F.col("signature").alias(f"sig_{n}"))

    def near(pairs: DataFrame) -> DataFrame:
        signed = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sig_a", "sig_b")
        return map_arrow(signed, _near(LIMIT), f"a {kind}, b {kind}").distinct()

    stars = members.where(F.col("a") < F.col("doc_id")).select("a", F.col("doc_id").alias("b")).distinct()
    first = materialize(confirm(materialize(near(stars), "stars"), docs, size, percent), "links")
    # What is left are members of one bucket that the links so far have in different components.
    found = materialize(connected_components(first), "found")
    placed = members.join(found, members["doc_id"] == found["node"], "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("c")
    )
    mixed = placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("key")
    rest = materialize(placed.join(mixed, "key").select("doc_id", "c").distinct(), "mixed")
    heads = _rare_shingles(with_ids(docs.select("doc_id", "text"), rest.select("doc_id"), "doc_id", "left_semi"), size, percent)
    heads = materialize(heads.distinct().join(rest, "doc_id"), "heads")
    x, y = heads.alias("x"), heads.alias("y")
    # What two sets share lies from their first common shingle on.
    shared_most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = (100 + percent) * shared_most >= percent * (F.col("x.n") + F.col("y.n"))
    cross = (
        x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") < F.col("y.c")) & enough)
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    cross = materialize(near(materialize(cross, "cross")), "cross_near")
    second = materialize(confirm(cross, docs, size, percent), "cross_links")
    return first.union(second)


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(1 << SLOT_BITS, np.int64), _Hashes()
        for batch in batches:
            for part in slices(batch, "text"):
                for s in shingle_sets(utf8(part, "text"), size, hashes):
                    np.add.at(counts, s >> np.uint64(64 - SLOT_BITS), 1)
        there = np.flatnonzero(counts)
        for i in range(0, len(there), 1 << 16):
            k = there[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k])], ["slot", "n"])

    return run


def _heads(table, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = table.value, _Hashes()
        for batch in batches:
            for part in slices(batch, "text"):
                out, row, place, size_of = [], [], [], []
                for i, s in enumerate(shingle_sets(utf8(part, "text"), size, hashes)):
                    n = len(s) + (percent * len(s) // -100) + 1
                    order = np.lexsort((s, counts[s >> np.uint64(64 - SLOT_BITS)]))[:n]
                    out.append(s[order].view(np.int64))
                    row.append(np.full(len(order), i))
                    place.append(np.arange(len(order)))
                    size_of.append(np.full(len(order), len(s)))
                columns = [pa.array(np.concatenate(x)) for x in (row, out, place, size_of)]
                columns[0] = part.column("doc_id").take(columns[0])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shingle", "place", "n"])

    return run


def _rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, shingle, place, n): the n - ceil(percent * n / 100) + 1 first of each set's n shingles in one common order.

    Two sets that are similar enough share one of them, whatever the order is. Rare ones first leave few pairs to
    look at, even where many texts are copies of one text with changes of their own. The order comes from counts in
    2^SLOT_BITS slots, so its size is fixed.
    """
    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
    counted = map_arrow(texts.select("text"), _frequencies(size), "slot long, n long")
    got = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    run = _heads(spark.sparkContext.broadcast(counts), size, percent)
    return map_arrow(texts.select("doc_id", "text"), run, f"doc_id {kind}, shingle long, place long, n long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links. Null and empty texts have no shingles
    and are linked with nothing. Rows with a null doc_id are never linked; their component_id is null
    and kept is true. Rows that share a doc_id are one node, with the links of all their texts; each
    keeps its own row and n_shingles. An empty table gives an empty result; other columns are ignored.
    """
    sketches = materialize(sketch(docs, size), "sketches")
    links = similar_links(docs, sketches, size, percent)
    nodes = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = nodes.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    # an id with several texts joins their sets; each id of a set is otherwise placed by the set
    several = nodes.groupBy("doc_id").agg(F.min("set_id").alias("s1"), F.max("set_id").alias("s2")).where("s1 != s2")
    bridges = nodes.join(several.select("doc_id"), "doc_id").join(reps, "set_id")
    found = connected_components(links.union(bridges.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    labels = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component")
    )
    out = sketches.join(labels, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None))
        .when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.col("component"))
        .alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id.

    Of rows that share a kept doc_id one stays; rows with a null doc_id all stay. Null texts and texts without words are linked with nothing
    and stay. Other columns stay as they are; an empty table gives an empty result.
    """
    result = materialize(near_duplicates(docs, size, percent), "near_duplicates")
    gone = materialize(result.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    left = with_ids(docs, gone, "doc_id", "left_anti")
    twice = result.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return left
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
