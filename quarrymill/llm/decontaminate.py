"""Benchmark decontamination with suffix arrays of the training texts.

Every batch of documents is a shard. Its suffix array holds the word positions at which a benchmark
suffix can begin (the first words must occur in the benchmark in that order, which no match lacks),
sorted by their leading words. Every different window that a suffix of a benchmark item begins with is binary-searched in
it, and what it finds marks words. The marked runs and the items found go into a full suffix array (by doubling), in
which the neighbours of each run's suffixes give the longest verbatim matches. A document lies in one shard, so nothing is shuffled. No pairs of
occurrences and suffixes are listed, so time grows as n log n also with texts of ever the same words.

The benchmark goes to the shards in blocks of at most BLOCK_WORDS words, each broadcast by itself; a
second block means a second pass over the documents, with the marks found so far carried in a column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, materialize, offsets, slices, utf8

WINDOW = 10
BLOCK_WORDS = 1_000_000
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Block:
    """Benchmark items as one array of word numbers, and what their suffixes begin with."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        texts = [words_of(t) for _, t in items]
        self.items = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        for ws in texts:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.at = offsets([len(ws) for ws in texts])
        self.words = np.array([self.vocabulary[w] for ws in texts for w in ws], np.int64)
        self.item_of = np.repeat(np.arange(len(texts)), np.diff(self.at))
        room = self.at[1:][self.item_of] - np.arange(len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        size = np.diff(self.at)[self.item_of] if len(self.words) else np.zeros(0, np.int64)
        # suffixes that begin with a whole window: window words, or a shorter item from its start
        need = np.where(size >= window, window, size)
        starts = np.flatnonzero(room >= need)
        self.lead = 2 if len(need) and need.min() >= 2 else 1
        two = np.flatnonzero(room >= 2)
        n = len(self.vocabulary)
        self.pairs = np.unique(self.words[two] * n + self.words[two + 1]) if len(two) else np.zeros(0, np.int64)
        # every different window once, with its words and the set of items that hold it
        ends = self.at[1:][self.item_of[starts]] if len(starts) else starts
        keys = self.keys(self.words, starts, np.minimum(starts + need[starts], ends), window)
        self.low, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self.need = need[starts][first]
        # all suffixes that begin with a window: up to the key with every later word at its largest
        high = self.low.copy().view(">u4").reshape(len(self.low), window)
        high[np.arange(window) >= self.need[:, None]] = np.iinfo(np.uint32).max
        self.high = np.ascontiguousarray(high).view(self.low.dtype).reshape(-1)
        holders = np.unique(which.astype(np.int64) * max(1, len(texts)) + self.item_of[starts])
        sets: dict[bytes, int] = {}
        parts = np.split(holders % max(1, len(texts)), np.searchsorted(holders // max(1, len(texts)), np.arange(1, len(self.low))))
        self.set_of = np.array([sets.setdefault(x.tobytes(), len(sets)) for x in parts[: len(self.low)]], np.int64)
        self.sets = [np.frombuffer(x, np.int64) for x in sets]

    def keys(self, words: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """The leading ``width`` words of suffixes as byte strings that sort as the words do; 0 is the end."""
        out = np.zeros((len(at), width), ">u4")
        for j in range(width):
            inside = at + j < ends
            out[inside, j] = words[at[inside] + j] + 2  # a word outside the vocabulary (-1) is 1
        return np.ascontiguousarray(out).view(f"S{4 * width}").reshape(-1)


def _search(block: Block, words: np.ndarray, doc_at: np.ndarray):
    """Occurrences of windows in a shard: (position, window), at most one of each length at a position."""
    n = len(block.vocabulary)
    doc_end = np.repeat(doc_at[1:], np.diff(doc_at))
    if block.lead == 2:
        first = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
        first = first[first + 1 < doc_end[first]]
        pair = words[first] * n + words[first + 1]
        where = np.minimum(np.searchsorted(block.pairs, pair), max(0, len(block.pairs) - 1))
        first = first[block.pairs[where] == pair] if len(block.pairs) else first[:0]
    else:
        first = np.flatnonzero(words >= 0)
    if not len(first):
        return None
    keys = block.keys(words, first, doc_end[first], block.window)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = first[order], keys[order]
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    if not len(window):
        return None
    within = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    return suffixes[np.repeat(lo, count) + within], window


class _Doubling:
    """Ranks of all suffixes of a sequence by their first 1, 2, 4, ... words."""

    def __init__(self, sequence: np.ndarray, longest: int):
        n, step = len(sequence), 1
        self.ranks = [np.unique(sequence, return_inverse=True)[1].astype(np.int32)]
        while step < longest and self.ranks[-1].max() + 1 < n:
            r = self.ranks[-1].astype(np.int64)
            then = np.zeros(n, np.int64)
            then[: n - step] = r[step:] + 1
            self.ranks.append(np.unique(r * (n + 1) + then, return_inverse=True)[1].astype(np.int32))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` have in common."""
        n, out = len(self.ranks[0]), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            ok = np.flatnonzero((x < n) & (y < n))
            same = ok[self.ranks[k][x[ok]] == self.ranks[k][y[ok]]]
            out[same] += 1 << k
        return out


def _longest(block: Block, words: np.ndarray, runs: np.ndarray, run_doc: np.ndarray, begins: np.ndarray, items: np.ndarray):
    """For each document with runs its longest verbatim match: (document, words, position, item, place in the item).

    A match begins with a window of both (``begins``: the places in the texts). Of equally long ones the first counts, and of items the first.
    """
    size = runs[:, 1] - runs[:, 0] + 1
    own = np.diff(block.at)[items] + 1
    at, item_at = offsets(size.tolist()), offsets(own.tolist()) + size.sum()
    every = np.concatenate([size, own])
    start = np.concatenate([runs[:, 0], block.at[items]])
    place = np.repeat(start - offsets(every.tolist())[:-1], every) + np.arange(every.sum())
    last = np.cumsum(every) - 1
    sequence = np.empty(len(place), np.int64)
    inside = np.ones(len(place), bool)
    inside[last] = False
    of_run = np.arange(len(place)) < size.sum()
    sequence[inside & of_run] = words[place[inside & of_run]]
    sequence[inside & ~of_run] = block.words[place[inside & ~of_run]]
    sequence[last] = len(block.vocabulary) + np.arange(len(last))  # no two ends are equal
    array = _Doubling(sequence, int(min(size.max(), own.max())))
    order = np.argsort(array.ranks[-1], kind="stable")
    from_item = ~of_run[order]
    index = np.arange(len(order))
    before = np.maximum.accumulate(np.where(from_item, index, -1))
    after = np.minimum.accumulate(np.where(from_item, index, len(order))[::-1])[::-1]
    back = np.empty(len(order), np.int64)
    back[order] = index
    # places of windows in the sequence
    r = np.searchsorted(runs[:, 0], begins, "right") - 1
    p = at[r] + begins - runs[r, 0]
    best = np.zeros(len(p), np.int64)
    for near in (before[back[p]], after[back[p]]):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        best[ok] = np.maximum(best[ok], array.common(p[ok], order[near[ok]]))
    doc = run_doc[r]
    top = np.lexsort((begins, -best, doc))
    top = top[np.concatenate([[True], doc[top][1:] != doc[top][:-1]])]
    sorted_items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in top:
        level = min(int(best[k]).bit_length() - 1, len(array.ranks) - 1)
        ranks, n = array.ranks[level], int(best[k])
        if level not in sorted_items:
            q = np.flatnonzero(~of_run)
            q = q[np.argsort(ranks[q], kind="stable")]
            sorted_items[level] = (q, ranks[q])
        q, values = sorted_items[level]
        q = q[np.searchsorted(values, ranks[p[k]], "left") : np.searchsorted(values, ranks[p[k]], "right")]
        q = q[array.common(np.full(len(q), p[k]), q) >= n]
        q = int(q.min())
        i = int(np.searchsorted(item_at, q, "right")) - 1
        yield int(doc[k]), n, int(begins[k]), int(items[i]), q - int(item_at[i])


def _marks(broadcast, carried: bool):
    """Adds the marks of a block: runs of words as int64 pairs, items, longest match and its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = broadcast.value
        get = block.vocabulary.get
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [words_of(t) for t in utf8(part, "text")]
                at = offsets([len(ws) for ws in texts])
                ids = np.fromiter(
                    map(get, (w for ws in texts for w in ws), repeat(-1)), np.int64, int(at[-1])
                )
                spans: list[list[int]] = [[] for _ in texts]
                items: list[list[str]] = [[] for _ in texts]
                best: list[list] = [[0, None, None, None] for _ in texts]
                if carried:
                    spans = [list(x) for x in part.column("spans").to_pylist()]
                    items = [list(x) for x in part.column("items").to_pylist()]
                    best = [[x["n"], x["at"], x["item"], x["item_at"]] for x in part.column("longest").to_pylist()]
                match = _search(block, ids, at) if len(ids) > block.lead - 1 and len(block.low) else None
                if match:
                    found, window = match
                    cover = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(cover, found, 1)
                    np.add.at(cover, found + block.need[window], -1)
                    on = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
                    # a run ends where its document ends at the latest, but two documents can touch
                    begin = on.astype(bool)
                    begin[1:] &= on[:-1] == 0
                    first = at[:-1][(np.diff(at) > 0)]
                    begin[first] = on[first] > 0
                    starts = np.flatnonzero(begin)
                    stops = np.flatnonzero(np.concatenate([on[1:] == 0, [True]]) & (on > 0)) + 1
                    stops = np.minimum(stops[np.searchsorted(stops, starts, "right")], at[np.searchsorted(at, starts, "right")])
                    runs = np.stack([starts, stops], axis=1)
                    run_doc = np.searchsorted(at, starts, "right") - 1
                    for (a, b), d in zip(runs.tolist(), run_doc.tolist(), strict=True):
                        spans[d] += [a - int(at[d]), b - int(at[d])]
                    doc = np.searchsorted(at, found, "right") - 1
                    held: dict[int, list[int]] = {}
                    for d, x in np.unique(np.stack([doc, block.set_of[window]], axis=1), axis=0).tolist():
                        held.setdefault(d, []).append(x)
                    top: dict[int, tuple] = {}
                    long = block.need[window] == block.window
                    short = np.flatnonzero(~long)  # an item shorter than a window matches as a whole
                    for k in short[np.lexsort((found[short], -block.need[window[short]]))]:
                        item = int(block.sets[block.set_of[window[k]]].min())
                        top.setdefault(int(doc[k]), (int(block.need[window[k]]), int(found[k]), item, 0))
                    if long.any():
                        there = np.unique(np.concatenate([block.sets[x] for x in np.unique(block.set_of[window[long]])]))
                        for d, *x in _longest(block, ids, runs, run_doc, np.unique(found[long]), there):
                            top[d] = min(top.get(d, tuple(x)), tuple(x), key=lambda y: (-y[0], y[1]))
                    for d, some in held.items():
                        own = {block.items[i] for x in some for i in block.sets[x]} - {None}
                        items[d] = sorted({*items[d], *own})
                    for d, (n, place, item, item_place) in top.items():
                        if n > best[d][0]:
                            best[d] = [n, place - int(at[d]), block.items[item], item_place]
                kept = [part.column(c) for c in part.schema.names if c not in ("n_words", "spans", "items", "longest")]
                names = [c for c in part.schema.names if c not in ("n_words", "spans", "items", "longest")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept,
                        pa.array([len(ws) for ws in texts], pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(
                            [{"n": n, "at": a, "item": i, "item_at": j} for n, a, i, j in best],
                            pa.struct([("n", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())]),
                        ),
                    ],
                    [*names, "n_words", "spans", "items", "longest"],
                )

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = []
        for runs in batch.column("spans").to_pylist():
            pairs, total, reach = sorted(zip(runs[::2], runs[1::2], strict=True)), 0, 0
            for a, b in pairs:
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            hit.append(total)
        items = batch.column("items").to_pylist()
        longest = batch.column("longest").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([n > 0 for n in hit], pa.bool_()),
                pa.array([x["n"] for x in longest], pa.int64()),
                pa.array([x["at"] for x in longest], pa.int64()),
                pa.array([x["item"] for x in longest], pa.string()),
                pa.array([x["item_at"] for x in longest], pa.int64()),
            ],
            REPORT,
        )


REPORT = [
    "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at",
    "longest_item", "longest_item_at",
]


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """Reads the benchmark on the driver block by block; it holds one partition and one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    held: list[tuple[str | None, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        held.append((r["i"], text))
        size += len(words_of(text))
        if size >= block_words:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_words long", "spans array<long>",
         "items array<string>", "longest struct<n: long, at: long, item: string, item_at: long>"]
    )
    out = None
    for block in _blocks(benchmark, window, block_words):
        if out is not None:
            out = materialize(out, "marks")
        marks = _marks(spark.sparkContext.broadcast(block), out is not None)
        out = map_arrow(docs if out is None else out, marks, schema)
    if out is None:
        out = map_arrow(docs, _marks(spark.sparkContext.broadcast(Block([], window)), False), schema)
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, and
    the longest verbatim match that begins with a window of the item: longest_match (words; 0: none), longest_at (its
    first word), longest_item and longest_item_at (its first word there). Of equally long ones the first counts.

    A window is ``window`` consecutive words of a ``benchmark`` item (item_id, text), or the whole of a
    shorter item with a word. Null and empty texts have no words: as documents they are not
    contaminated, as items they have no window. Repeated items count once by item_id; a null item_id
    marks words but isn't listed. An empty benchmark leaves all clean. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = _scan(docs.select("doc_id", "text"), benchmark, window, block_words)
    return map_arrow(
        marked.select("doc_id", "n_words", "spans", "items", "longest"),
        _report,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "longest_match long, longest_at long, longest_item string, longest_item_at long",
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns.

    Columns named like the marks (n_words, spans, items, longest) are kept aside under other names.
    """
    taken = {c: f"__own_{c}" for c in ("n_words", "spans", "items", "longest") if c in docs.columns}
    marked = _scan(docs.withColumnsRenamed(taken), benchmark, window, block_words)
    clean = marked.where(F.size("spans") == 0).drop("n_words", "spans", "items", "longest")
    return clean.withColumnsRenamed({v: k for k, v in taken.items()}).select(*docs.columns)
