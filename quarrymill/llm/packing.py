"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. The packing plan needs only how many pieces
there are of each length, a table of at most ``capacity`` rows, so it is made exactly and for all pieces at
once on the driver: sets that provably dominate all alternatives are fixed and taken out, as often as
they occur; what remains goes best-fit in decreasing order. Spark numbers the pieces of each length
and looks each one up in the plan.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import gapless_rank, map_arrow, materialize, slices, utf8

CAPACITY = 2048
END = b"\0\0\0\0"


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed bins as (lengths, times), and the counts that remain.

    For the longest piece j, a set with j is fixed if every other feasible set with j can be split so
    that each part fits in the place of one piece of it:
    - nothing fits beside j: {j};
    - x fills the rest exactly: {j, x};
    - no two pieces fit beside j: {j, x} with the longest x that fits;
    - no three fit: {j, x} if x is at least as long as any pair that fits, or {j, x, s} with the longest s
      that fits beside j and x, if no pair of pieces longer than s fits beside j.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(bin_: tuple[int, ...], times: int) -> None:
        fixed.append((bin_, times))
        for k in bin_:
            left[k] -= times
            if not left[k]:
                del left[k]
                sizes.pop(bisect.bisect_left(sizes, k))

    def times_of(bin_: tuple[int, ...]) -> int:
        return min(left[k] // bin_.count(k) for k in set(bin_))

    def smallest(after: int, n: int, without: tuple[int, ...]) -> list[int]:
        """The n smallest pieces longer than ``after``, leaving out one of each in ``without``."""
        out: list[int] = []
        for k in sizes[bisect.bisect_right(sizes, after) :]:
            out += [k] * min(n - len(out), left[k] - without.count(k))
            if len(out) >= n:
                break
        return out

    def longest(most: int, without: tuple[int, ...]) -> int | None:
        for i in range(bisect.bisect_right(sizes, most) - 1, -1, -1):
            if left[sizes[i]] > without.count(sizes[i]):
                return sizes[i]
        return None

    def best_pair(room: int, j: int) -> int:
        """The largest sum, up to room, of two pieces beside j."""
        there = [k for k in sizes[: bisect.bisect_right(sizes, room)] if left[k] > (k == j)]
        lo, hi, best = 0, len(there) - 1, 0
        while lo <= hi:
            a, b = there[lo], there[hi]
            if a + b > room:
                hi -= 1
            else:
                if lo < hi or left[a] - (a == j) > 1:
                    best = max(best, a + b)
                lo += 1
        return best

    # a fixed set stays dominant while its pieces last, as taking pieces away leaves fewer alternatives
    i = len(sizes) - 1
    while i >= 0:
        j = sizes[i]
        room = capacity - j
        x = longest(room, (j,))
        few = smallest(0, 3, (j,))
        bin_: tuple[int, ...] | None = None
        if x is None:
            bin_ = (j,)
        elif x == room or len(few) < 2 or few[0] + few[1] > room:
            bin_ = (j, x)
        elif len(few) < 3 or sum(few) > room:
            s = longest(room - x, (j, x))
            if x >= best_pair(room, j):
                bin_ = (j, x)
            elif s is not None and (len(over := smallest(s, 2, (j,))) < 2 or sum(over) > room):
                bin_ = (j, x, s)
        if bin_:
            take(bin_, times_of(bin_))
        i = bisect.bisect_right(sizes, j) - 1 if bin_ else i - 1
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, many equal pieces at a time: (lengths, times)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(bin_: tuple[int, ...], times: int) -> None:
        room = capacity - sum(bin_)
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((bin_, times))

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                if todo // each:
                    put((size,) * each, todo // each)
                if todo % each:
                    put((size,) * (todo % each), 1)
                break
            room = rooms[i]
            bin_, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            # best fit fills a bin with this size before it opens the next
            each = room // size
            full = min(times, todo // each)
            put(bin_ + (size,) * (each if full else todo), full or 1)
            todo -= full * each if full else todo
            if times > (full or 1):
                put(bin_, times - (full or 1))
    return [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, times) for all pieces."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """The plan as arrays to look up the k-th piece of a length: sorted by (length, first rank)."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for lengths, times in bins:
            at = 0
            for k in lengths:
                rows.append((k, used.get(k, 0), base, at))
                used[k] = used.get(k, 0) + times
                at += k
            base += times
        rows.sort()
        t = np.array(rows, np.int64).reshape(-1, 4)
        self.first, self.base, self.offset = (t[:, 0] << 44) + t[:, 1], t[:, 2], t[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        at = np.searchsorted(self.first, key, "right") - 1
        return self.base[at] + key - self.first[at], self.offset[at]


_encoders: dict[str, _Encoder] = {}
#: A run of letters that the tokenizer's normalizer leaves alone, and the marks after it. The tokenizer cuts between
#: the two, and takes a run of letters to its model whole.
_PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:;=?@\[-`{}~]*)")


class _Encoder(dict):
    """Token ids, as little-endian 32-bit numbers, of lower-cased runs of anything but ASCII white space.

    The tokenizer never joins across white space, so a text's ids are those of its runs. Its added tokens are cut out of the text
    as they are spelled before it is lower-cased, as the tokenizer does; what is left holds none, so that lower-casing must make none.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {x.content.encode(): array("I", [i]).tobytes() for i, x in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if self.added else None
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        m = _PLAIN.fullmatch(text)
        if m is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif m[2]:
            ids = self[m[1].encode()] + self[m[2].encode()]
        else:
            ids = array("I", [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes()
        self[run] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > 300_000:
            self.clear()
        return [self.plain(t) if self.cut is None or not self.cut.search(t) else self.mixed(t) for t in texts]

    def plain(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))

    def mixed(self, text: bytes) -> bytes:
        return b"".join(self.added.get(x) or self.plain(x) for x in self.cut.split(text))


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(utf8(part, "text"))):
                    ids += END
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, offset = places.value.find(
                batch.column("length").to_numpy(), batch.column("rank_in_group").to_numpy()
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its token ids and an end id 0; null and empty texts are the end id alone. Only
    documents longer than ``capacity`` are cut. Repeated rows and null ids are documents of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokenizer = tokenizer or default_tokenizer()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(map_arrow(docs.select("doc_id", "text"), _pieces(tokenizer, capacity), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    parts = max(8, sum(counts.values()) // 500_000)
    ranked = gapless_rank(pieces, [F.col("length")], names, parts)
    return map_arrow(ranked.select(*names, "rank_in_group"), _place(places, names), f"{schema}, sequence_id long, offset long")
