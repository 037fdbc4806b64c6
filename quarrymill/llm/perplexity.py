"""Perplexity filter with a modified Kneser-Ney model of sub-word n-grams for each language.

Spark counts the ORDER-grams of characters, word ends included, of each language's reference texts: those that pass the
base rules and hold few symbols and capitals. Characters are packed in BITS bits each (those beyond CLASSES/2 are
hashed), so n-grams are their own 60-bit hashes, and the model grows with the corpus. N-grams fall into RANGES by the two characters
before the last one, so that all orders from three up of a position lie in one range: ranges are worked on
apart. A range's model is a set of sorted hash arrays, for each order the n-grams with log probabilities and the contexts with log
back-off weights, looked up by binary search.

Texts are scored with blocks of ranges of at most BLOCK_ENTRIES entries, each broadcast by itself; a
second block means a second pass over the texts, and its sums are added. Each language has a band of log perplexity
around its median; documents outside are rejected.

Characters don't show in which order words stand, so a second model of each language takes trigrams of word symbols: a word is one
of few symbols by its case, and by itself if it is short or by its ending if not; marks after it are symbols of their own. From both
orders of that model follows how many nats a symbol is likelier for the two before it. Texts that gain too little of what is usual in their language are rejected: they
are above an upper band of perplexity, set against that of their own words in any order.

An n-gram that only one text holds says nothing about that text: it counts in the totals, but its probability comes from the
lower order alone (copies of a text are one text).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm.common import map_arrow, materialize, offsets, slices

#: RANGES is prime, so that the remainder spreads the pairs of characters.
ORDER, BITS, RANGES = 5, 12, 61
CLASSES = 1 << BITS
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Reference texts have at most so many symbols, and capitals, in a hundred characters of words.
MAX_SYMBOL_PERCENT, MAX_CAPITAL_PERCENT = 2, 20
#: Half widths of the band in scaled median deviations, and the least half width in nats.
UPPER, LOWER, LEAST_WIDTH = 6.0, 6.0, 0.4
#: Word symbols: bits of each, words of at most so many characters by themselves, in how many symbols, and longer ones by their ending.
WORD_BITS, SHORT, SHORT_SYMBOLS, LONG_SYMBOLS = 6, 4, 20, 9
#: Trigrams of word symbols carry this bit among the n-grams, which marks a range of their own.
WORD_MARK = 1 << 60
#: A text gains at least this share of what the median text gains by the order of its words, where that is at least LEAST_GAIN nats.
ORDER_SHARE, LEAST_GAIN = 0.45, 0.2
#: Log perplexities are counted in bins of this width to find medians.
BIN = 1 / 1024
#: Entries of a model that are broadcast at once, twelve bytes each.
BLOCK_ENTRIES = 4_000_000
#: N-grams that a counting task holds before it merges them.
HELD = 4_000_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams that end at each character and at the end of each text; where each text's begin. The edge is 0."""
    pad = "\0" * (ORDER - 1)
    cp = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le"), "<u4").astype(np.int64)
    c = np.where(cp < CLASSES // 2, cp, CLASSES // 2 + cp % (CLASSES // 2))
    g = np.zeros(len(c) - ORDER + 1, np.int64)
    for j in range(ORDER):
        g = (g << BITS) | c[j : j + len(g)]
    # of each text's run, the first len + 1 end at its characters and at the edge after it
    size = np.array([len(t) + 1 for t in texts], np.int64)
    at = offsets(size.tolist())
    begin = offsets([len(t) + ORDER - 1 for t in texts])[:-1]
    return g[np.repeat(begin - at[:-1], size) + np.arange(size.sum())], at


_END, _PAUSE = ".!?…", ",;:"
_ENDS, _PAUSES = set(_END), set(_PAUSE)
_MARKS = _END + _PAUSE + "\"'()[]{}«»„“”‚‘’—–-*#"


class _Symbols(dict):
    """By word (UTF-8) its symbol, and above WORD_BITS that of the marks after it (0: none)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        text = word.decode()
        core = text.strip(_MARKS)
        tail = text[len(text.rstrip(_MARKS)) :] if len(core) < len(text) else ""
        low = core.lower()
        if not low:
            stem = SHORT_SYMBOLS + LONG_SYMBOLS
        elif len(low) <= SHORT:
            stem = zlib.crc32(low.encode()) % SHORT_SYMBOLS
        else:
            stem = SHORT_SYMBOLS + zlib.crc32(low[-2:].encode()) % LONG_SYMBOLS
        mark = 0 if not tail else 1 if not _ENDS.isdisjoint(tail) else 2 if not _PAUSES.isdisjoint(tail) else 3
        upper = core[:1].isupper() * (SHORT_SYMBOLS + LONG_SYMBOLS + 1)
        self[word] = code = 4 + stem + upper | mark << WORD_BITS
        return code


def word_grams(texts: list[str], symbols: _Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams that end at each word symbol and at the end of each text; where each text's begin. The edge is 0."""
    words = [t.encode().split() for t in texts]
    at = offsets([len(ws) for ws in words])
    code = np.fromiter((c for ws in words for c in map(symbols.__getitem__, ws)), np.int64, int(at[-1]))
    both = np.stack([code & ((1 << WORD_BITS) - 1), code >> WORD_BITS], axis=1).reshape(-1)
    there = both > 0
    size = np.diff(np.concatenate([[0], np.cumsum(there)])[2 * at])
    row = np.zeros(int(size.sum()) + 2 * (len(texts) + 1), np.int64)
    row[np.arange(size.sum()) + 2 * (np.repeat(np.arange(len(texts)), size) + 1)] = both[there]
    g = (row[:-2] << (2 * WORD_BITS)) | (row[1:-1] << WORD_BITS) | row[2:]
    begin, at = offsets((size + 2).tolist())[:-1], offsets((size + 1).tolist())
    return g[np.repeat(begin - at[:-1], size + 1) + np.arange(at[-1])], at


def suffix(keys: np.ndarray, order: int, bits: int = BITS) -> np.ndarray:
    return keys & ((1 << (order * bits)) - 1)


def range_of(keys: np.ndarray) -> np.ndarray:
    """The range of n-grams of order three and more."""
    return suffix(keys >> BITS, 2) % RANGES


def merged(keys: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of ``n`` and the least and largest text."""
    if not len(keys):
        return keys, n, lo, hi
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


_BLANK = " \t\n\v\f\r"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    doubles = len(lines) - len(set(lines))
    if len(words) < 4:
        return len(words), chars, symbols, doubles, 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        _, pair = np.unique(pair, return_inverse=True)
    three = pair[:-1] * len(number) + ids[2:]
    order = np.sort(three)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return len(words), chars, symbols, doubles, 0
    again = twice[np.minimum(np.searchsorted(twice, three), len(twice) - 1)] == three
    on = np.zeros(len(words), bool)
    for j in range(3):
        on[j : j + len(again)] |= again
    return len(words), chars, symbols, doubles, int(on.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΡΣ-ΫА-ЯЀ-Џ]+")


def is_reference(text: str) -> bool:
    """Whether the model learns from a text."""
    n_words, chars, symbols, _, repeated = base_figures(text)
    if base_failed(n_words, repeated) or 100 * symbols > MAX_SYMBOL_PERCENT * chars:
        return False
    return 100 * sum(map(len, _CAPITAL.findall(text))) <= MAX_CAPITAL_PERCENT * chars


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, lo, hi): counts of n-grams, and the least and largest of the texts that hold them."""
    held: dict[str | None, list[tuple[np.ndarray, ...]]] = {}
    size = 0

    def out(lang: str | None, columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            part = [pa.array(c[i : i + (1 << 16)]) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], ["lang", "gram", "n", "lo", "hi"])

    def merge() -> int:
        total = 0
        for lang, parts in held.items():
            held[lang] = [merged(*map(np.concatenate, zip(*parts, strict=True)))]
            total += len(held[lang][0][0])
        return total

    symbols = _Symbols()
    for batch in batches:
        for part in slices(batch, "text"):
            by: dict[str | None, tuple[list[str], list[int]]] = {}
            for text, lang, i in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), part.column("id").to_pylist(), strict=True):
                if text and is_reference(text):
                    texts, ids = by.setdefault(lang, ([], []))
                    texts.append(text)
                    ids.append(i)
            for lang, (texts, ids) in by.items():
                (g, at), (w, w_at) = grams(texts), word_grams(texts, symbols)
                g = np.concatenate([g, w | WORD_MARK])
                own = np.concatenate([np.repeat(np.array(ids, np.int32), np.diff(x)) for x in (at, w_at)])
                some = merged(g, np.ones(len(g), np.int64), own, own)
                held.setdefault(lang, []).append(some)
                size += len(some[0])
            if size > HELD:
                size = merge()
                if size > HELD // 2:
                    for lang, parts in held.items():
                        yield from out(lang, parts[0])
                    held.clear()
                    size = 0
    merge()
    for lang, parts in held.items():
        yield from out(lang, parts[0])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, part, gram, n, lo, hi) of all reference texts; trigrams of word symbols are part RANGES."""
    text_id = F.pmod(F.xxhash64("text"), F.lit(2**31 - 1)).cast("int").alias("id")
    found = map_arrow(docs.select("text", F.col("lang").cast("string").alias("lang"), text_id), _count, "lang string, gram long, n long, lo int, hi int")
    sums = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    two = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << (2 * BITS)) - 1))
    part = F.when(F.col("gram") >= WORD_MARK, RANGES).otherwise(two % RANGES).cast("int")
    return sums.select("lang", part.alias("part"), "gram", "n", "lo", "hi")


def discounts(n: list[float]) -> list[float]:
    """Of counts 1, 2, and 3 or more, from how many n-grams have the counts 1 to 4."""
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0.0) for i in (1, 2, 3)]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def below(level: Level, order: int, bits: int = BITS) -> Level:
    """The n-grams of one order less, which count the distinct characters before them."""
    keys, _, lo, hi = level
    return merged(suffix(keys, order - 1, bits), np.ones(len(keys), np.int64), lo, hi)


def counts_of_counts(level: Level) -> list[float]:
    return [float((level[1] == i).sum()) for i in range(1, 5)]


class Layer:
    """One order of a model: sorted n-grams with log probabilities, sorted contexts with log back-off weights."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, contexts: np.ndarray, back: np.ndarray):
        self.keys, self.logs, self.contexts, self.back = keys, logs, contexts, back

    @classmethod
    def build(cls, level: Level, cut: list[float], lower: np.ndarray, bits: int = BITS) -> Layer:
        """Interpolates a level with the probabilities of the order below of its n-grams' suffixes."""
        keys, n, lo, hi = level
        shared = lo != hi
        gain = np.where(shared, n - np.array([0.0, *cut])[np.minimum(n, 3).astype(int)], 0.0)
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] >> bits) != (keys[:-1] >> bits)])) if len(keys) else np.zeros(0, np.int64)
        total, used = (np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in (n.astype(float), gain))
        back = (total - used) / total
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
        known = used[of] > 0
        p = np.where(known, gain / total[of] + back[of] * lower, lower)
        return cls(keys, np.log(p).astype(np.float32), (keys >> bits)[at][used > 0], np.log(back[used > 0]).astype(np.float32))

    @staticmethod
    def joined(layers: list[Layer]) -> Layer:
        """Layers of different ranges as one."""
        keys, logs, contexts, back = (np.concatenate([getattr(x, c) for x in layers]) for c in ("keys", "logs", "contexts", "back"))
        a, b = np.argsort(keys), np.argsort(contexts)
        return Layer(keys[a], logs[a], contexts[b], back[b])


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def log_prob(layers: list[Layer], keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Log probability of each n-gram's last character or symbol after the ones before it; ``layers`` from order one up."""
    out, todo = np.zeros(len(keys)), np.arange(len(keys))
    for k in range(len(layers), 0, -1):
        layer, g = layers[k - 1], suffix(keys[todo], k, bits)
        at, hit = _found(layer.keys, g)
        out[todo[hit]] += layer.logs[at[hit]]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            return out
        at, hit = _found(layer.contexts, g >> bits)
        out[todo[hit]] += layer.back[at[hit]]
    out[todo] -= bits * np.log(2.0)
    return out


def order_gain(level: Level) -> np.ndarray:
    """By trigram of word symbols: how much likelier, in nats, the last is after the two before it than by itself."""
    levels = [level]
    for k in (3, 2):
        levels.append(below(levels[-1], k, WORD_BITS))
    layers: list[Layer] = []
    for k, x in enumerate(reversed(levels), 1):
        lower = np.exp(log_prob(layers, suffix(x[0], k - 1, WORD_BITS), WORD_BITS))
        layers.append(Layer.build(x, discounts(counts_of_counts(x)), lower, WORD_BITS))
    every = np.arange(1 << (3 * WORD_BITS))
    alone = log_prob(layers[:1], suffix(every, 1, WORD_BITS), WORD_BITS)
    return (log_prob(layers, every, WORD_BITS) - alone).astype(np.float32)


def _statistics(key: tuple, table: pa.Table) -> pa.Table:
    """Of a range: for orders from three up, how many n-grams have the counts 1 to 4; the n-grams of order two."""
    level = tuple(table.column(c).to_numpy() for c in ("gram", "n", "lo", "hi"))
    level = merged(*level)
    rows: list[tuple] = []
    for k in range(ORDER, 2, -1):
        rows += [(k, i, int(n), 0, 0) for i, n in enumerate(counts_of_counts(level), 1)]
        level = below(level, k)
    columns = [np.concatenate([np.array([r[j] for r in rows], np.int64), x]) for j, x in enumerate((np.full(len(level[0]), 2), *level))]
    lang = pa.array([key[0].as_py()] * len(columns[0]), pa.string())
    return pa.Table.from_arrays(
        [lang, *(pa.array(c.astype(np.int64)) for c in columns)], ["lang", "k", "gram", "n", "lo", "hi"]
    )


def _layers_of(broadcast):
    """The layers of a range, as bytes of sorted arrays; of the word symbols' range what their order gains, as ``logs``."""
    names = ["lang", "part", "k", "keys", "logs", "contexts", "back"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, cuts = broadcast.value[key[0].as_py()]
        level = merged(*(table.column(c).to_numpy() for c in ("gram", "n", "lo", "hi")))
        if key[1].as_py() == RANGES:
            gain = order_gain((level[0] ^ WORD_MARK, *level[1:])).tobytes()
            return pa.Table.from_pylist([dict(zip(names, (key[0].as_py(), RANGES, 3, b"", gain, b"", b""), strict=True))], _MODEL)
        levels = [level]
        for k in range(ORDER, 3, -1):
            levels.append(below(levels[-1], k))
        layers = list(low)
        for k, x in enumerate(reversed(levels), 3):
            layers.append(Layer.build(x, cuts[k], np.exp(log_prob(layers, suffix(x[0], k - 1)))))
        own = layers[2:]
        columns = [[getattr(x, c).tobytes() for x in own] for c in ("keys", "logs", "contexts", "back")]
        n = len(own)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(range(3, 3 + n), pa.int32())]
            + [pa.array(c, pa.binary()) for c in columns],
            names,
        )

    return run


class Block(dict[str | None, tuple[np.ndarray, list[Layer]]]):
    """A block of a model: by language which ranges it answers for, and the layers from order one up.

    ``gains`` has what the order of words gains, by trigram, of the languages that the block answers for in this.
    """

    def __init__(self) -> None:
        super().__init__()
        self.gains: dict[str | None, np.ndarray] = {}


_MODEL = pa.schema(
    [("lang", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary()), ("contexts", pa.binary()), ("back", pa.binary())]
)
_ARRAYS = (("keys", "<i8"), ("logs", "<f4"), ("contexts", "<i8"), ("back", "<f4"))


def _low(grams_: DataFrame) -> dict[str | None, tuple[list[Layer], dict[int, list[float]]]]:
    """Orders one and two of each language, and the discounts of the others.

    Order two has at most 2^24 n-grams a language.
    """
    found = grams_.where(F.col("part") < RANGES).groupBy("lang", "part").applyInArrow(_statistics, "lang string, k long, gram long, n long, lo long, hi long")
    sums = found.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = sums.toArrow()
    langs = got.column("lang").to_pylist()
    number = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    of = np.array([number[x] for x in langs], np.int64)
    k, *columns = (got.column(c).to_numpy() for c in ("k", "gram", "n", "lo", "hi"))
    low = {}
    for lang, i in number.items():
        two = merged(*(c[(of == i) & (k == 2)] for c in columns))
        cuts = {}
        for order in range(3, ORDER + 1):
            own = (of == i) & (k == order)
            cuts[order] = discounts([float(columns[1][own & (columns[0] == j)].sum()) for j in range(1, 5)])
        one = below(two, 2)
        first = Layer.build(one, discounts(counts_of_counts(one)), np.full(len(one[0]), 1.0 / CLASSES))
        second = Layer.build(two, discounts(counts_of_counts(two)), np.exp(log_prob([first], suffix(two[0], 1))))
        low[lang] = ([first, second], cuts)
    return low


def train(docs: DataFrame, block_entries: int = BLOCK_ENTRIES) -> Iterator[Block]:
    """The blocks of the model of all reference texts of ``docs`` (text, lang), one at a time.

    The first answers also for ranges without a model. Null and empty texts add nothing.
    """
    spark = docs.sparkSession
    grams_ = materialize(counted(docs), "grams")
    low = _low(grams_)
    schema = "lang string, part int, k int, keys binary, logs binary, contexts binary, back binary"
    ranges = grams_.groupBy("lang", "part").applyInArrow(_layers_of(spark.sparkContext.broadcast(low)), schema)
    ranges = materialize(ranges, "model")
    there: dict[str | None, np.ndarray] = {lang: np.zeros(RANGES, bool) for lang in low}
    for r in ranges.where(F.col("part") < RANGES).select("lang", "part").distinct().toLocalIterator():
        there[r["lang"]][r["part"]] = True
    held: dict[str | None, list] = {}
    size, first = 0, True

    def block() -> Block:
        out = Block()
        for lang in low if first else held:
            rows = []
            for r in held.get(lang, []):
                if r["part"] == RANGES:
                    out.gains[lang] = np.frombuffer(r["logs"], "<f4")
                else:
                    rows.append(r)
            parts = ~there[lang] if first else np.zeros(RANGES, bool)
            parts[[r["part"] for r in rows]] = True
            layers = list(low[lang][0])
            for k in range(3, ORDER + 1) if rows else ():
                own = [Layer(*(np.frombuffer(r[c], t) for c, t in _ARRAYS)) for r in rows if r["k"] == k]
                layers.append(Layer.joined(own))
            out[lang] = (parts, layers)
        return out

    for r in ranges.orderBy("lang", "part", "k").toLocalIterator():
        if r["k"] == 3 and size > block_entries:
            yield block()
            held, size, first = {}, 0, False
        held.setdefault(r["lang"], []).append(r)
        size += len(r["logs"]) // 4
    yield block()


def _score(broadcast, first: bool):
    """Sums of log probabilities of each text over the ranges of a block; of the first block also the base figures.

    ``order_gain`` is a mean over a text's word symbols, 0 where the block has none for its language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = broadcast.value
        none = (np.full(RANGES, first), [])
        symbols = _Symbols()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs = part.column("lang").to_pylist()
                loss, gain = np.zeros(len(texts)), np.zeros(len(texts))
                for lang in dict.fromkeys(langs):
                    own = [i for i, x in enumerate(langs) if x == lang]
                    g, at = grams([texts[i] for i in own])
                    parts, layers = block.get(lang, none)
                    # each different n-gram is looked up once, in order, which the binary searches pass through the arrays in
                    order = np.argsort(g)
                    first_of = np.diff(g[order], prepend=-1) != 0
                    each = g[order][first_of]
                    mine = parts[range_of(each)]
                    own_logs = np.zeros(len(each))
                    own_logs[mine] = log_prob(layers, each[mine])
                    logs = np.empty(len(g))
                    logs[order] = own_logs[np.cumsum(first_of) - 1]
                    total = np.concatenate([[0.0], np.cumsum(logs)])
                    loss[own] = total[at[:-1]] - total[at[1:]]
                    if lang in block.gains:
                        g, at = word_grams([texts[i] for i in own], symbols)
                        total = np.concatenate([[0.0], np.cumsum(block.gains[lang][g], dtype=np.float64)])
                        gain[own] = (total[at[1:]] - total[at[:-1]]) / np.diff(at)
                figures = np.array([base_figures(t) if first else (0,) * 5 for t in texts], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("id"), *(pa.array(figures[:, j]) for j in range(5))]
                    + [pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(loss), pa.array(gain)],
                    ["doc_id", "lang", "id", *FIGURES, "n_grams", "loss", "order_gain"],
                )

    return run


def scored(docs: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """doc_id, lang, the base figures, log_perplexity (nats a character) and order_gain (nats a word symbol) of each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in FIGURES)
    read = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("id"))
    passes = []
    for block in train(docs, block_entries):
        run = _score(spark.sparkContext.broadcast(block), not passes)
        rows = map_arrow(read, run, f"doc_id {kind}, lang string, id long, {figures}, n_grams long, loss double, order_gain double")
        passes.append(materialize(rows, "scored"))
    out = passes[0]
    if len(passes) > 1:
        key = ["doc_id", "lang", "id"]
        rows = [
            p.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *(F.max(c).alias(c) for c in (*FIGURES, "n_grams", "loss", "order_gain"))) for p in passes
        ]
        sums = rows[0]
        for more in rows[1:]:
            sums = sums.unionByName(more)
        totals = [F.sum(c).alias(c) for c in ("loss", "order_gain")]
        sums = sums.groupBy(*key).agg(F.max("rows").alias("rows"), *(F.max(c).alias(c) for c in (*FIGURES, "n_grams")), *totals)
        out = sums.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select("doc_id", "lang", *FIGURES, F.round(F.col("loss") / F.col("n_grams"), 9).alias("log_perplexity"), F.round("order_gain", 9).alias("order_gain"))


def _median(df: DataFrame, value: str, name: str) -> DataFrame:
    """Median of binned values by lang, from counts of bins."""
    bins = df.groupBy("lang", value).agg(F.count(F.lit(1)).alias("n"))
    up = W.partitionBy("lang").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = bins.select("lang", value, F.sum("n").over(up).alias("upto"), F.sum("n").over(W.partitionBy("lang")).alias("all"))
    return ranked.where("2 * upto >= all").groupBy("lang").agg(F.min(value).alias(name))


def bands(scores: DataFrame) -> DataFrame:
    """(of, low, high, least_gain): the band of log perplexity and the least order_gain of each language, from its documents that pass the base rules.

    least_gain is null where the median text gains less than LEAST_GAIN, or ``scores`` has no order_gain.
    """
    if "order_gain" not in scores.columns:
        scores = scores.withColumn("order_gain", F.lit(None).cast("double"))
    good = scores.where(~F.col("base_failed")).select("lang", *(F.round(F.col(c) / BIN).cast("long").alias(n) for c, n in (("log_perplexity", "bin"), ("order_gain", "gain"))))
    usual = _median(good, "gain", "usual").withColumnRenamed("lang", "of")
    middle = _median(good, "bin", "middle").withColumnRenamed("lang", "of")
    same = F.col("lang").eqNullSafe(F.col("of"))
    away = good.join(middle, same).select("lang", F.abs(F.col("bin") - F.col("middle")).alias("away"))
    width = F.col("spread") * 1.4826 * BIN
    return (
        _median(away, "away", "spread")
        .join(middle, same)
        .drop("of")
        .join(usual, same)
        .select(
            F.col("lang").alias("of"),
            F.when(F.col("usual") * BIN >= LEAST_GAIN, ORDER_SHARE * BIN * F.col("usual")).alias("least_gain"),
            (F.col("middle") * BIN - F.greatest(F.lit(LEAST_WIDTH), LOWER * width)).alias("low"),
            (F.col("middle") * BIN + F.greatest(F.lit(LEAST_WIDTH), UPPER * width)).alias("high"),
        )
    )


def quality_rules(docs: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the base figures, log_perplexity, order_gain, base_failed, kept.

    Null and empty texts have no words and fail. A null lang is a language of its own; a language without reference texts
has a uniform model and gains nothing. Repeated rows each get their row. An empty table gives an empty result; other columns are ignored.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scores = scored(docs, block_entries).withColumn("base_failed", failed)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    ordered = F.coalesce(F.col("order_gain") >= F.col("least_gain"), F.lit(True))
    rows = scores.join(F.broadcast(bands(scores)), F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = (~F.col("base_failed") & inside & ordered).alias("kept")
    return rows.select("doc_id", *FIGURES, "log_perplexity", "order_gain", "base_failed", kept)
