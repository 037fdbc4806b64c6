"""How document filters interact: what each removes in every order, from one count of failure masks.

Filters A to D look at one text. E, an exact repeat of an earlier document, needs other texts. So that only possible
repeats are shuffled, a counting Bloom filter goes first: every text adds one to PROBES counters of the block that its
hash names; the tasks' counters are added up by Spark, and a text with a counter of one is no repeat. The counters
above one come back as bits. Texts that they leave open are grouped by the whole text, which gives the least doc_id of
each. All flags then make a mask of five bits, and the counts of (part, mask) hold everything about all orders.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize

#: Counters of a block, counters of a row of the table, counters that one text adds to.
BLOCK, PER_ROW, PROBES = 4096, 8, 3
#: Blocks at most: their bits are broadcast, 512 bytes each. With more rows the blocks fill up, more unique texts are
#: shuffled, and the result stays the same.
MOST_BLOCKS = 1 << 16
WORD = r"[\x20\x09-\x0D]+"
#: Filters in the order of their bits.
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` (not null) fails."""
    words = F.filter(F.split(text, WORD), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [
        lambda n, d: n < 100,
        lambda n, d: 100 * d < 80 * n,
        lambda n, d: 100 * capitals > 10 * F.char_length(text),
        lambda n, d: F.rlike(text, F.lit("[#$%&*|]")),
    ]
    # transform over one entry, so that the words are split once
    mask = lambda w: sum((F.when(f(F.size(w), F.size(F.array_distinct(w))), 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return F.get(F.transform(F.array(words), mask), F.lit(0))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _slots(h: Column) -> list[Column]:
    """PROBES different counters of a block: steps of an odd width."""
    x = F.xxhash64(h)
    start, step = F.pmod(x, F.lit(BLOCK)), F.shiftrightunsigned(x, 20) % (BLOCK // 2) * 2 + 1
    return [((start + i * step) % BLOCK).cast("int") for i in range(PROBES)]


def repeated_counters(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits: 64 words of 64) of the counters above one; blocks without any are left out. ``hashes`` has one column h."""
    one = hashes.select(_block(F.col("h"), blocks).alias("block"), F.explode(F.array(*_slots(F.col("h")))).alias("slot"))
    sums = one.groupBy("block", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    word = F.shiftright("slot", 6)
    words = sums.groupBy("block", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63))).alias("bits"))
    maps = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # 64 words at most
    return maps.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def _possible(df: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``df`` whose counters are all above one."""
    all_set = F.lit(True)
    for s in _slots(F.col("h")):
        all_set = all_set & (F.getbit(F.get("bits", F.shiftright(s, 6)), s.bitwiseAND(63)) == 1)
    return df.withColumn("block", _block(F.col("h"), blocks)).join(F.broadcast(bits), "block").where(all_set).drop("block", "bits")


def repeats(docs: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """(doc_id, h) of documents whose whole text a smaller doc_id has, once each; ``hashes`` has doc_id and h = xxhash64(text) of all ``rows``.

    Rows without doc_id are no repeats and make none. Only texts that the counters leave open are shuffled.
    """
    blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, rows) * PER_ROW / BLOCK))))
    bits = materialize(repeated_counters(hashes.select("h"), blocks), "counters")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    firsts = _possible(texts, bits, blocks).groupBy("text", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")
    open_ = _possible(hashes.select("doc_id", "h").where("doc_id is not null"), bits, blocks)
    return open_.join(firsts, ["doc_id", "h"], "left_anti").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail.

    ``docs``: doc_id, text, lang; null texts and parts are empty. Repeated rows count each; rows without doc_id have no
    label. A document is good or toxic if any label of its doc_id says so. Other columns are ignored.
    """
    whole = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    flags = materialize(whole.select("doc_id", "part", text_mask(F.col("text")).alias("m"), F.xxhash64("text").alias("h")), "flags")
    again = repeats(docs, flags, flags.count()).withColumn("again", F.lit(1 << FILTERS.index("E")))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    every = flags.join(again, ["doc_id", "h"], "left").join(known, "doc_id", "left")
    return every.groupBy("part", (F.col("m") + F.coalesce("again", F.lit(0))).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("bad") == 1).alias("toxic")
    )


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) for all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, 1 << FILTERS.index(name), before))
            before |= 1 << FILTERS.index(name)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; no rows for an empty table."""
    counts = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    parts = mask_counts(docs, labels).groupBy("part").agg(counts.alias("counts"))  # 32 masks at most
    spark = docs.sparkSession
    steps = spark.createDataFrame([(o, s, b, e) for o, s, b, e in orders()], "filter_order string, step int, bit int, before int")
    steps = steps.agg(F.collect_list(F.struct("*")).alias("steps"))  # 600 entries
    each = parts.join(F.broadcast(steps), F.lit(True)).select("part", "counts", F.explode("steps").alias("s")).select("part", "counts", "s.*")

    def total(test, value="n") -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("counts", zero, lambda x, c: x + F.when(test(c["mask"]), c[value] if isinstance(value, str) else value(c)).otherwise(zero))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    return each.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        # of all orders, one in as many as a document fails filters has this one first
        total(fails, lambda c: c["n"] * F.floor(F.lit(math.factorial(len(FILTERS))) / F.bit_count(c["mask"]))).alias("shapley"),
    )
