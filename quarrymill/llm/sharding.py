"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups go by falling size to the shard with the least bytes so far. The heap
on the driver sees how many groups there are of each different size: it deals groups of one size in runs, each a cycle of shards,
and the rank of a group among those of its size tells its place in the runs. So the result is that of a heap over all groups. There are
at most sqrt(2 x all bytes) different sizes; they come to the driver partition by partition and their runs are written in blocks.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import BROADCAST_IDS, gapless_rank, materialize, scratch_dir

#: A group with more than this part of all rows is joined by broadcast; there are fewer of them than LARGE_PARTS.
SHARDS, LARGE_PARTS = 8, 4096
#: Runs of this many sizes are held at once.
BLOCK = 100_000
#: Ranks in a group are counted in parts of about this many rows.
PART_ROWS = 500_000
#: Parts over which the groups of one size are spread where the runs are too many to broadcast.
SALTS = 32
_RUNS = "total long, runs array<struct<start:long,cycle:array<int>>>"


def deal(heap: list[tuple[int, int]], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Deals ``n`` groups of one size to the least loaded shards, as one by one through ``heap``, which is changed.

    Returns (start, cycle): from rank ``start`` on, shards are taken from ``cycle`` in turn, up to the next start.
    The least loaded shards that lie less than ``size`` apart take one group each in turn, until they reach the next shard.
    """
    runs: list[tuple[int, list[int]]] = []
    at = 0
    while at < n:
        loads = sorted(heap)
        k = 1
        while k < len(loads) and loads[k][0] - loads[0][0] < size:
            k += 1
        rounds = (n - at) // k
        if k < len(loads):  # all of a round are taken before the next shard as long as they have less than it
            rounds = min(rounds, max(0, (loads[k][0] - 1 - loads[k - 1][0]) // size + 1))
        if rounds >= 2:
            runs.append((at, [s for _, s in loads[:k]]))
            at += rounds * k
            heap[:] = [(load + rounds * size, s) for load, s in loads[:k]] + loads[k:]
            heapq.heapify(heap)
            continue
        steps = []
        for _ in range(min(n - at, len(heap))):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            steps.append(s)
        runs.append((at, steps))
        at += len(steps)
    return runs


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """(size, runs) of (size, number of groups) in falling order of size."""
    heap = [(0, s) for s in range(shards)]
    for size, n in sizes:
        yield size, deal(heap, size, n)


def _runs(spark: SparkSession, sizes: DataFrame, shards: int) -> DataFrame:
    """(total, runs) of ``sizes`` (total, n)."""
    path = f"{scratch_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    counted = ((r["total"], r["n"]) for r in sizes.orderBy(F.desc("total")).toLocalIterator())
    block: list = []

    def write() -> None:
        spark.createDataFrame(block, _RUNS).coalesce(1).write.mode("append").parquet(path)
        block.clear()

    for one in longest_first(counted, shards):
        block.append(one)
        if len(block) == BLOCK:
            write()
    write()
    return spark.read.schema(_RUNS).parquet(path)


def _with_runs(ranked: DataFrame, runs: DataFrame, few: bool) -> DataFrame:
    if few:
        return ranked.join(F.broadcast(runs), "total")
    salted = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return ranked.withColumn("salt", F.pmod("g", F.lit(SALTS)).cast("int")).join(salted, ["total", "salt"])


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and one more. Null texts count as empty and are one group with them.
    slot numbers the rows of a shard from 0. Repeated rows are rows of their own. An empty table
    gives an empty result; other columns are ignored. Jobs run while the plan is built.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
        ),
        "sizes",
    )
    key = ["g", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.col("size") * F.col("n"))
    groups = materialize(groups, "groups")
    sizes = materialize(groups.groupBy("total").agg(F.count(F.lit(1)).alias("n")), "totals")
    runs = _runs(spark, sizes, shards)
    n_rows, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranked = gapless_rank(groups, [F.col("total")], key, max(1, n_groups // PART_ROWS))
    few = sizes.count() * 8 <= BROADCAST_IDS
    # the last run that starts at the rank or before it
    run = F.element_at(F.filter("runs", lambda r: r["start"] <= F.col("rank_in_group")), -1)
    at = F.pmod(F.col("rank_in_group") - run["start"], F.size(run["cycle"])).cast("int")
    placed = _with_runs(ranked, runs, few).select(*key, "n", F.get(run["cycle"], at).alias("shard"))
    placed = materialize(placed, "placed")
    large = F.col("n") * LARGE_PARTS > n_rows
    hot = placed.where(large).select(*key, F.col("shard").alias("hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.where(F.col("hot").isNull()).drop("hot").join(placed.where(~large).select(*key, "shard"), key)
    dealt = materialize(marked.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "shard").unionByName(rest), "dealt")
    ranked = gapless_rank(dealt, [F.col("shard")], ["g", "doc_id", "size", "text_crc32"], max(16, n_rows // (shards * PART_ROWS)))
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("rank_in_group").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
