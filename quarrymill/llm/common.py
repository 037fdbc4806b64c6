"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text that a Python task works on at once; longer single texts are worked on alone.
SLICE_BYTES = 1 << 20
#: Size of the Arrow batches that go to a Python worker, unless one row is larger.
BATCH_BYTES = 8 << 20
#: Most ids that a semi or anti join may broadcast (eight bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quarrymill-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only where none is set and Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or _own_dir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_BYTES, so that long texts don't add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on ``key``; ``ids`` has one column of that name.

    The ids are broadcast only when their count is known to be at most BROADCAST_IDS.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def slices(batch: pa.RecordBatch, *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``limit`` bytes of text, or one longer row."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(total), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def offsets(lengths: list[int]) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gapless_rank(df: DataFrame, group: list[Column], order: list[str], buckets: int) -> DataFrame:
    """Adds ``rank_in_group``: 0, 1, ... in each group, without a window over a whole group.

    Rows go by a hash of ``order`` into ``buckets`` parts of each group; ranks inside a part are
    shifted by the sizes of the parts before it. ``df`` is read twice, so it should be materialized.
    Ties are rows equal in all of ``order``.
    """
    from pyspark.sql import Window as W

    names = [f"__g{i}" for i in range(len(group))]
    dealt = df.withColumns(dict(zip(names, group, strict=True))).withColumn(
        "__part", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    )
    sizes = dealt.groupBy(*names, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*names).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(n).alias(f"{n}_s") for n in names],
        F.col("__part").alias("__part_s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy(*names, "__part").orderBy(*order)) - 1)
    same = F.col("__part") == F.col("__part_s")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_s"))
    return (
        ranked.join(starts, same)
        .withColumn("rank_in_group", F.col("__start") + F.col("__r"))
        .drop(*names, *[f"{n}_s" for n in names], "__part", "__part_s", "__start", "__r")
    )
