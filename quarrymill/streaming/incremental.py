"""Resumable batches: what is new, and the merge with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarrymill.sources.scratch import cut


def pending(candidates: DataFrame, done: DataFrame, key: str = "codigo") -> DataFrame:
    """Candidates that were not processed."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the last row by ``order``; of rows that are equal there, the greatest by the other columns. A hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in order and c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*[key if c == key else F.col("_r")[c].alias(c) for c in rows.columns])


def upsert(before: DataFrame, now: DataFrame, key: str = "codigo", order: str = "posicao") -> DataFrame:
    """Rows of both; of a key the last row of the present run, else that of the runs before. ``order`` is a row's place in its run."""
    both = before.withColumn("_run", F.lit(0)).unionByName(now.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, ["_run", order]).drop("_run")


def upsert_table(path: str, now: DataFrame, run: int, key: str = "codigo", order: str = "posicao", buckets: int = 64) -> None:
    """Merges the rows of a run into the state table at ``path``, which is made if it is not there.

    The table is partitioned by a hash of the key; only partitions that the run touches are read and written again, so that the work
    follows the run and not the table. Each row keeps its run: of a key the row with the greatest (run, order) stays, so a run that
    is done again, after a failure or late, changes nothing that a later run wrote. The merged rows are written apart before any partition is replaced.
    """
    spark = now.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    mine = now.withColumn("_run", F.lit(run)).withColumn("_bucket", bucket)
    try:
        state = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        state = None
    if state is not None:
        touched = [r["_bucket"] for r in mine.select("_bucket").distinct().collect()]  # ``buckets`` numbers at most
        mine = state.where(F.col("_bucket").isin(touched)).unionByName(mine, allowMissingColumns=True)
    merged = cut(latest(mine, key, ["_run", order]), "merged")
    merged.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_table(spark, path: str) -> DataFrame:
    """The rows of a state table."""
    return spark.read.parquet(path).drop("_bucket", "_run")
