"""Positions and quantiles over range parts: no group meets in one task, whatever its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.sources.scratch import cut

#: Different values of a group that one aggregation buffer may hold; a group with more rows is counted by value, one with more values ranked over range parts.
HOT_VALUES = 1_000_000


def row_position(
    df: DataFrame, order: list[str], name: str = "posicao", after: Callable[[DataFrame], DataFrame] = lambda rows: rows, is_cut: bool = False
) -> DataFrame:
    """Adds 0, 1, ... in the given order without gaps; rows equal in all of ``order`` follow each other in any order.

    Rows are dealt to ranges and numbered inside; the sizes of the ranges before are added. Equal rows are dealt apart by
    their places in the cut table. Two tables are written while the plan is built; rows that are read off a cut table as they
    are (``is_cut``) aren't written again. ``after`` has what is made of the sorted rows, one of each, before they are written.
    """
    tied = (df if is_cut else cut(df, "rows")).withColumn("_tie", F.monotonically_increasing_id())
    by = [*order, "_tie"]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    parts = cut(after(ranged).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return parts.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_start", "_at")


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _by_rank(counts: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """Quantiles from (group, _v, _n): the parts that hold a wanted position are the only ones that are summed up row by row."""
    parts = cut(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    group = W.partitionBy(*by)  # a row for each part
    placed = sizes.select(
        *by, "_part", "_m", F.sum("_m").over(group).alias("n"),
        F.coalesce(F.sum("_m").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    last = F.col("n") - 1
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * last), F.ceil(q * last)) for q in qs])))
    inside = F.filter(wanted, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_m")))
    need = placed.withColumn("_want", inside).where(F.size("_want") > 0).withColumnsRenamed({c: f"{c}_r" for c in [*by, "_part"]})
    rows = parts.join(need, _same([*by, "_part"], [f"{c}_r" for c in [*by, "_part"]]))
    to = F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    hits = rows.withColumn("_to", to).select(
        *by, "n", "_v", F.explode(F.filter("_want", lambda x: (x >= F.col("_to") - F.col("_n")) & (x < F.col("_to")))).alias("_at")
    )
    found = hits.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_q"))  # two for each quantile

    def quantile(q: float) -> Column:
        at = q * last
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("_q", low), F.element_at("_q", high)
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)

    return found.select(*by, "n", F.array(*[quantile(q) for q in qs]).alias("q"))


def _of_counts(counts: DataFrame, by: list[str], qs: list[float], hot: int) -> DataFrame:
    """Quantiles from (group, _v, _n), which should be cut: groups of over ``hot`` different values are ranked over range parts."""
    large = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > hot).drop("_d")
    direct = lambda c: c.groupBy(*by).agg(F.sum("_n").alias("n"), F.percentile("_v", qs, F.col("_n")).alias("q"))
    if large.isEmpty():
        return direct(counts)
    if not by:
        return _by_rank(counts, by, qs)
    large = F.broadcast(cut(large, "large").withColumnsRenamed({c: f"{c}_r" for c in by}))  # one for each million of counts at most
    on = _same(by, [f"{c}_r" for c in by])
    return direct(counts.join(large, on, "left_anti")).unionByName(_by_rank(counts.join(large, on, "left_semi"), by, qs))


def exact_quantiles(df: DataFrame, by: list[str], value: Column | str, qs: list[float], hot: int = HOT_VALUES) -> DataFrame:
    """Per group: n, the rows with a value, and q, the linear-interpolated quantiles ``qs``; groups without a value are left out.

    Groups of at most ``hot`` rows are read off the rows, so that their values are shuffled once. Rows of larger groups are
    counted by (group, value) first, so that a price that fills a group is one row; those of more than ``hot`` different values
    are ranked over range parts. All are exact. Larger groups are looked for, and counts of theirs written, while the plan is
    built; ``df`` is read twice, with larger groups three times, so it should be cut or have no shuffle.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v")).where("_v is not null")
    count = lambda r: cut(r.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    large = cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > hot).drop("_m"), "large") if by else rows.limit(hot + 1)
    direct = lambda r: r.groupBy(*by).agg(F.sum(F.lit(1)).alias("n"), F.percentile("_v", qs).alias("q"))
    if large.isEmpty() if by else large.count() <= hot:
        return direct(rows)
    if not by:
        return _of_counts(count(rows), by, qs, hot)
    large = F.broadcast(large.withColumnsRenamed({c: f"{c}_r" for c in by}))  # one for each million of rows at most
    on = _same(by, [f"{c}_r" for c in by])
    return direct(rows.join(large, on, "left_anti")).unionByName(_of_counts(count(rows.join(large, on, "left_semi")), by, qs, hot))


def modes(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Most frequent value of each column per group, the least one on a tie, null where there is none; every group has its row.

    Equal rows are counted first, so that a row is not shuffled once for each column. Values are counted by (group, column,
    value) and the best of each column is kept from the counts, so that no group holds a map of its values. Columns of one type
    share a pass.
    """
    values = {k: f"_c{i}" for i, k in enumerate(columns)}
    df = df.groupBy(*by, *[c.alias(values[k]) for k, c in columns.items()]).agg(F.count(F.lit(1)).alias("_m"))
    columns = {k: F.col(v) for k, v in values.items()}
    kinds = dict(df.select(*[c.alias(k) for k, c in columns.items()]).dtypes)
    out = None
    for kind in sorted(set(kinds.values())):
        names = [k for k in columns if kinds[k] == kind]
        long = df.select(*by, "_m", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), columns[k].alias("_v")) for i, k in enumerate(names)])))
        counts = long.groupBy(*by, "_i", "_v").agg(F.sum("_m").alias("_n"))
        best = lambda i: F.min(F.when((F.col("_i") == i) & F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v").alias("v"))))["v"]
        one = counts.groupBy(*by).agg(*[best(i).alias(k) for i, k in enumerate(names)])
        if out is None:
            out = one
        else:
            right = one.withColumnsRenamed({c: f"{c}_r" for c in by})
            out = out.join(right, _same(by, [f"{c}_r" for c in by])).drop(*[f"{c}_r" for c in by])
    return out.select(*by, *columns)


def distinct_counts(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Different values that are not null of each column per group, from one pass; every group has its row.

    (group, column, value) is made unique by partial aggregation, so no row is expanded as a whole.
    """
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), c.cast("string").alias("_v")) for i, c in enumerate(columns.values())])))
    once = long.distinct()
    return once.groupBy(*by).agg(*[F.count_if((F.col("_i") == i) & F.col("_v").isNotNull()).alias(k) for i, k in enumerate(columns)])
