"""Repeated rows and keys, found by hashes, so that wide rows are neither sorted nor shuffled.

Rows are counted by one hash of 64 bits for each flag. Only rows whose hash occurs more than once are grouped by digests of
128 bits and by their values, which confirms them and tells apart different values of one digest. Up to a count these rows
are found by a broadcast join. Beyond it they are told from the others by a broadcast bitmap of bounded size, and only they
are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.sources.scratch import cut, is_small, small

#: Bits of the bitmap for each repeated hash, bits of one of its rows, and the most bits of all: 2^28 are 32 MB. A fuller bitmap only lets more rows through.
BITS_EACH, ROW_BITS, MOST_BITS = 32, 15, 28


def _tagged(columns: list[Column]) -> list[Column]:
    return [x for c in columns for x in (c.isNull(), c)]


def digest(columns: list[Column]) -> list[Column]:
    """Two hashes of 64 bits over the values and their places; a null is a value of its own, which the hash alone would skip."""
    return [F.xxhash64(F.lit(seed), *_tagged(columns)) for seed in (0, 1)]


def _hash(i: int, columns: list[Column], counts: Column) -> Column:
    """The hash by which a flag is counted, other than that of the same values in another flag; null for rows that don't count."""
    return F.when(counts, F.xxhash64(F.lit(2 + i), *_tagged(columns)))


def _hashes(flags: dict[str, list[Column]], only: dict[str, Column]) -> dict[str, Column]:
    return {name: _hash(i, columns, only.get(name, F.lit(True))) for i, (name, columns) in enumerate(flags.items())}


def _twice(df: DataFrame, hashes: dict[str, Column]) -> DataFrame:
    """Hashes that occur more than once."""
    each = F.explode(F.array_compact(F.array(*hashes.values()))).alias("_h")
    return cut(df.select(each).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"), "twice")


def _with_near(df: DataFrame, hashes: dict[str, Column], twice: DataFrame) -> DataFrame:
    """Adds _near_<flag>: false only where the row's hash is not in ``twice``. Hashes are bits of a bitmap in rows of 2^ROW_BITS."""
    bits = min(MOST_BITS, max(ROW_BITS, (BITS_EACH * twice.count()).bit_length()))
    row = lambda h: F.shiftright(h, ROW_BITS).bitwiseAND((1 << (bits - ROW_BITS)) - 1)
    bit = lambda h: h.bitwiseAND((1 << ROW_BITS) - 1)
    # each row of the bitmap is made in one task
    dealt = twice.select(row(F.col("_h")).alias("_row"), bit(F.col("_h")).alias("_bit")).repartition("_row")
    maps = F.broadcast(cut(dealt.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap"))  # 4 KB each, 2^(MOST_BITS - ROW_BITS) at most
    out = df
    for name, h in hashes.items():
        out = out.withColumn("_h", h).join(maps, row(F.col("_h")) == F.col("_row"), "left")
        at = bit(F.col("_h")).cast("int")
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        out = out.withColumn(f"_near_{name}", F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop("_h", "_row", "_bits")
    return out


def _confirmed(df: DataFrame, flags: dict[str, list[Column]], hashes: dict[str, Column], twice: DataFrame, near: bool) -> DataFrame:
    """(_f, _d0, _d1, _k, n, mixed), see ``groups``; with ``near`` only rows that _near_<flag> marks are looked at."""
    known, by = small(twice), ["_f", "_d0", "_d1"]
    out = None
    for i, (name, columns) in enumerate(flags.items()):
        a, b = digest(columns)
        again = (df.where(f"`_near_{name}`") if near else df).join(known, hashes[name] == F.col("_h"))
        one = again.select(F.lit(i).alias("_f"), a.alias("_d0"), b.alias("_d1"), F.array(*[c.cast("string") for c in columns]).alias("_k"))
        out = one if out is None else out.union(one)
    counted = out.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("n"))
    # a row for each value of a digest, which is one but for collisions
    return cut(counted.withColumn("mixed", F.count(F.lit(1)).over(W.partitionBy(*by)) > 1).where("n > 1"), "groups")


def groups(df: DataFrame, flags: dict[str, list[Column]], only: dict[str, Column] | None = None) -> DataFrame:
    """(_f, _d0, _d1, _k, n, mixed): for each flag, by its place, the values _k that n > 1 rows share, and whether other values have their digest.

    _k is the values as text. ``only`` has the rows that count for a flag. Jobs run while the plan is built; ``df`` is read
    once and, for each flag, in its columns once more, so it should be cut.
    """
    hashes = _hashes(flags, only or {})
    twice = _twice(df, hashes)
    few = is_small(twice)
    return _confirmed(df if few else _with_near(df, hashes, twice), flags, hashes, twice, not few)


def with_repeats(df: DataFrame, flags: dict[str, list[Column]], only: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds a boolean for each flag: whether another row has the same values in its columns; nulls are equal.

    ``keep`` names the columns of ``df`` that the result has; without it all stay. Where too many values repeat for a broadcast,
    rows that the bitmap leaves out are passed on as they are; of the others the kept columns and the digests are shuffled, and
    written with their flag while the plan is built.
    """
    only, keep = only or {}, df.columns if keep is None else keep
    hashes = _hashes(flags, only)
    twice = _twice(df, hashes)
    few = is_small(twice)
    out = df if few else _with_near(df, hashes, twice)
    found = _confirmed(out, flags, hashes, twice, not few)
    # digests of several values need the values themselves; of others no value is carried
    kept = found.select("_f", F.col("_d0").alias("_e0"), F.col("_d1").alias("_e1"), F.when(F.col("mixed"), F.col("_k")).alias("_e"))
    kept = small(kept) if few else kept
    mixed = not found.where("mixed").isEmpty()
    reads = {}
    for name, columns in flags.items():
        a, b = digest(columns)
        reads[name] = {f"_d0_{name}": a, f"_d1_{name}": b}
        if few:  # the bitmap marks only rows that count
            reads[name][f"_on_{name}"] = only.get(name, F.lit(True))
        if mixed:
            reads[name][f"_v_{name}"] = F.array(*[c.cast("string") for c in columns])
    near = [] if few else [f"_near_{name}" for name in flags]
    out = out.withColumns({k: c for each in reads.values() for k, c in each.items()}).select(*[f"`{c}`" for c in keep], *near, *[k for each in reads.values() for k in each])
    for i, name in enumerate(flags):
        right = kept.where(F.col("_f") == i).drop("_f")
        same = F.col("_e").isNull() | (F.col(f"_v_{name}") == F.col("_e")) if mixed else F.lit(True)
        on = (F.col(f"_d0_{name}") == F.col("_e0")) & (F.col(f"_d1_{name}") == F.col("_e1")) & same
        on = on & F.col(f"_on_{name}") if few else on
        mark = lambda rows: rows.join(right, on, "left").withColumn(name, F.col("_e0").isNotNull()).drop("_e0", "_e1", "_e", *reads[name])  # noqa: B023, E731
        if few:
            out = mark(out)
        else:
            at = F.col(f"_near_{name}")
            rest = out.where(~at).withColumn(name, F.lit(False)).drop(*reads[name])
            out = rest.unionByName(cut(mark(out.where(at)), "marked")).drop(f"_near_{name}")
    return out


def surplus(df: DataFrame) -> DataFrame:
    """One row, ``repetidas``: rows beyond the first of those that are equal in all columns."""
    exact = groups(df, {"linha": [F.col(f"`{c}`") for c in df.columns]})
    return exact.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repetidas"))


def repeated_rows(df: DataFrame, flags: dict[str, list[Column]], only: dict[str, Column] | None = None) -> DataFrame:
    """One row: for each flag the rows that ``with_repeats`` would mark; no flag is brought back to the rows.

    Flags of one column are counted by its values, as most of them may repeat.
    """
    only = only or {}
    wide = {k: c for k, c in flags.items() if len(c) > 1}
    out = None
    if wide:
        n = [F.coalesce(F.sum(F.when(F.col("_f") == i, F.col("n"))), F.lit(0)).alias(k) for i, k in enumerate(wide)]
        out = groups(df, wide, only).agg(*n)
    for k in [k for k in flags if k not in wide]:
        counts = df.where(only.get(k, F.lit(True))).groupBy(flags[k][0].alias("_v")).agg(F.count(F.lit(1)).alias("n"))
        one = counts.where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(k))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out.select(*flags)
