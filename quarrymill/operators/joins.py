"""Checked joins and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import units
from quarrymill.functions.text import present
from quarrymill.operators.filters import one_per
from quarrymill.operators.ranks import modes


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; an error if a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0].asDict()} occurs more than once")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join whose right side, and left side if asked, has each key once."""
    require_unique(right, keys)
    if one_to_one:
        require_unique(left, keys)
    return left.join(right, keys, how)


def with_catalogue(fact: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Family of each code; unknown codes keep a null."""
    c = catalogue.select(F.col("codigo").alias("codigo_catmat"), "familia_material").dropDuplicates(["codigo_catmat"])
    return fact.drop("familia_material").join(c, "codigo_catmat", "left")


def clean_identifier(c: str | Column) -> Column:
    """Trimmed text; blanks and words for nothing are null."""
    return present(c)


def key_matches(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair of key columns: filled and different values of both sides, left rows whose value the right side has, and their
    percentage of the filled ones; best first. Pairs with an empty side or without their left column are left out.

    All pairs go through one shuffle: values are counted by (pair, value) with a count for each side, so that a value that
    fills a column is one row.
    """
    there = [(a, b) for a, b in pairs if a in left.columns and b in right.columns]

    def side(df: DataFrame, k: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("_i"), clean_identifier(pair[k]).alias("_v")) for i, pair in enumerate(there)])
        ones = [F.lit(int(s == k)).cast("long").alias(n) for s, n in enumerate(("_a", "_b"))]
        return df.select(F.inline(each)).where("_v is not null").select("_i", "_v", *ones)

    counts = side(left, 0).unionByName(side(right, 1)).groupBy("_i", "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = counts.groupBy("_i").agg(
        F.sum("_a").alias("gold_preenchidos"),
        F.sum("_b").alias("bronze_preenchidos"),
        F.count_if(F.col("_a") > 0).alias("gold_unicos"),
        F.count_if(F.col("_b") > 0).alias("bronze_unicos"),
        F.coalesce(F.sum(F.when(F.col("_b") > 0, F.col("_a"))), F.lit(0)).alias("correspondencias"),
    ).where("gold_preenchidos > 0 and bronze_preenchidos > 0")
    name = lambda k: F.get(F.array(*[F.lit(p[k]) for p in there]), F.col("_i"))
    percent = F.round(100.0 * F.col("correspondencias") / F.col("gold_preenchidos"), 2)
    out = sums.select(name(0).alias("coluna_gold"), name(1).alias("coluna_bronze"), *sums.columns[1:], percent.alias("percentual_correspondencia"))
    return out.orderBy(F.desc("correspondencias"), F.desc("percentual_correspondencia"), "coluna_gold", "coluna_bronze")


def first_by_key(bronze: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of each key, nulls last."""
    return one_per(bronze.where(F.col(key).isNotNull()), [key], *[F.asc_nulls_last(c) for c in order])


def key_conflicts(bronze: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field the keys with more than one different value."""
    counts = bronze.groupBy(key).agg(*[(F.count_distinct(f) > 1).cast("long").alias(f) for f in fields])
    return counts.agg(*[F.sum(f).alias(f) for f in fields]).unpivot([], fields, "campo", "conflitos")


def enrich_units(fact: DataFrame, bronze: DataFrame, key: str) -> DataFrame:
    """Units of the bronze records by a key that is unique on both sides."""
    right = bronze.select(key, "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade")
    left = fact.drop("sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade", "unidade_comparavel")
    out = checked_join(left, right, [key], one_to_one=True)
    unit = units.comparable_unit_upper("capacidade", "sigla_unidade_fornecimento", "nome_unidade_fornecimento")
    return out.withColumn("unidade_comparavel", unit).withColumn("unidade_informada", F.col("unidade_comparavel").isNotNull())


def unmatched(df: DataFrame, column: str = "unidade_comparavel") -> DataFrame:
    return df.where(F.col(column).isNull())


def sample_matched(df: DataFrame, *order: str, n: int = 1000, column: str = "unidade_comparavel") -> DataFrame:
    return df.where(F.col(column).isNotNull()).orderBy(*order).limit(n)


def describe_codes(rows: DataFrame, history: DataFrame, column: str = "descricao_item") -> DataFrame:
    """The most frequent description of each code."""
    names = modes(history, ["codigo_catmat"], {column: F.col(column)})
    return rows.drop(column).join(names, "codigo_catmat", "left")


def orphans(fact: DataFrame, key: str, dimension: DataFrame, dim_key: str | None = None) -> DataFrame:
    """Different fact keys that the dimension lacks."""
    dim = dimension.select(F.col(dim_key or key).alias(key)).distinct()
    return fact.select(key).where(F.col(key).isNotNull()).distinct().join(dim, key, "left_anti")


def compare_tables(staged: DataFrame, published: DataFrame, key: str, *values: Column | str) -> DataFrame:
    """Both sides of a table of tables by name, and whether all values are equal."""
    names = [v for v in staged.columns if v != key]
    a = staged.withColumnsRenamed({c: f"{c}_preparado" for c in names})
    b = published.withColumnsRenamed({c: f"{c}_publicado" for c in names})
    equal = F.lit(True)
    for c in names:
        equal = equal & F.col(f"{c}_preparado").eqNullSafe(F.col(f"{c}_publicado"))
    return a.join(b, key, "full_outer").withColumn("igual", equal)
