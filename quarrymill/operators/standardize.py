"""Standardisation jobs: text, amounts, units, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import keys, text, units


def standardize_text(df: DataFrame, column: str) -> DataFrame:
    """Adds <column>_limpo, <column>_normalizado and <column>_maiusculo."""
    return df.withColumns(
        {
            f"{column}_limpo": text.clean_text(column),
            f"{column}_normalizado": text.normalize_text(column),
            f"{column}_maiusculo": text.upper_text(column),
        }
    )


def text_report(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per source: rows, rows that cleaning changes, rows that are blank."""
    clean = text.clean_text(column)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(~clean.eqNullSafe(F.col(column))).alias("alteradas"),
        F.count_if(clean.isNull()).alias("vazias"),
    )


def type_amounts(df: DataFrame, columns: list[str], parse=text.parse_decimal) -> DataFrame:
    """Amount columns as doubles."""
    return df.withColumns({c: parse(c) for c in columns})


def amount_rejects(df: DataFrame, columns: list[str], parse=text.parse_decimal) -> DataFrame:
    """Per column: values given, values that are no number, and the least such value."""
    bad = {c: F.col(c).isNotNull() & parse(c).isNull() for c in columns}
    aggs = [
        F.struct(
            F.lit(c).alias("coluna"),
            F.count(c).alias("preenchidos"),
            F.count_if(bad[c]).alias("rejeitados"),
            F.min(F.when(bad[c], F.col(c).cast("string"))).alias("exemplo"),
        ).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("r")).select("r.*")


def harmonize_units(df: DataFrame, short: str, name: str, capacity: str) -> DataFrame:
    return df.withColumn("unidade_comparavel", units.comparable_unit(short, name, capacity))


def unit_coverage(df: DataFrame, by: str) -> DataFrame:
    """Per group: rows, rows with a comparable unit, different units."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count("unidade_comparavel").alias("com_unidade"),
        F.count_distinct("unidade_comparavel").alias("unidades"),
    )


def add_keys(df: DataFrame, id_fields: list[str | Column], item_fields: list[str], supplier: tuple[str, str]) -> DataFrame:
    """Observation id, item key and supplier key."""
    return df.withColumns(
        {
            "purchase_id": keys.observation_id(*id_fields),
            "chave_item": keys.first_present(*item_fields),
            "chave_fornecedor": keys.supplier_key(*supplier),
        }
    )


def key_collisions(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that stand for rows with different fields."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("variantes")).where("variantes > 1")


def round_all(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, for results that are compared."""
    return df.select(*[F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
