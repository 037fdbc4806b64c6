"""Row filters and views over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.text import parse_bool, upper_text

_true = lambda c: F.coalesce(F.col(c), F.lit(False))


def in_period(df: DataFrame, start: str, end: str, column: str = "data_publicacao") -> DataFrame:
    """From the start day to the end day, both whole."""
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < after))


def in_closed_period(df: DataFrame, start: str, end: str, column: str = "data_publicacao") -> DataFrame:
    """Between two moments; of the end day only midnight is in."""
    return df.where(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def relevant_materials(catalogue: DataFrame, first: int | None = None) -> DataFrame:
    out = catalogue.where(parse_bool("material_relevante") & F.col("codigo").isNotNull())
    return out.orderBy("codigo").limit(first) if first else out


def valid_purchases(df: DataFrame) -> DataFrame:
    return df.where(~_true("dq_possui_erro") & F.col("familia_material").isNotNull())


def benchmark_rows(df: DataFrame) -> DataFrame:
    return valid_purchases(df).where(~_true("is_price_outlier") & F.col("unidade_comparavel").isNotNull())


def outlier_rows(df: DataFrame) -> DataFrame:
    return df.where(_true("is_price_outlier"))


def history_rows(df: DataFrame) -> DataFrame:
    return df.where(_true("hist_item_repetido"))


def error_rows(df: DataFrame) -> DataFrame:
    return df.where(_true("dq_possui_erro"))


def forecastable(df: DataFrame) -> DataFrame:
    """Rows with date, code, family and a quantity of zero or more that are no duplicates."""
    return df.where(
        F.col("data_publicacao").isNotNull() & F.col("codigo_catmat").isNotNull() & F.col("familia_material").isNotNull()
        & F.coalesce(F.col("quantidade") >= 0, F.lit(False)) & ~_true("dq_duplicidade")
    )


def without_family(df: DataFrame, word: str, old_codes: DataFrame | None = None) -> DataFrame:
    """Leaves out families whose text has ``word``, and codes of ``old_codes``."""
    kept = df.where(~F.contains(upper_text("familia_material"), F.lit(word)))
    return kept.join(old_codes.select("codigo_catmat").distinct(), "codigo_catmat", "left_anti") if old_codes is not None else kept


def one_per(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def candidates(df: DataFrame) -> DataFrame:
    """Evaluated and selected codes with records, one row each, most records first; of equal counts the row with the least other columns."""
    good = df.where((F.col("status") == "OK") & (F.col("registros") > 0) & parse_bool("selecionado"))
    rest = [F.asc_nulls_last(c) for c in sorted(df.columns) if c not in ("codigo", "registros")]
    return one_per(good, ["codigo"], F.desc("registros"), *rest).orderBy(F.desc("registros"), "codigo")


def group_candidates(df: DataFrame) -> DataFrame:
    """Product groups with a measuring or electrical score, one row per numeric code, best first."""
    good = df.where((F.col("score_medicao") > 0) | (F.col("score_eletrico") > 0))
    good = good.withColumn("codigo_pdm", F.col("codigo_pdm").try_cast("long")).where("codigo_pdm is not null")
    return one_per(good, ["codigo_pdm"], F.desc("elegivel"), F.desc("score_total"), F.asc("nome_pdm"))


def selected_or_eligible(df: DataFrame) -> DataFrame:
    """Selected rows if any row is selected, else the eligible ones; one per code."""
    any_selected = df.agg(F.coalesce(F.bool_or(parse_bool("selecionado")), F.lit(False)).alias("_any"))
    kept = df.crossJoin(F.broadcast(any_selected)).where(  # one row on the right
        F.when(F.col("_any"), parse_bool("selecionado")).otherwise(parse_bool("elegivel"))
    )
    return one_per(kept.drop("_any"), ["codigo_pdm"], F.desc("score_total"), F.asc("nome_pdm"))


def candidate_catalogue(df: DataFrame, only_selected: bool = False) -> DataFrame:
    """Catalogue with numeric codes, one row each."""
    out = df.withColumn("codigo", F.col("codigo").try_cast("long")).where("codigo is not null")
    out = out.where(parse_bool("selecionado")) if only_selected else out
    return one_per(out, ["codigo"], F.asc_nulls_last("descricao"))
