"""Identifiers, date keys, scores and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import clean_text, col, present


def _joined(fields: list[str | Column], missing: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(f).cast("string"), F.lit(missing)) for f in fields])


def observation_id(*fields: str | Column) -> Column:
    """24 hexadecimal digits of the fields' SHA-256; nulls count, as a word."""
    return F.substring(F.sha2(_joined(list(fields), "None"), 256), 1, 24)


def pilot_id(*fields: str | Column) -> Column:
    """MED- and 20 hexadecimal digits of the fields' SHA-1; nulls count, as nothing."""
    return F.concat(F.lit("MED-"), F.substring(F.sha1(_joined(list(fields), "")), 1, 20))


def first_present(*fields: str | Column) -> Column:
    return F.coalesce(*[present(f) for f in fields])


def supplier_key(tax_id: str | Column, name: str | Column) -> Column:
    return F.coalesce(present(tax_id), present(name), F.lit("NAO_IDENTIFICADO"))


def key_or(c: str | Column, sentinel: str) -> Column:
    return F.coalesce(clean_text(c), F.lit(sentinel))


def date_keys(c: str | Column) -> dict[str, Column]:
    """Columns data, data_key (yyyymmdd), mes_key (yyyymm), ano, ano_mes, inicio_mes."""
    d = col(c).cast("date")
    return {
        "data": d,
        "data_key": F.date_format(d, "yyyyMMdd").cast("int"),
        "mes_key": F.date_format(d, "yyyyMM").cast("int"),
        "ano": F.year(d),
        "ano_mes": F.date_format(d, "yyyy-MM"),
        "inicio_mes": F.trunc(d, "month"),
    }


def coverage_score(n: str | Column) -> Column:
    n = col(n)
    return F.when(F.coalesce(n > 0, F.lit(False)), F.round(10 * F.log10(n + 1), 2)).otherwise(0.0)


def severity(price: str | Column, median: str | Column) -> Column:
    """How far a price is from its median: five or three times, or a fifth or a third."""
    median = col(median)
    ratio = F.try_divide(col(price), median)
    return (
        F.when(~F.coalesce(median > 0, F.lit(False)), "REVISAR")
        .when((ratio >= 5) | (ratio <= 0.20), "CRITICO")
        .when((ratio >= 3) | (ratio <= 0.33), "ALTO")
        .otherwise("MODERADO")
    )


def concentration_class(hhi: str | Column) -> Column:
    hhi = col(hhi)
    return F.when(hhi >= 2500, "ALTA").when(hhi >= 1500, "MODERADA").otherwise("BAIXA")
