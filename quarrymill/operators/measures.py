"""Measures of the semantic model under a filter context.

A context is a group of ``by``. A measure may leave out the filters on some of its columns, as on those of the suppliers or
of the calendar, or all of them. ``in_contexts`` gives sums in several contexts from one aggregation of the facts: the wider
contexts are added up from the groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import key_or
from quarrymill.operators.ranks import distinct_counts, exact_quantiles

#: Keys of what is not known.
NO_SUPPLIER, NO_BUYER, NO_UNIT = "FORNECEDOR_NAO_INFORMADO", "UASG_NAO_INFORMADA", "UNIDADE_NAO_INFORMADA"
#: Columns of the dimensions whose filters a measure leaves out.
SUPPLIER_COLUMNS = ("cnpj_fornecedor", "fornecedor_nome", "fornecedor_key")
CALENDAR_COLUMNS = ("data", "ano", "ano_mes", "mes", "inicio_mes", "trimestre", "semestre")


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join of two tables of groups; null keys are equal. Without ``by`` the right side has one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"{c}_r" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in by])
    return left.join(right, on, how).drop(*[f"{c}_r" for c in by])


def in_contexts(df: DataFrame, by: list[str], sums: dict[str, Column], without: dict[str, tuple[str, ...]]) -> DataFrame:
    """Sums of each group and, as ``<sum>_<name>``, the same sums with the filters on the columns of ``without[name]`` left out.

    ``sums`` are values to add up; of nothing but nulls the sum is null. Columns that are not in ``by`` have no filter, so they
    change nothing; if all of ``by`` is left out, the context is the whole table.
    """
    base = df.groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    out = base
    for name, columns in without.items():
        rest = [c for c in by if c not in columns]
        out = join_groups(out, base.groupBy(*rest).agg(*[F.sum(k).alias(f"{k}_{name}") for k in sums]), rest)
    return out


#: Columns and flags that ``evaluate`` reads beside the groups.
FACT_COLUMNS = ["quantidade", "valor_total", "valor_unitario", "unidade_comparavel", "id_compra", "codigo_catmat", "cnpj_fornecedor", "uasg"]
FACT_FLAGS = ["dq_possui_erro", "is_price_outlier", "hist_item_repetido", "dq_duplicidade"]


def evaluate(df: DataFrame, by: list[str]) -> DataFrame:
    """Measures of volume and quality per group: sums from one aggregation, medians from counts of prices, distinct counts from one pass.

    Suppliers and buyers that are not known are not counted.
    """
    n = F.count(F.lit(1))
    sums = df.groupBy(*by).agg(
        F.sum("quantidade").alias("quantidade"),
        F.sum("valor_total").alias("valor"),
        n.alias("registros"),
        F.count_if("dq_possui_erro").alias("erros"),
        F.count_if(F.col("unidade_comparavel").isNull()).alias("sem_unidade"),
        F.count_if("is_price_outlier").alias("alertas"),
        F.count_if("hist_item_repetido").alias("historico"),
        F.count_if("dq_duplicidade").alias("duplicados"),
    )
    known = lambda c, sentinel: F.when(F.col(c).cast("string") != sentinel, F.col(c))
    keys = {
        "compras": F.col("id_compra"), "materiais": F.col("codigo_catmat"),
        "fornecedores": known("cnpj_fornecedor", NO_SUPPLIER), "uasgs": known("uasg", NO_BUYER),
    }
    out = join_groups(sums, distinct_counts(df, by, keys), by)
    out = join_groups(out, exact_quantiles(df, by, "valor_unitario", [0.5]).select(*by, F.col("q")[0].alias("preco_mediano")), by)
    return out.withColumns(
        {
            "preco_ponderado": F.try_divide("valor", "quantidade"),
            "ticket": F.try_divide("valor", "compras"),
            "taxa_erro": F.try_divide("erros", "registros"),
            "cobertura_unidade": 1 - F.try_divide("sem_unidade", "registros"),
            "taxa_alerta": F.try_divide("alertas", "registros"),
        }
    )


def concentration(df: DataFrame, by: list[str]) -> DataFrame:
    """HHI and largest supplier share per group; the total is that of the context without its filters on suppliers.

    So in a group of one supplier the share is that of the supplier among all of the context. Without a total, or a total of
    zero, both are null.
    """
    keyed = df.withColumn("_key", key_or("cnpj_fornecedor", NO_SUPPLIER))
    each = in_contexts(keyed, [*by, "_key"], {"v": F.col("valor_total")}, {"contexto": (*SUPPLIER_COLUMNS, "_key")})
    share = F.try_divide("v", "v_contexto")
    return each.groupBy(*by).agg((F.sum(share * share) * 10000).alias("hhi"), F.max(share).alias("maior_participacao"))


def price_index(df: DataFrame, by: list[str]) -> DataFrame:
    """Comparable median, which is the median price where one unit of one material is in the group, and the weighted price over it.

    A unit's key is made of the code and the unit, a missing one being a unit as well. With several units both are null.
    """
    unit = F.concat_ws("|", F.col("codigo_catmat").cast("string"), key_or("unidade_comparavel", NO_UNIT))
    sums = df.groupBy(*by).agg(F.sum("valor_total").alias("_v"), F.sum("quantidade").alias("_q"))
    out = join_groups(sums, distinct_counts(df, by, {"_units": unit}), by)
    out = join_groups(out, exact_quantiles(df, by, "valor_unitario", [0.5]).select(*by, F.col("q")[0].alias("_median")), by)
    median = F.when(F.col("_units") == 1, F.col("_median"))
    index = F.try_divide(F.try_divide("_v", "_q"), F.col("mediana_comparavel"))
    return out.withColumn("mediana_comparavel", median).withColumn("indice_preco", index).select(*by, "mediana_comparavel", "indice_preco")


def last_months(df: DataFrame, by: list[str], months: int = 12) -> DataFrame:
    """Last date of all rows, and per group the quantity of the months up to it, with the filters on the calendar left out.

    Facts are added up by group and day once; the last date and all contexts come from that. Null where a context has no quantity.
    """
    days = df.groupBy(*by, F.to_date("data_publicacao").alias("_day")).agg(F.sum("quantidade").alias("_q"))
    last = days.agg(F.max("_day").alias("ultima_data"))
    rest = [c for c in by if c not in CALENDAR_COLUMNS]
    near = days.crossJoin(F.broadcast(last)).where((F.col("_day") > F.add_months("ultima_data", -months)) & (F.col("_day") <= F.col("ultima_data")))  # one row
    sums = near.groupBy(*rest).agg(F.sum("_q").alias(f"quantidade_{months}m"))
    groups = days.select(*by).distinct().crossJoin(F.broadcast(last))  # one row
    return join_groups(groups, sums, rest)


def forecast_measures(long: DataFrame, by: list[str], history: DataFrame | None = None) -> DataFrame:
    """Totals of each scenario, range and relative range; with ``history`` the change against the last months."""
    of = lambda s: F.sum(F.when(F.col("cenario") == s, F.col("quantidade_prevista")))
    out = long.groupBy(*by).agg(
        F.sum("quantidade_prevista").alias("previsao_total"),
        of("BASE").alias("previsao_base"),
        of("INFERIOR").alias("previsao_inferior"),
        of("SUPERIOR").alias("previsao_superior"),
    )
    out = out.withColumn("amplitude", F.col("previsao_superior") - F.col("previsao_inferior"))
    out = out.withColumn("amplitude_relativa", F.try_divide("amplitude", "previsao_base"))
    if history is None:
        return out
    out = join_groups(out, last_months(history, by).drop("ultima_data"), by)
    return out.withColumn("variacao_12m", F.try_divide(F.col("previsao_base") - F.col("quantidade_12m"), F.col("quantidade_12m")))


def confidence_measures(summary: DataFrame) -> DataFrame:
    """Materials by confidence and the mean over materials of their largest WAPE."""
    of = lambda s: F.when(F.col("confianca_previsao") == s, F.col("codigo_catmat"))
    counts = distinct_counts(summary, [], {"alta": of("ALTA"), "media": of("MEDIA"), "baixa": of("BAIXA")})
    each = summary.groupBy("codigo_catmat").agg(F.max("wape").alias("w"))
    return counts.crossJoin(F.broadcast(each.agg(F.avg("w").alias("wape_medio"))))  # one row each
