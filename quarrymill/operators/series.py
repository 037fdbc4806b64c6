"""Monthly demand series, their profile, and the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.operators.measures import join_groups
from quarrymill.operators.ranks import distinct_counts
from quarrymill.sources.scratch import cut

#: Names of the months and of the days from Monday on.
MONTHS = "Jan Fev Mar Abr Mai Jun Jul Ago Set Out Nov Dez".split()
DAYS = "Seg Ter Qua Qui Sex Sáb Dom".split()


def monthly_series(df: DataFrame, by: list[str], start: str | None = None, end: str | None = None, purchase: str | None = None) -> DataFrame:
    """Every key with every month of the given range, else of the whole table; missing months are zero.

    With ``purchase``, a column that names purchases, compras_distintas is added. The sums of months are written while the plan is
    built; ``df`` is read once, with ``purchase`` twice.
    """
    month = F.trunc("data_publicacao", "month")
    rows = df.select(*by, month.alias("mes"), "quantidade", *([purchase] if purchase else []))
    sums = rows.groupBy(*by, "mes").agg(
        F.coalesce(F.sum("quantidade"), F.lit(0.0)).alias("quantidade_total"), F.count(F.lit(1)).alias("numero_observacoes")
    )
    if purchase:
        sums = join_groups(sums, distinct_counts(rows, [*by, "mes"], {"compras_distintas": F.col(purchase)}), [*by, "mes"])
    sums = cut(sums, "months")
    ends = sums.agg(F.min("mes").alias("a"), F.max("mes").alias("b"))
    if start and end:
        ends = ends.select(F.trunc(F.lit(start), "month").alias("a"), F.trunc(F.lit(end), "month").alias("b"))
    months = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("mes"))
    grid = sums.select(*by).distinct().crossJoin(F.broadcast(months))  # months of a range of dates
    values = [c for c in sums.columns if c not in (*by, "mes")]
    zero = {c: 0.0 if c == "quantidade_total" else 0 for c in values}
    return join_groups(grid, sums, [*by, "mes"]).select(*by, "mes", *[F.coalesce(c, F.lit(zero[c])).alias(c) for c in values])


def roll_up(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """Series of modelling units from those of materials; ``mapping`` has codigo_catmat and the unit's columns.

    catmats_ativos are the materials of the unit, with demand in the month or not.
    """
    unit = ["unidade_modelagem", "nivel_modelagem", "segmento_modelagem"]
    known = ["compras_distintas"] if "compras_distintas" in series.columns else []
    return series.join(mapping, "codigo_catmat").groupBy(*unit, "mes").agg(
        F.sum("quantidade_total").alias("quantidade"),
        F.sum("numero_observacoes").alias("registros"),
        *[F.sum(c).alias(c) for c in known],
        F.count_distinct("codigo_catmat").alias("catmats_ativos"),
    )


def as_arrays(series: DataFrame, by: list[str], value: str = "quantidade_total") -> DataFrame:
    """One row per key: a (values by month) and ultimo_mes. An array is as long as the range of months."""
    packed = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("mes", F.col(value).alias("v")))).alias("_s"))
    return packed.select(*by, F.transform("_s", lambda x: x["v"]).alias("a"), F.element_at("_s", -1)["mes"].alias("ultimo_mes"))


def intermittency(series: DataFrame, by: list[str]) -> DataFrame:
    """Months, active and zero months, zero share, mean gap, squared variation, class of demand."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("mes"))
    q = F.col("quantidade_total")
    at = F.when(q > 0, F.col("_p"))
    out = series.withColumn("_p", place).groupBy(*by).agg(
        F.count(F.lit(1)).alias("meses"),
        F.count_if(q > 0).alias("meses_ativos"),
        F.count_if(q <= 0).alias("meses_zero"),
        F.min(at).alias("_a"),
        F.max(at).alias("_b"),
        F.avg(F.when(q > 0, q)).alias("_m"),
        F.stddev_samp(F.when(q > 0, q)).alias("_s"),
    )
    gap = (
        F.when(F.col("meses_ativos") > 1, (F.col("_b") - F.col("_a")) / (F.col("meses_ativos") - 1))
        .when(F.col("meses_ativos") == 1, F.col("meses").cast("double"))
        .otherwise(F.lit(float("inf")))
    )
    out = out.withColumns(
        {
            "zeros_pct": F.round(F.try_divide(100.0 * F.col("meses_zero"), F.col("meses")), 2),
            "adi": gap,
            "cv2": F.when(F.col("meses_ativos") == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.pow(F.try_divide("_s", "_m"), 2), F.lit(0.0))),
        }
    )
    slow, wild = F.col("adi") >= 1.32, F.col("cv2") >= 0.49
    kind = (
        F.when(F.col("meses_ativos") == 0, "SEM_DEMANDA")
        .when(slow & wild, "IRREGULAR_INTERMITENTE")
        .when(slow, "INTERMITENTE")
        .when(wild, "ERRATICA")
        .otherwise("REGULAR")
    )
    return out.withColumn("tipo_demanda", kind).drop("_a", "_b", "_m", "_s")


#: Strategies by level.
STRATEGIES = {"INDIVIDUAL": "Modelo individual por CATMAT", "SEGMENTO": "Modelo agregado por segmento com distribuição robusta aos CATMATs"}


def unit_diagnostic(fact: DataFrame, units: DataFrame, weights: DataFrame) -> DataFrame:
    """Per modelling unit: materials, rows, quantity and years of the fact, months with and without demand, weights, strategy.

    ``fact`` has the rows with their unidade_modelagem, ``units`` the zero-filled series, ``weights`` the materials' peso_rateio.
    """
    unit = ["unidade_modelagem"]
    series = units.groupBy("unidade_modelagem", "nivel_modelagem", "segmento_modelagem").agg(
        F.count_if(F.col("quantidade") > 0).alias("meses_ativos"),
        F.try_divide(F.count_if(F.col("quantidade") == 0), F.count(F.lit(1))).alias("percentual_meses_sem_demanda"),
    )
    rows = fact.groupBy(*unit).agg(F.count(F.lit(1)).alias("registros"), F.coalesce(F.sum("quantidade"), F.lit(0.0)).alias("quantidade_total"))
    keys = {"catmats": F.col("codigo_catmat"), "anos_ativos": F.year("data_publicacao")}
    rows = join_groups(rows, distinct_counts(fact, unit, keys), unit)
    w = weights.groupBy(*unit).agg(F.min("peso_rateio").alias("peso_minimo"), F.max("peso_rateio").alias("peso_maximo"))
    plan = F.when(F.col("nivel_modelagem") == "INDIVIDUAL", STRATEGIES["INDIVIDUAL"]).otherwise(STRATEGIES["SEGMENTO"])
    out = join_groups(join_groups(series, rows, unit), w, unit).withColumn("estrategia_previsao", plan)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("registros", "catmats", "anos_ativos")}).withColumn("quantidade_total", F.coalesce("quantidade_total", F.lit(0.0)))


def future_months(last: Column, h: int) -> Column:
    """The h month starts after a month."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, h), F.expr("interval 1 month"))


def calendar(*dates: DataFrame) -> DataFrame:
    """Every day between the first and last date of one-column tables."""
    union = None
    for d in dates:
        one = d.select(F.col(d.columns[0]).cast("date").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
        union = one if union is None else union.union(one)
    days = union.agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a is not null")
    days = days.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("data"))
    name = F.get(F.array(*map(F.lit, MONTHS)), F.month("data") - 1)
    weekday = F.weekday("data") + 1
    return days.select(
        F.date_format("data", "yyyyMMdd").cast("int").alias("data_key"),
        F.date_format("data", "yyyyMM").cast("int").alias("mes_key"),
        "data",
        F.trunc("data", "month").alias("inicio_mes"),
        F.year("data").alias("ano"),
        F.month("data").alias("mes_numero"),
        name.alias("mes_nome"),
        F.concat(name, F.lit("/"), F.year("data").cast("string")).alias("mes_ano"),
        F.date_format("data", "yyyy-MM").alias("ano_mes"),
        F.quarter("data").alias("trimestre_numero"),
        F.concat(F.lit("T"), F.quarter("data").cast("string")).alias("trimestre"),
        F.concat(F.year("data").cast("string"), F.lit("-T"), F.quarter("data").cast("string")).alias("ano_trimestre"),
        F.when(F.month("data") <= 6, "S1").otherwise("S2").alias("semestre"),
        F.day("data").alias("dia"),
        weekday.alias("dia_semana"),
        F.get(F.array(*map(F.lit, DAYS)), weekday - 1).alias("dia_semana_nome"),
        (weekday >= 6).alias("fim_de_semana"),
    )
