"""Allocation of forecasts of modelling units to materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.operators.joins import checked_join

SCENARIOS = ("previsao_base", "previsao_inferior", "previsao_superior")


def share(value: Column, by: str) -> Column:
    """Part of the group's total of values clipped at zero; equal parts where the total is zero."""
    group = W.partitionBy(by)
    v = F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(F.try_divide(v, F.sum(v).over(group)), 1 / F.count(F.lit(1)).over(group))


def weights(history: DataFrame) -> DataFrame:
    """peso_rateio from half the quantity's share, 0.3 of the purchases' and 0.2 of the months'; 1 for single materials.

    ``history``: unidade_modelagem, nivel_modelagem, codigo_catmat, quantidade_historica, compras_distintas, meses_ativos.
    """
    unit = "unidade_modelagem"
    out = history.withColumns(
        {
            "parte_quantidade": share(F.col("quantidade_historica"), unit),
            "parte_compras": share(F.col("compras_distintas"), unit),
            "parte_meses": share(F.col("meses_ativos"), unit),
        }
    )
    mix = 0.5 * F.col("parte_quantidade") + 0.3 * F.col("parte_compras") + 0.2 * F.col("parte_meses")
    out = out.withColumn("_m", F.when(F.col("nivel_modelagem") == "INDIVIDUAL", 1.0).otherwise(mix))
    return out.withColumn("peso_rateio", F.col("_m") / F.sum("_m").over(W.partitionBy(unit))).drop("_m")


def weight_errors(w: DataFrame) -> DataFrame:
    """Modelling units whose weights do not add up to one."""
    return w.groupBy("unidade_modelagem").agg(F.sum("peso_rateio").alias("soma")).where(F.abs(F.col("soma") - 1) > 1e-8)


def require_weights(w: DataFrame) -> DataFrame:
    """``w`` itself; an error if the weights of a unit don't add up to one."""
    wrong = weight_errors(w).limit(1).collect()
    if wrong:
        raise ValueError(f"weights of {wrong[0]['unidade_modelagem']} add up to {wrong[0]['soma']}")
    return w


def allocate(forecast: DataFrame, w: DataFrame) -> DataFrame:
    """Scenarios of each material; a unit without weights is an error when the result is computed."""
    w = w.select("unidade_modelagem", "codigo_catmat", "peso_rateio")
    out = forecast.join(w, "unidade_modelagem", "left")
    weight = F.coalesce("peso_rateio", F.raise_error(F.concat(F.lit("no weights for "), "unidade_modelagem")).cast("double"))
    return out.withColumns({s: F.col(s) * weight for s in SCENARIOS})


def preservation(forecast: DataFrame, allocated: DataFrame) -> DataFrame:
    """Per unit, month and scenario: the unit's total, the allocated total, and whether they agree."""
    def long(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy("unidade_modelagem", "mes").agg(*[F.sum(s).alias(s) for s in SCENARIOS])
        return sums.unpivot(["unidade_modelagem", "mes"], list(SCENARIOS), "cenario", name)

    both = long(forecast, "esperado").join(long(allocated, "alocado"), ["unidade_modelagem", "mes", "cenario"], "left")
    gap = F.abs(F.col("esperado") - F.col("alocado"))
    return both.withColumn("preservado", F.coalesce(gap <= 1e-8 + 1e-5 * F.abs("esperado"), F.lit(False)))


#: Fixed value: what a summary of materials is grouped by.
SUMMARY_KEYS = [
    "codigo_catmat", "unidade_modelagem", "nivel_modelagem", "segmento_modelagem", "modelo_selecionado", "confianca_previsao", "metodo_rateio", "peso_rateio",
]


def material_summary(allocated: DataFrame) -> DataFrame:
    """Totals of the horizon, the monthly mean and the different monthly values of each material, by those of the keys that there are."""
    by = [c for c in SUMMARY_KEYS if c in allocated.columns]
    return allocated.groupBy(*by).agg(
        *[F.sum(s).alias(f"previsao_12m_{s[9:]}") for s in SCENARIOS],
        F.avg("previsao_base").alias("media_mensal_prevista_base"),
        F.count_distinct(F.round("previsao_base", 8)).alias("valores_mensais_distintos_base"),
    )


def to_scenarios(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Wide scenario columns to rows with cenario, ordem_cenario (1 to 3) and quantidade_prevista."""
    long = wide.unpivot(ids, list(SCENARIOS), "_s", "quantidade_prevista")
    names = F.create_map(*[F.lit(x) for p in zip(SCENARIOS, ("BASE", "INFERIOR", "SUPERIOR"), strict=True) for x in p])
    order = F.create_map(F.lit("INFERIOR"), F.lit(1), F.lit("BASE"), F.lit(2), F.lit("SUPERIOR"), F.lit(3))
    out = long.withColumn("cenario", names[F.col("_s")]).drop("_s")
    return out.withColumn("ordem_cenario", order[F.col("cenario")])


def from_scenarios(long: DataFrame, ids: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot("cenario", ["BASE", "INFERIOR", "SUPERIOR"]).agg(F.sum("quantidade_prevista"))


def _kind_and_step() -> tuple[Column, Column]:
    alone = F.coalesce(F.upper("nivel_modelagem") == "INDIVIDUAL", F.lit(False))
    # fixed values: kinds and next steps by level
    kind = F.when(alone, "INTERMITENTE_INDIVIDUAL").otherwise("INTERMITENTE_SEGMENTO")
    step = F.when(alone, "Recalibrar com consumo interno, estoque e plano de obras.").otherwise(
        "Recalibrar o segmento com consumo interno e revisar os pesos de rateio."
    )
    return kind, step


def summary_for_star(summary: DataFrame, units: DataFrame, w: DataFrame) -> DataFrame:
    """Summary rows of materials with the figures of their units and their history, in the shape of the star's summary.

    Each unit must be once in ``units``, each material once in ``summary`` and in ``w``.
    """
    figures = ["wape_validacao", "mae_validacao", "janelas_validacao", "meses_com_demanda", "percentual_meses_sem_demanda"]
    out = checked_join(summary, units.select("unidade_modelagem", *figures), ["unidade_modelagem"])
    out = checked_join(out, w.select("codigo_catmat", "quantidade_historica"), ["codigo_catmat"], one_to_one=True)
    kind, step = _kind_and_step()
    return out.withColumns(
        {
            "tipo_demanda": kind,
            "previsao_12m_cenario_inferior": F.col("previsao_12m_inferior"),
            "previsao_12m_cenario_superior": F.col("previsao_12m_superior"),
            "quantidade_historica_total": F.col("quantidade_historica"),
            "wape_validacao_percentual": F.col("wape_validacao").try_cast("double") * 100,
            "proximos_passos": step,
        }
    )


def for_star(allocated: DataFrame) -> DataFrame:
    """Allocated forecast in the shape of the forecast fact: error reference, WAPE in percent, kind and next step."""
    kind, step = _kind_and_step()
    return allocated.withColumns(
        {
            "tipo_demanda": kind,
            "erro_referencia_mensal": F.col("previsao_base") * F.col("incerteza"),
            "wape": F.col("wape") * 100,
            "proximo_passo": step,
        }
    )
