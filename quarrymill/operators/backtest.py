"""Rolling-origin backtests, model choice, confidence and scenario bands, for all series in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import models
from quarrymill.operators.measures import join_groups
from quarrymill.operators.series import future_months

HORIZON, STEP, LEAST_TRAINING = 12, 3, 12


def rolling_folds(n: Column) -> Column:
    """Lengths of the training parts: four, three or two folds of three months at the end."""
    folds = F.when(n >= 36, 4).when(n >= 24, 3).when(n >= 15, 2).otherwise(0)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(folds, F.lit(1))), lambda k: n - STEP * k)
    return F.when(folds == 0, F.array().cast("array<int>")).otherwise(F.filter(cuts, lambda c: c >= LEAST_TRAINING))


def yearly_folds(n: Column) -> Column:
    """Cuts after 24, 36, ... months that leave a year, and a year before the end; none below 24 months of training."""
    last = n - 12
    steps = F.array_union(F.sequence(F.lit(24), F.greatest(last, F.lit(24)), F.lit(12)), F.array(last))
    return F.when(last >= 24, steps).otherwise(F.array().cast("array<int>"))


def errors(arrays: DataFrame, by: list[str], pool: dict[str, models.Model], folds: Column, h: int, kind: str | None = None) -> DataFrame:
    """Rows of key, model, fold, step with y and f; with ``kind``, a column of kinds of demand, of the models that the kind may use."""
    cut = arrays.select(*by, "a", *([kind] if kind else []), F.explode(folds).alias("corte"))
    one = lambda k, m: F.struct(F.lit(k).alias("modelo"), m(F.slice("a", F.lit(1), F.col("corte")), h).alias("f"))
    made = F.array(*[F.when(allowed(F.col(kind), F.lit(k)), one(k, m)) if kind else one(k, m) for k, m in pool.items()])
    each = cut.withColumn("m", F.explode(F.array_compact(made)))
    truth = F.slice("a", F.col("corte") + 1, F.lit(h))
    pairs = F.filter(F.arrays_zip(truth.alias("y"), F.col("m.f").alias("f")), lambda p: p["y"].isNotNull())
    return each.select(*by, F.col("m.modelo").alias("modelo"), "corte", F.posexplode(pairs).alias("passo", "p")).select(
        *by, "modelo", "corte", "passo", "p.y", "p.f"
    )


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, WAPE in percent, bias and error quantiles of each model, over all folds."""
    e = F.abs(F.col("f") - F.col("y"))
    return rows.groupBy(*by, "modelo").agg(
        F.count_distinct("corte").alias("janelas"),
        F.count(F.lit(1)).alias("pontos"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.try_divide(F.sum(e), F.nullif(F.sum(F.abs("y")), F.lit(0.0)))).alias("wape"),
        F.avg(F.col("f") - F.col("y")).alias("vies"),
        F.percentile(e, 0.8).alias("erro_q80"),
        F.percentile(e, 0.9).alias("erro_q90"),
    )


def allowed(kind: Column, model: Column) -> Column:
    """Intermittent kinds of demand may use the first four models only."""
    return ~kind.isin("INTERMITENTE", "IRREGULAR_INTERMITENTE", "SEM_DEMANDA") | model.isin(*models.INTERMITTENT)


def ranked(scored: DataFrame, by: list[str]) -> DataFrame:
    order = [F.asc_nulls_last("wape"), F.asc("mae"), F.asc("rmse"), F.asc("modelo")]
    return scored.withColumn("posicao", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def confidence(months: Column, active: Column, zeros: Column, folds: Column, wape: Column) -> Column:
    high = (months >= 36) & (active >= 18) & (zeros <= 50) & (folds >= 4) & (wape <= 35)
    fair = (months >= 24) & (active >= 8) & (folds >= 3) & (wape <= 80)
    return F.when(F.coalesce(high, F.lit(False)), "ALTA").when(F.coalesce(fair, F.lit(False)), "MEDIA").otherwise("BAIXA")


def confidence_reason(level: Column) -> Column:
    return (
        F.when(level == "ALTA", "Histórico amplo, demanda frequente e erro baixo em validação temporal múltipla.")
        .when(level == "MEDIA", "Histórico utilizável, com volatilidade ou intermitência ainda relevante.")
        .otherwise("Série curta, esparsa ou com erro elevado; resultado apenas indicativo.")
    )


def _scored(arrays: DataFrame, profile: DataFrame, by: list[str]) -> DataFrame:
    known = join_groups(arrays, profile.select(*by, "tipo_demanda"), by, "inner")
    return metrics(errors(known, by, models.POOL, rolling_folds(F.size("a")), STEP, "tipo_demanda"), by)


def performance(arrays: DataFrame, profile: DataFrame, by: list[str]) -> DataFrame:
    """Metrics and rank of the models that each series may use; others are not run."""
    return ranked(join_groups(_scored(arrays, profile, by), profile.select(*by, "tipo_demanda"), by), by)


#: Fixed value: models that may stand in for one that forecasts nothing.
STAND_IN = ("CROSTON_SBA", "MEDIA_POSITIVA_X_FREQUENCIA", "MEDIA_HISTORICA")
_FIGURES = ["wape", "mae", "rmse", "modelo", "janelas", "pontos", "vies", "erro_q80", "erro_q90"]


def _run(name: Column, names: tuple[str, ...], h: int) -> Column:
    """Forecast of the named model alone."""
    return F.coalesce(*[F.when(name == k, models.POOL[k](F.col("a"), h)) for k in names])


def choose(arrays: DataFrame, profile: DataFrame, by: list[str], h: int = HORIZON) -> DataFrame:
    """Per series: chosen model, its metrics, confidence, forecast array, band.

    Without folds Croston is taken and the band is zero. Where the chosen forecast is zero but there was demand, the best
    ranked of the models that may stand in is taken. Only the chosen model is run on the whole series.
    """
    order = F.struct(F.col("wape").isNull().alias("_none"), *_FIGURES)
    best = _scored(arrays, profile, by).groupBy(*by).agg(F.min(order).alias("_b"), F.min(F.when(F.col("modelo").isin(*STAND_IN), order)).alias("_p"))
    base = join_groups(join_groups(arrays, profile, by, "inner"), best, by)
    first = _run(F.coalesce("_b.modelo", F.lit("CROSTON_SBA")), tuple(models.POOL), h)
    base = base.withColumn("_f", first)
    dead = (models.total(F.col("a")) > 0) & (models.total(F.col("_f")) <= 0) & F.col("_b").isNotNull() & F.col("_p").isNotNull()
    base = base.withColumn("_dead", dead).withColumn("_c", F.when(F.col("_dead"), F.col("_p")).otherwise(F.col("_b")))
    f = F.when(F.col("_dead"), _run(F.col("_c.modelo"), STAND_IN, h)).otherwise(F.col("_f"))
    out = base.withColumns({c: F.col(f"_c.{c}") for c in _FIGURES} | {"f": f})
    out = out.withColumns({"modelo": F.coalesce("modelo", F.lit("CROSTON_SBA")), "janelas": F.coalesce("janelas", F.lit(0))})
    out = out.withColumn("confianca_previsao", confidence(F.col("meses"), F.col("meses_ativos"), F.col("zeros_pct"), F.col("janelas"), F.col("wape")))
    band = F.when(F.col("confianca_previsao") == "BAIXA", F.col("erro_q90")).otherwise(F.col("erro_q80"))
    return (
        out.withColumns({"faixa": F.coalesce(band, F.lit(0.0)), "motivo_confianca": confidence_reason(F.col("confianca_previsao"))})
        .withColumnRenamed("modelo", "modelo_selecionado")
        .drop("_b", "_p", "_c", "_f", "_dead")
    )


def scenarios(chosen: DataFrame, by: list[str], h: int = HORIZON) -> DataFrame:
    """One row per series and future month: base, lower and upper quantity."""
    pairs = F.arrays_zip(future_months(F.col("ultimo_mes"), h).alias("mes"), F.col("f").alias("f"))
    out = chosen.select(*by, "modelo_selecionado", "confianca_previsao", "tipo_demanda", "faixa", F.explode(pairs).alias("p"))
    return out.select(
        *by,
        F.col("p.mes").alias("mes"),
        "modelo_selecionado",
        "confianca_previsao",
        "tipo_demanda",
        F.col("p.f").alias("previsao_base"),
        F.greatest(F.col("p.f") - F.col("faixa"), F.lit(0.0)).alias("previsao_inferior"),
        (F.col("p.f") + F.col("faixa")).alias("previsao_superior"),
        F.col("faixa").alias("erro_referencia_mensal"),
    )


def scenario_summary(months: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the horizon, each scenario by itself, and the monthly mean."""
    return months.groupBy(*by).agg(
        *[F.sum(f"previsao_{s}").alias(f"total_{s}") for s in ("base", "inferior", "superior")],
        F.avg("previsao_base").alias("media_mensal"),
    )


def unit_scores(arrays: DataFrame, by: list[str]) -> DataFrame:
    """Composite score of each model of each modelling unit over yearly folds."""
    rows = errors(arrays, by, models.UNIT_POOL, yearly_folds(F.size("a")), 12)
    fold = rows.groupBy(*by, "modelo", "corte").agg(
        F.sum(F.abs(F.col("f") - F.col("y"))).alias("e"),
        F.sum("y").alias("y"),
        F.sum("f").alias("f"),
        F.count(F.lit(1)).alias("n"),
    )
    out = fold.groupBy(*by, "modelo").agg(
        F.count(F.lit(1)).alias("janelas"),
        F.try_divide(F.sum("e"), F.nullif(F.sum("y"), F.lit(0.0))).alias("wape"),
        F.avg(F.try_divide(F.abs(F.col("f") - F.col("y")), F.nullif(F.col("y"), F.lit(0.0)))).alias("vies_anual"),
        F.count_if((F.col("f") <= 0) & (F.col("y") > 0)).alias("previsoes_zero"),
        (F.sum("e") / F.sum("n")).alias("mae"),
        (F.sum("y") / F.sum("n")).alias("_level"),
    )
    relative = F.col("mae") / F.greatest(F.col("_level"), F.lit(1.0))
    score = F.coalesce("wape", relative) + 0.25 * F.coalesce("vies_anual", relative) + 0.5 * F.col("previsoes_zero")
    return out.withColumn("escore", score).drop("_level")


def choose_unit_model(scores: DataFrame, by: list[str], margin: float = 0.05) -> DataFrame:
    """The simplest model within five percent of the best score."""
    names = list(models.UNIT_POOL)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("modelo"))
    best = F.min("escore").over(W.partitionBy(*by))
    near = scores.withColumn("_best", best).where(F.col("escore") <= F.col("_best") * (1 + margin))
    first = F.row_number().over(W.partitionBy(*by).orderBy(place))
    return near.withColumn("_r", first).where("_r = 1").drop("_r", "_best")


def active_years() -> Column:
    """Different years with demand of a series ``a`` that ends in ``ultimo_mes``."""
    year = F.transform("a", lambda x, i: F.when(x > 0, F.year(F.add_months("ultimo_mes", (i - F.size("a") + 1).cast("int")))))
    return F.size(F.array_distinct(F.array_compact(year)))


def unit_summary(arrays: DataFrame, by: list[str]) -> DataFrame:
    """Per modelling unit: chosen model, its validation figures, and months with demand."""
    chosen = choose_unit_model(unit_scores(arrays, by), by)
    active = F.size(F.filter("a", lambda x: x > 0))
    return arrays.join(chosen, by, "left").select(
        *by,
        F.coalesce("modelo", F.lit("CROSTON_SBA")).alias("modelo_selecionado"),
        F.coalesce("janelas", F.lit(0)).alias("janelas_validacao"),
        F.col("wape").alias("wape_validacao"),
        F.col("mae").alias("mae_validacao"),
        F.col("vies_anual").alias("vies_anual_medio"),
        F.col("escore").alias("score_selecao"),
        F.size("a").alias("meses_historicos"),
        active.alias("meses_com_demanda"),
        active_years().alias("anos_ativos"),
        (F.size(F.filter("a", lambda x: x == 0)) / F.size("a")).alias("percentual_meses_sem_demanda"),
        models.total(F.col("a")).alias("quantidade_historica_total"),
    )


def unit_confidence(level: Column, active: Column, years: Column, folds: Column, wape: Column) -> Column:
    fair = (active >= 24) & (years >= 4) & (folds >= 3) & (wape <= 0.75)
    return F.when(F.upper(level) == "SEGMENTO", "BAIXA").when(F.coalesce(fair, F.lit(False)), "MEDIA").otherwise("BAIXA")


def uncertainty(wape: Column, active: Column, confidence_level: Column) -> Column:
    """Relative half width: the error or 0.75, more for short activity, within 0.25 and 1.25."""
    raw = F.coalesce(wape, F.lit(0.75)) + 0.35 * F.greatest(F.lit(0.0), 1 - active / 36)
    floor = F.when(confidence_level == "MEDIA", 0.35).otherwise(0.60)
    return F.least(F.greatest(raw, floor, F.lit(0.25)), F.lit(1.25))


def unit_forecast(arrays: DataFrame, by: list[str], h: int = HORIZON) -> DataFrame:
    """Per modelling unit and future month: chosen model, confidence, uncertainty, three scenarios."""
    chosen = choose_unit_model(unit_scores(arrays, by), by)
    base = arrays.join(chosen, by, "left").withColumn("modelo", F.coalesce("modelo", F.lit("CROSTON_SBA")))
    f = F.coalesce(*[F.when(F.col("modelo") == k, m(F.col("a"), h)) for k, m in models.UNIT_POOL.items()])
    f = F.transform(f, lambda x: F.greatest(x, F.lit(0.0)))
    # demand is not forecast as nothing
    f = F.when((models.total(F.col("a")) > 0) & (models.total(f) <= 0), models.UNIT_POOL["CROSTON_SBA"](F.col("a"), h)).otherwise(f)
    active = F.size(F.filter("a", lambda x: x > 0))
    level = unit_confidence(F.col("nivel_modelagem"), active, active_years(), F.coalesce("janelas", F.lit(0)), F.col("wape"))
    u = uncertainty(F.col("wape"), active, F.col("confianca_previsao"))
    base = base.withColumn("f", f).withColumn("confianca_previsao", level).withColumn("incerteza", u)
    pairs = F.arrays_zip(future_months(F.col("ultimo_mes"), h).alias("mes"), F.col("f").alias("f"))
    return base.select(*by, "modelo", "wape", "confianca_previsao", "incerteza", F.explode(pairs).alias("p")).select(
        *by,
        "modelo",
        "wape",
        "confianca_previsao",
        "incerteza",
        F.col("p.mes").alias("mes"),
        F.col("p.f").alias("previsao_base"),
        (F.col("p.f") * F.greatest(F.lit(0.0), 1 - F.col("incerteza"))).alias("previsao_inferior"),
        (F.col("p.f") * (1 + F.col("incerteza"))).alias("previsao_superior"),
    )
