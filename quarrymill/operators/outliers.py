"""Price outliers by interquartile range, on one level or two, and the alerts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import severity
from quarrymill.functions.text import present
from quarrymill.operators.ranks import distinct_counts, exact_quantiles
from quarrymill.sources.scratch import cut, small

LEAST_GROUP, REACH = 8, 1.5
NO_UNIT = "UNIDADE_NAO_INFORMADA"


def group_limits(df: DataFrame, by: list[str], price: str, least: int = LEAST_GROUP) -> DataFrame:
    """q1, mediana, q3 and limits of groups with at least ``least`` priced rows; limits only where the range is positive.

    Quantiles are exact at any size of a group, see ``ranks.exact_quantiles``.
    """
    q = exact_quantiles(df, by, price, [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q")
    enough = F.col("n") >= least
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    reach = F.when(q3 > q1, REACH * (q3 - q1))
    return q.select(
        *by,
        "n",
        F.when(enough, q1).alias("q1"),
        F.when(enough, F.col("_q")[1]).alias("mediana"),
        F.when(enough, q3).alias("q3"),
        F.when(enough, F.greatest(F.lit(0.0), q1 - reach)).alias("limite_inferior"),
        F.when(enough, q3 + reach).alias("limite_superior"),
    ).withColumn("limite_inferior", F.when(F.col("limite_superior").isNotNull(), F.col("limite_inferior")))


def flag_outliers(df: DataFrame, by: tuple[str, ...] = ("codigo_catmat", "unidade_comparavel", "ano"), price: str = "valor_unitario") -> DataFrame:
    """Adds is_price_outlier and outlier_*: limits on all eligible rows of a group, severity on flagged rows.

    The limits come from (key, price) alone and are joined by broadcast if a count allows it, so that rows are not shuffled.
    """
    eligible = F.coalesce((F.col(price) > 0) & ~F.col("dq_duplicidade"), F.lit(False))
    for c in by:
        eligible = eligible & F.col(c).isNotNull()
    marked = df.withColumn("_ok", eligible)
    limits = small(cut(group_limits(marked.where("_ok"), list(by), price).where("limite_superior is not null"), "limits"))
    names = {c: f"outlier_{c}" for c in ("q1", "mediana", "q3", "limite_inferior", "limite_superior")}
    right = limits.drop("n").withColumnsRenamed(names).withColumnsRenamed({c: f"_{c}" for c in by})
    on = F.col("_ok")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    outside = ~F.col(price).between(F.col("outlier_limite_inferior"), F.col("outlier_limite_superior"))
    return (
        marked.join(right, on, "left")
        .withColumn("is_price_outlier", F.coalesce(outside, F.lit(False)))
        .withColumn("outlier_razao_mediana", F.try_divide(F.col(price), F.col("outlier_mediana")))
        .withColumn("outlier_gravidade", F.when(F.col("is_price_outlier"), severity(price, "outlier_mediana")))
        .drop("_ok", *[f"_{c}" for c in by])
    )


def flagged_only(base: DataFrame, price: str = "valor_unitario") -> DataFrame:
    """Outlier rows on the raw unit and the side they are on; ``base`` has no duplicates, see ``quality.unrepeated``."""
    out = flag_outliers(base.withColumn("dq_duplicidade", F.lit(False)), ("codigo_catmat", "nome_unidade_fornecimento", "ano"), price).where("is_price_outlier")
    side = F.when(F.col(price) > F.col("outlier_limite_superior"), "ACIMA").otherwise("ABAIXO")
    return out.withColumn("outlier_direcao", side)


def review(df: DataFrame, price: str = "valor_unitario") -> DataFrame:
    """Limits by history and by year, the reference chosen of them, reasons and severity."""
    unit = F.coalesce(present("unidade_comparavel"), F.lit(NO_UNIT))
    base = df.withColumn("_u", unit)
    good = base.where(F.col(price) > 0)
    out = base
    for name, by in (("hist", ["codigo_catmat", "_u"]), ("anual", ["codigo_catmat", "_u", "ano"])):
        limits = small(cut(group_limits(good, by, price), "limits"))
        limits = limits.withColumnsRenamed({c: f"{name}_{c}" for c in limits.columns if c not in by}).withColumnsRenamed({c: f"_{c}_r" for c in by})
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}_r"))
        out = out.join(limits, on, "left").drop(*[f"_{c}_r" for c in by])
    annual = F.col("anual_limite_superior").isNotNull() & (F.col("anual_n") >= LEAST_GROUP)
    for c in ("n", "q1", "mediana", "q3", "limite_inferior", "limite_superior"):
        out = out.withColumn(f"ref_{c}", F.when(annual, F.col(f"anual_{c}")).otherwise(F.col(f"hist_{c}")))
    out = out.withColumn("ref_nivel", F.when(annual, "ANUAL").when(F.col("hist_limite_superior").isNotNull(), "HISTORICO").otherwise("SEM_REFERENCIA"))
    return out.withColumn("motivo_alerta", alert_reasons(price)).withColumn(
        "gravidade", F.when(F.rlike("motivo_alerta", F.lit("_IQR")), severity(price, "ref_mediana")).otherwise("SEM_ALERTA")
    ).drop("_u")


def alert_reasons(price: str = "valor_unitario") -> Column:
    """Reasons joined by bars, or SEM_ALERTA."""
    p = F.col(price)
    tests = [
        (present("unidade_comparavel").isNull(), "SEM_UNIDADE"),
        (F.coalesce(F.col("quantidade") <= 0, F.lit(True)), "QUANTIDADE_INVALIDA"),
        (F.coalesce(p <= 0, F.lit(True)), "PRECO_INVALIDO"),
        (F.col("dq_duplicidade"), "DUPLICIDADE"),
        ((p > F.col("ref_limite_superior")), "ACIMA_IQR"),
        ((p > 0) & (p < F.col("ref_limite_inferior")), "ABAIXO_IQR"),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    return F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise("SEM_ALERTA")


def alert_detail(reviewed: DataFrame) -> DataFrame:
    """Rows with an alert about their price, or exact duplicates."""
    return reviewed.where(F.rlike("motivo_alerta", F.lit("_IQR")) | F.col("dq_duplicidade"))


def alert_summary(detail: DataFrame, price: str = "valor_unitario") -> DataFrame:
    """Alerts by family, code, description, unit, severity and reason; ``detail`` is read three times, so it should be cut."""
    from quarrymill.operators.measures import join_groups

    by = ["familia_material", "codigo_catmat", "descricao_item", "unidade_comparavel", "gravidade", "motivo_alerta"]
    sums = detail.groupBy(*by).agg(
        F.count(F.lit(1)).alias("alertas"),
        F.min("data_publicacao").alias("data_inicial"),
        F.max("data_publicacao").alias("data_final"),
        F.min(price).alias("preco_minimo"),
        F.max(price).alias("preco_maximo"),
    )
    out = join_groups(sums, exact_quantiles(detail, by, price, [0.5]).select(*by, F.col("q")[0].alias("preco_mediano")), by)
    return join_groups(out, distinct_counts(detail, by, {"fornecedores": F.col("cnpj_fornecedor"), "compras": F.col("id_compra")}), by)


def alert_counts(detail: DataFrame) -> DataFrame:
    return detail.groupBy("familia_material", "gravidade").agg(F.count(F.lit(1)).alias("alertas"))
