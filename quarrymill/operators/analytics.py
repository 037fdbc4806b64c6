"""Aggregations over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.keys import concentration_class, supplier_key
from quarrymill.operators.measures import join_groups
from quarrymill.operators.ranks import distinct_counts, exact_quantiles, modes
from quarrymill.sources.scratch import cut


def _n() -> Column:
    return F.count(F.lit(1))


_sum = lambda c: F.coalesce(F.sum(c), F.lit(0.0))


#: Columns that ``executive_summary`` reads.
SUMMARY_COLUMNS = [
    "familia_material", "codigo_catmat", "unidade_comparavel", "cnpj_fornecedor", "fornecedor_nome", "uasg", "uf", "data_publicacao", "quantidade",
    "valor_total", "dq_possui_erro", "dq_duplicidade", "is_price_outlier",
]


def executive_summary(df: DataFrame) -> DataFrame:
    """One row of global figures; suppliers by tax number, else by name. ``df`` is read twice."""
    keys = {
        "familias": F.col("familia_material"), "catmats": F.col("codigo_catmat"), "unidades_comparaveis": F.col("unidade_comparavel"),
        "fornecedores": supplier_key("cnpj_fornecedor", "fornecedor_nome"), "uasgs": F.col("uasg"), "estados": F.col("uf"),
    }
    sums = df.agg(
        _n().alias("registros"),
        F.min("data_publicacao").alias("data_inicial"),
        F.max("data_publicacao").alias("data_final"),
        _sum("quantidade").alias("quantidade_total"),
        _sum("valor_total").alias("valor_total"),
        F.count_if("dq_possui_erro").alias("erros_qualidade"),
        F.count_if("dq_duplicidade").alias("duplicados_confirmados"),
        F.count_if("is_price_outlier").alias("outliers_preco"),
    )
    return join_groups(sums, distinct_counts(df, [], keys), [])


def _month(c: str = "data_publicacao") -> Column:
    return F.date_format(c, "yyyy-MM").alias("ano_mes")


def monthly_by_family(df: DataFrame) -> DataFrame:
    return df.groupBy(_month(), "familia_material").agg(
        _n().alias("registros"),
        F.count_distinct("codigo_catmat").alias("materiais"),
        _sum("quantidade").alias("quantidade_total"),
        _sum("valor_total").alias("valor_total"),
        F.count_distinct("cnpj_fornecedor").alias("fornecedores"),
    )


def monthly_by_material(df: DataFrame) -> DataFrame:
    """By month, family, material, description and unit; ``df`` is read three times."""
    by = ["ano_mes", "familia_material", "codigo_catmat", "descricao_item", "unidade_comparavel"]
    df = df.withColumn("ano_mes", _month())
    sums = df.groupBy(*by).agg(_n().alias("registros"), _sum("quantidade").alias("quantidade_total"), _sum("valor_total").alias("valor_total"))
    out = join_groups(sums, exact_quantiles(df, by, "valor_unitario", [0.5]).select(*by, F.col("q")[0].alias("preco_mediano")), by)
    return join_groups(out, distinct_counts(df, by, {"fornecedores": F.col("cnpj_fornecedor")}), by)


def priced_rows(df: DataFrame) -> DataFrame:
    """Error-free rows with a unit and a price that is no outlier."""
    return df.where(
        ~F.coalesce(F.col("dq_possui_erro"), F.lit(False)) & ~F.coalesce(F.col("is_price_outlier"), F.lit(False))
        & F.col("unidade_comparavel").isNotNull() & (F.col("valor_unitario") > 0)
    )


def price_statistics(df: DataFrame) -> DataFrame:
    """Prices of ``priced_rows`` by family, material, description and unit; ``df`` is read three times."""
    good = priced_rows(df)
    p, by = "valor_unitario", ["familia_material", "codigo_catmat", "descricao_item", "unidade_comparavel"]
    sums = good.groupBy(*by).agg(
        _n().alias("registros"),
        F.min(p).alias("preco_minimo"),
        F.avg(p).alias("preco_medio"),
        F.max(p).alias("preco_maximo"),
        F.stddev_samp(p).alias("desvio_padrao"),
        _sum("quantidade").alias("quantidade_total"),
        _sum("valor_total").alias("valor_total"),
    )
    q = exact_quantiles(good, by, p, [0.25, 0.5, 0.75])
    q = q.select(*by, *[F.col("q")[k].alias(name) for k, name in enumerate(("preco_p25", "preco_mediano", "preco_p75"))])
    return join_groups(sums, q, by).withColumns(
        {
            "preco_medio_ponderado": F.try_divide("valor_total", "quantidade_total"),
            "coeficiente_variacao": F.try_divide("desvio_padrao", "preco_medio"),
        }
    )


def supplier_concentration(df: DataFrame, by: tuple[str, ...] = ("ano", "familia_material")) -> DataFrame:
    """Suppliers, total, HHI, shares of the first and the first three, class, per group of error-free rows.

    Suppliers are those of their tax number, else of their name. Where the total is not above zero the HHI is null, the shares
    are zero and the class is the lowest. No group's suppliers meet in one task: sums add up, and ranks end at three. The sums of
    suppliers are written while the plan is built; ``df`` is read once.
    """
    by = list(by)
    valid = df.where(~F.coalesce(F.col("dq_possui_erro"), F.lit(False)))
    each = cut(valid.groupBy(*by, supplier_key("cnpj_fornecedor", "fornecedor_nome").alias("_key")).agg(_sum("valor_total").alias("v")), "suppliers")
    sums = each.groupBy(*by).agg(_n().alias("fornecedores"), F.sum("v").alias("valor_total"))
    shares = join_groups(each, sums.where("valor_total > 0").select(*by, F.col("valor_total").alias("_t")), by, "inner")
    shares = shares.select(*by, "_key", (F.col("v") / F.col("_t")).alias("s"))
    squares = shares.groupBy(*by).agg((F.sum(F.col("s") * F.col("s")) * 10000).alias("_h"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("s"), "_key"))
    top = shares.withColumn("r", rank).where("r <= 3").groupBy(*by).agg(
        F.max("s").alias("participacao_top1"), F.sum("s").alias("participacao_top3")
    )
    out = join_groups(join_groups(sums, squares, by), top, by)
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("participacao_top1", "participacao_top3")})
    return out.withColumn("hhi", F.round("_h", 2)).withColumn("classificacao_hhi", concentration_class("_h")).drop("_h")


def monthly_indicators(df: DataFrame) -> DataFrame:
    """By month, family, material and unit; ``df`` is read three times."""
    by = ["mes", "familia_material", "codigo_catmat", "unidade_comparavel"]
    df = df.withColumn("mes", F.trunc("data_publicacao", "month"))
    sums = df.groupBy(*by).agg(
        F.sum("quantidade").alias("quantidade_total"),
        F.sum("valor_total").alias("valor_total"),
        F.try_divide(F.sum("valor_total"), F.sum("quantidade")).alias("preco_ponderado"),
    )
    out = join_groups(sums, exact_quantiles(df, by, "valor_unitario", [0.5]).select(*by, F.col("q")[0].alias("preco_mediano")), by)
    return join_groups(out, distinct_counts(df, by, {"fornecedores": F.col("cnpj_fornecedor")}), by)


def _moved(df: DataFrame) -> DataFrame:
    """Rows with a quantity of zero or more."""
    return df.where(F.coalesce(F.col("quantidade") >= 0, F.lit(False)))


def largest_shares(df: DataFrame, by: str, of: dict[str, str]) -> DataFrame:
    """Per group the share of the largest purchase, supplier or the like in its valid quantity, from one pass; null without a total above zero.

    ``of`` has the name of each share and its column; rows without a value in the column are one party.
    """
    parties = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("string").alias("_k")) for i, c in enumerate(of.values())])
    each = _moved(df).select(by, "quantidade", F.inline(parties)).groupBy(by, "_i", "_k").agg(F.sum("quantidade").alias("v"))
    most = lambda i: F.max(F.when(F.col("_i") == i, F.col("v"))) / F.nullif(F.greatest(F.sum(F.when(F.col("_i") == i, F.col("v"))), F.lit(0.0)), F.lit(0.0))
    return each.groupBy(by).agg(*[most(i).alias(name) for i, name in enumerate(of)])


def _reach(df: DataFrame, by: list[str], keys: dict[str, Column]) -> DataFrame:
    """Rows, dates and different years, months and ``keys`` of each group; ``df`` is read twice."""
    sums = df.groupBy(*by).agg(
        _n().alias("registros_periodo"), F.min("data_publicacao").alias("data_inicial"), F.max("data_publicacao").alias("data_final")
    )
    date = {"anos_ativos": F.year("data_publicacao"), "meses_ativos": F.date_format("data_publicacao", "yyyy-MM")}
    return join_groups(sums, distinct_counts(df, by, date | keys), by)


#: Recommendations.
ALONE, BY_SEGMENT = "CATMAT individual", "Modelo hierárquico por segmento"


def material_diagnostic(df: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """Reach of each material's data, largest shares of its valid quantity, and whether it is modelled by itself.

    ``texts`` names columns to describe the material by; the least text is taken. ``df`` is read several times, so it should be cut.
    """
    by = ["codigo_catmat"]
    keys = {
        "compras_distintas": F.col("id_compra"), "fornecedores": F.col("cnpj_fornecedor"), "uasgs": F.col("uasg"),
        "unidades_fornecimento": F.col("sigla_unidade_fornecimento"),
    }
    out = _reach(df, by, keys)
    valid = _moved(df).groupBy(*by).agg(F.sum("quantidade").alias("quantidade_total"))
    out = join_groups(out, valid, by).withColumn("quantidade_total", F.coalesce("quantidade_total", F.lit(0.0)))
    shares = {"maior_compra_participacao": "id_compra", "maior_fornecedor_participacao": "cnpj_fornecedor"}
    out = join_groups(out, largest_shares(df, "codigo_catmat", shares), by)
    if texts:
        out = join_groups(out, df.groupBy(*by).agg(*[F.min(c).alias(name) for name, c in texts.items()]), by)
    alone = (F.col("registros_periodo") >= 24) & (F.col("anos_ativos") >= 3) & (F.col("meses_ativos") >= 12)
    return out.withColumn("candidato_modelo_individual", alone).withColumn("modelagem_recomendada", F.when(alone, ALONE).otherwise(BY_SEGMENT))


def segment_diagnostic(df: DataFrame, by: str = "familia_material") -> DataFrame:
    """Ten figures of each segment; ``df`` is read three times."""
    keys = {
        "catmats": F.col("codigo_catmat"), "compras_distintas": F.col("id_compra"), "fornecedores": F.col("cnpj_fornecedor"), "uasgs": F.col("uasg"),
    }
    return join_groups(_reach(df, [by], keys), df.groupBy(by).agg(_sum("quantidade").alias("quantidade_total")), [by])


#: Fixed value: what a material says that passes all tests.
FIT = "Apto para avaliação de previsão"


def selection_fit(df: DataFrame) -> DataFrame:
    """Whether each material has enough history, and the first test that it fails."""
    k = F.year("data_publicacao") * 12 + F.month("data_publicacao")
    out = df.where("data_publicacao is not null").groupBy("codigo_catmat").agg(
        _n().alias("registros"),
        F.count_distinct(F.year("data_publicacao")).alias("anos"),
        F.count_distinct(k).alias("meses_ativos"),
        (F.max(k) - F.min(k) + 1).cast("long").alias("meses_intervalo"),
    )
    out = out.withColumn("taxa_ativa", F.try_divide("meses_ativos", "meses_intervalo"))
    reason = (
        F.when(F.col("registros") < 30, "Poucos registros no período")
        .when(F.col("anos") < 3, "Cobertura inferior a três anos")
        .when(F.col("meses_ativos") < 12, "Poucos meses com aquisição")
        .when(F.col("taxa_ativa") < 0.25, "Série excessivamente esparsa")
        .otherwise(FIT)
    )
    return out.withColumn("motivo", reason).withColumn("apto", F.col("motivo") == FIT)


def coverage_by_family(df: DataFrame) -> DataFrame:
    """Per known family: different codes that were evaluated, rows with prices, records, rows with status ERRO."""
    return df.where("familia_material is not null").groupBy("familia_material").agg(
        F.count_distinct("codigo_catmat").alias("avaliados"),
        F.count_if(F.col("registros") > 0).alias("com_preco"),
        F.coalesce(F.sum("registros"), F.lit(0)).alias("registros"),
        F.count_if(F.col("status") == "ERRO").alias("erros"),
    )


def state_coverage(df: DataFrame, layer: str) -> DataFrame:
    return df.agg(
        F.lit(layer).alias("camada"),
        _n().alias("linhas"),
        F.count("uf").alias("preenchidas"),
        F.try_divide(100.0 * F.count("uf"), _n()).alias("percentual"),
        F.count_distinct("uf").alias("ufs"),
        F.count_distinct("uasg").alias("uasgs"),
    )


def state_conflicts(df: DataFrame) -> DataFrame:
    """Buying units with more than one state."""
    pairs = df.where("uf is not null").select("uasg", "uf").distinct()
    out = pairs.groupBy("uasg").agg(F.count(F.lit(1)).alias("ufs"), F.array_join(F.sort_array(F.collect_list("uf")), ", ").alias("lista_ufs"))
    return out.where("ufs > 1")


def mode_of(df: DataFrame, by: str | list[str], columns: list[str]) -> DataFrame:
    """Most frequent value of each column, the least one on a tie."""
    return modes(df, [by] if isinstance(by, str) else by, {c: F.col(c) for c in columns})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(_n().alias("registros")).orderBy(F.desc("registros"), F.asc_nulls_last(column))


def top_n(df: DataFrame, by: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; rows without a group are left out."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.where(F.col(by).isNotNull()).withColumn("posicao", rank).where(F.col("posicao") <= n)
