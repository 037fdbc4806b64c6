"""The star schema: facts, dimensions and their integration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import date_keys, key_or
from quarrymill.functions.text import clean_text, in_parts, labelled
from quarrymill.operators.filters import one_per, without_family
from quarrymill.operators.hierarchy import to_scenarios
from quarrymill.operators.measures import join_groups
from quarrymill.operators.ranks import modes
from quarrymill.operators.series import calendar
from quarrymill.operators.typing import align, resolve_aliases

#: Source columns that may stand for a column of the fact or of a dimension.
ALIASES = {
    "id_compra": ["id_compra"], "id_item_compra": ["id_item_compra"], "id_compra_item": ["id_compra_item"],
    "numero_item": ["numero_item", "numero_item_compra"], "tipo_preco": ["tipo_preco", "tipo_valor"],
    "uf": ["uf_uasg", "estado", "uf", "sigla_uf"], "municipio": ["municipio", "nome_municipio"], "poder": ["poder"], "esfera": ["esfera"],
    "forma_compra": ["forma_compra", "forma_de_compra", "forma"], "modalidade": ["modalidade"],
    "criterio_julgamento": ["criterio_julgamento", "criterio_de_julgamento"], "fonte": ["fonte", "fonte_item"],
}
BUYER_ALIASES = {c: ALIASES[c] for c in ("uf", "municipio", "poder", "esfera")} | {"orgao": ["orgao", "nome_orgao"]}
MATERIAL_ALIASES = {
    "descricao_item": ["descricao_material", "descricao_item", "descricao_catmat", "descricao"], "codigo_pdm": ["codigo_pdm"], "codigo_classe": ["codigo_classe"],
}
UNIT_ALIASES = {"capacidade": ["capacidade_unidade_fornecimento", "capacidade"]} | {
    c: [c] for c in ("sigla_unidade_fornecimento", "nome_unidade_fornecimento")
}
#: Columns of the summary of forecasts and their types.
SUMMARY = {
    "codigo_catmat": "long", "modelo_selecionado": "string", "confianca_previsao": "string", "tipo_demanda": "string",
    "previsao_12m_cenario_inferior": "double", "previsao_12m_base": "double", "previsao_12m_cenario_superior": "double",
    "quantidade_historica_total": "double", "media_mensal_prevista_base": "double", "wape_validacao_percentual": "double",
    "mae_validacao": "double", "meses_com_demanda": "long", "percentual_meses_sem_demanda": "double", "janelas_validacao": "long",
    "proximos_passos": "string",
}


def fact_purchases(df: DataFrame) -> DataFrame:
    """Rows with id, date and code, with keys of all dimensions; texts that are missing are null."""
    df = resolve_aliases(df, ALIASES)
    d = date_keys("data_publicacao")
    unit = key_or("unidade_comparavel", "UNIDADE_NAO_INFORMADA")
    good = df.where("purchase_id is not null and data_publicacao is not null and codigo_catmat is not null")
    return good.select(
        clean_text("purchase_id").alias("purchase_id"),
        *[clean_text(c).alias(c) for c in ("id_compra", "id_item_compra", "id_compra_item")],
        F.col("numero_item").try_cast("long").alias("numero_item"),
        d["data"].alias("data"),
        d["data_key"].alias("data_key"),
        d["mes_key"].alias("mes_key"),
        in_parts("codigo_catmat").alias("codigo_catmat"),
        key_or("cnpj_fornecedor", "FORNECEDOR_NAO_INFORMADO").alias("fornecedor_key"),
        key_or("uasg", "UASG_NAO_INFORMADA").alias("uasg_key"),
        F.concat(F.col("codigo_catmat").cast("string"), F.lit("|"), unit).alias("unidade_key"),
        "quantidade",
        "valor_unitario",
        "valor_total",
        *[clean_text(c).alias(c) for c in ("tipo_preco", "uf", "municipio", "poder", "esfera", "forma_compra", "modalidade", "criterio_julgamento", "fonte")],
        F.coalesce("hist_item_repetido", F.lit(False)).alias("historico_item"),
        F.coalesce("dq_possui_erro", F.lit(False)).alias("possui_erro"),
        F.coalesce("dq_duplicidade", F.lit(False)).alias("duplicado"),
        F.coalesce("is_price_outlier", F.lit(False)).alias("alerta_preco"),
        clean_text("outlier_gravidade").alias("gravidade"),
    )


def dim_material(history: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """One row per code of history or forecast, with the most frequent family, description, group and class."""
    cols = ["codigo_catmat", "familia_material", *MATERIAL_ALIASES]
    rows = resolve_aliases(history, MATERIAL_ALIASES).select(*cols)
    if forecast is not None:
        none = dict.fromkeys(("codigo_pdm", "codigo_classe"), F.lit(None).cast("string"))
        rows = rows.unionByName(resolve_aliases(forecast, MATERIAL_ALIASES).withColumns(none).select(*cols))
    rows = rows.where("codigo_catmat is not null")
    out = modes(rows, ["codigo_catmat"], {c: clean_text(c) for c in cols[1:]})
    return out.withColumn("material_rotulo", labelled("codigo_catmat", "descricao_item", "Descrição não informada"))


def dim_supplier(df: DataFrame) -> DataFrame:
    keyed = df.withColumn("fornecedor_key", key_or("cnpj_fornecedor", "FORNECEDOR_NAO_INFORMADO"))
    out = modes(keyed, ["fornecedor_key"], {"fornecedor_nome": clean_text("fornecedor_nome")})
    return out.withColumn("fornecedor_nome", F.coalesce("fornecedor_nome", F.lit("FORNECEDOR NAO INFORMADO")))


def dim_buyer(df: DataFrame, attributes: tuple[str, ...] = ("orgao", "uf", "municipio", "poder", "esfera")) -> DataFrame:
    df = resolve_aliases(df, BUYER_ALIASES)
    return modes(df.withColumn("uasg_key", key_or("uasg", "UASG_NAO_INFORMADA")), ["uasg_key"], {c: clean_text(c) for c in attributes})


def dim_unit(df: DataFrame) -> DataFrame:
    """Units of materials, by the keys of the fact; attributes are the most frequent or the least ones, rows without a code are left out."""
    rows = resolve_aliases(df, UNIT_ALIASES).where("codigo_catmat is not null")
    unit = key_or("unidade_comparavel", "UNIDADE_NAO_INFORMADA")
    key = F.concat(F.col("codigo_catmat").cast("string"), F.lit("|"), unit).alias("unidade_key")
    rows = rows.select(key, "codigo_catmat", unit.alias("unidade_comparavel"), "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade")
    texts = ("sigla_unidade_fornecimento", "nome_unidade_fornecimento")
    # code and unit are of the key itself
    least = rows.groupBy("unidade_key").agg(*[F.min(c).alias(c) for c in ("codigo_catmat", "unidade_comparavel", "capacidade")])
    return join_groups(least, modes(rows, ["unidade_key"], {c: clean_text(c) for c in texts}), ["unidade_key"])


def fact_forecast(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Scenario rows with month keys; null months and codes are left out."""
    good = wide.where("mes is not null and codigo_catmat is not null")
    return to_scenarios(good, ids).withColumn("mes_key", F.date_format("mes", "yyyyMM").cast("int"))


def forecast_summary(df: DataFrame) -> DataFrame:
    """The columns of ``SUMMARY``, typed; one row per code, the one with the largest base total."""
    df = resolve_aliases(df, {c: [c] for c in SUMMARY})
    cols = [(clean_text(c) if t == "string" else F.col(c).try_cast(t)).alias(c) for c, t in SUMMARY.items()]
    return one_per(df.select(*cols).where("codigo_catmat is not null"), ["codigo_catmat"], F.desc_nulls_last("previsao_12m_base"), F.asc("modelo_selecionado"))


def family_label(df: DataFrame, codes: DataFrame, default: str) -> str:
    """The most frequent family text of some codes."""
    row = modes(df.join(codes, "codigo_catmat", "left_semi"), [], {"f": clean_text("familia_material")}).first()
    return row["f"] if row and row["f"] else default


def integrate(gold: DataFrame, pilot: DataFrame, old_codes: DataFrame, word: str = "MEDIDOR") -> DataFrame:
    """History with the old codes of a family taken out and the pilot's rows, in the history's schema, put in."""
    return without_family(gold, word, old_codes).unionByName(align(pilot, gold.schema))


def integrate_codes(current: DataFrame, new: DataFrame, old_codes: DataFrame) -> DataFrame:
    """Forecast or summary with the rows of old codes taken out and the new rows, in its schema, put in."""
    kept = current.join(old_codes.select("codigo_catmat").distinct(), "codigo_catmat", "left_anti").select(*current.columns)
    return kept.unionByName(align(new, current.schema))


def dim_calendar(purchases: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    return calendar(purchases.select("data"), *([forecast.select("mes")] if forecast is not None else []))
