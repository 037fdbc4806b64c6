"""Alignment of schemas and typed layers of purchase records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from quarrymill.functions import keys, units
from quarrymill.functions.text import clean_text, in_parts, parse_bool, parse_decimal, parse_decimal_comma
from quarrymill.operators.filters import one_per
from quarrymill.operators.ranks import row_position
from quarrymill.sources.scratch import cut, small

#: Columns of a price row and the fields of the raw record that they are read from.
RECORD_FIELDS = {
    "id_compra": ["idCompra"], "id_item_compra": ["idItemCompra"], "id_compra_item": ["idCompraItem"], "numero_item": ["numeroItemCompra"],
    "data_compra": ["dataCompra"], "data_resultado": ["dataResultado"], "codigo_catmat": ["codigoItemCatalogo", "codigo_item_catalogo"],
    "descricao_item": ["descricaoItem"], "descricao_detalhada": ["descricaoDetalhadaItem"], "quantidade": ["quantidade"],
    "sigla_unidade_fornecimento": ["siglaUnidadeFornecimento"], "nome_unidade_fornecimento": ["nomeUnidadeFornecimento"],
    "capacidade_unidade_fornecimento": ["capacidadeUnidadeFornecimento"], "sigla_unidade_medida": ["siglaUnidadeMedida"],
    "nome_unidade_medida": ["nomeUnidadeMedida"], "valor_unitario": ["precoUnitario", "valorUnitario"], "cnpj_fornecedor": ["niFornecedor"],
    "nome_fornecedor": ["nomeFornecedor"], "marca": ["marca"], "uasg": ["codigoUasg"], "nome_uasg": ["nomeUasg"], "codigo_orgao": ["codigoOrgao"],
    "nome_orgao": ["nomeOrgao"], "codigo_municipio": ["codigoMunicipio"], "municipio": ["municipio"], "uf_uasg": ["estado"], "poder": ["poder"],
    "esfera": ["esfera"], "forma": ["forma"], "modalidade": ["modalidade"], "criterio_julgamento": ["criterioJulgamento"],
    "percentual_maior_desconto": ["percentualMaiorDesconto"], "codigo_classe": ["codigoClasse"], "nome_classe": ["nomeClasse"],
    "codigo_pdm": ["codigoPdm"], "nome_pdm": ["nomePdm"], "objeto": ["objetoCompra"], "data_atualizacao_fato": ["dataAtualizacaoFato"],
}
#: Fixed value: the columns of a price row, in order.
SILVER = [
    "purchase_id", "id_compra", "id_item_compra", "id_compra_item", "numero_item", "data_publicacao", "data_compra", "data_resultado", "codigo_catmat",
    "descricao_item", "descricao_detalhada", "familia_codigo", "familia_material", "quantidade", "unidade_original", "unidade_padronizada",
    "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade_unidade_fornecimento", "sigla_unidade_medida", "nome_unidade_medida",
    "unidade_comparavel", "valor_unitario", "valor_total", "tipo_valor", "cnpj_fornecedor", "nome_fornecedor", "marca", "uasg", "nome_uasg",
    "codigo_orgao", "nome_orgao", "codigo_municipio", "municipio", "uf_uasg", "poder", "esfera", "forma", "modalidade", "criterio_julgamento",
    "percentual_maior_desconto", "codigo_classe", "nome_classe", "codigo_pdm", "nome_pdm", "objeto", "data_atualizacao_fato", "fonte_item",
]
#: Fields of a catalogue record.
CATALOGUE_FIELDS = {
    "codigo": ["codigo", "codigoItem", "codigo_item", "codigo_item_material"], "descricao": ["descricao", "descricaoItem", "descricao_item", "nome"],
    "status": ["status", "statusItem", "situacaoItem"], "sustentavel": ["sustentavel", "indicadorSustentavel"],
    "id_classe": ["id_classe", "classe", "codigoClasse"], "id_grupo": ["id_grupo", "grupo", "codigoGrupo"], "id_pdm": ["id_pdm", "pdm", "codigoPdm", "codigoPDM"],
}


def either(df: DataFrame, names: list[str]) -> Column:
    """First non-null of those columns that exist, else null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each canonical column from the first candidate column that exists, null if none does."""
    first = {c: next((n for n in names if n in df.columns), None) for c, names in aliases.items()}
    return df.withColumns({c: F.col(n) if n else F.lit(None).cast("string") for c, n in first.items()})


def typed(df: DataFrame, numbers: list[str] = [], dates: list[str] = [], longs: list[str] = []) -> DataFrame:  # noqa: B006
    """Casts that give null where they fail."""
    return df.withColumns(
        {c: F.col(c).try_cast("double") for c in numbers} | {c: F.col(c).try_cast("timestamp") for c in dates} | {c: F.col(c).try_cast("long") for c in longs}
    )


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; missing flags are false, other missing columns null."""
    def one(f) -> Column:
        if isinstance(f.dataType, BooleanType):
            return parse_bool(f.name) if f.name in df.columns else F.lit(False)
        return F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)

    return df.select(*[one(f).alias(f.name) for f in schema.fields])


def catalogue_table(records: DataFrame) -> DataFrame:
    """Catalogue records with numeric codes and trimmed descriptions, one row for each code and description: the first by its other fields."""
    rows = records.select(*[either(records, names).cast("string").alias(c) for c, names in CATALOGUE_FIELDS.items()])
    rows = rows.withColumns({"codigo": F.col("codigo").try_cast("long"), "descricao": F.trim(F.coalesce("descricao", F.lit("")))})
    rest = [c for c in CATALOGUE_FIELDS if c not in ("codigo", "descricao")]
    return one_per(rows, ["codigo", "descricao"], *[F.asc_nulls_last(c) for c in rest]).select(*CATALOGUE_FIELDS)


def silver(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Raw price records to the 48 columns of a price row; family and missing description come from the catalogue.

    Of a code that the catalogue has twice the first row by description is taken. A blank result date or unit gives way to the
    purchase date or the unit's name. Ids are made of the raw fields; nulls count. The catalogue is written while the plan is
    built and joined by broadcast if a count allows it, so that records are not shuffled; they meet it before they get their
    columns.
    """
    known = ["familia_codigo", "familia_material"]
    names = catalogue.select(F.col("codigo").alias("_c"), F.col("descricao").alias("_d"), *[F.col(c) if c in catalogue.columns else F.lit(None).cast("string").alias(c) for c in known])
    first = one_per(names.where("_c is not null"), ["_c"], F.asc_nulls_last("_d"), *[F.asc_nulls_last(c) for c in known])
    first = small(cut(first.withColumnsRenamed({c: f"_{c}" for c in known}), "catalogue"))
    raw = {c: either(records, names).cast("string") for c, names in RECORD_FIELDS.items()}
    fields = dict.fromkeys(c for names in RECORD_FIELDS.values() for c in names if c in records.columns)
    records = records.select(*fields, raw["codigo_catmat"].try_cast("long").alias("_code"))
    records = records.join(first, F.col("_code") == F.col("_c"), "left")
    amounts = ["quantidade", "valor_unitario", "capacidade_unidade_fornecimento", "percentual_maior_desconto"]
    dates = ["data_compra", "data_resultado", "data_atualizacao_fato"]
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    about = ["_d", *[F.col(f"_{c}").alias(c) for c in known]]
    out = records.select(*[c.alias(k) for k, c in raw.items()], raw["capacidade_unidade_fornecimento"].alias("_capacity"), *about)
    out = out.withColumns({c: parse_decimal(c) for c in amounts} | {"codigo_catmat": F.col("codigo_catmat").try_cast("long"), "_date": F.coalesce(filled("data_resultado"), F.col("data_compra"))})
    original = F.coalesce(filled("sigla_unidade_fornecimento"), F.col("nome_unidade_fornecimento"))
    ids = ["id_compra_item", "id_item_compra", "id_compra", "numero_item", "codigo_catmat", "_date", "cnpj_fornecedor", "uasg", "quantidade", "valor_unitario",
           "sigla_unidade_fornecimento", "_capacity"]
    out = out.withColumns(
        {
            "purchase_id": keys.observation_id(*ids, F.lit("PRECO_PRATICADO")),
            "data_publicacao": F.col("_date").try_cast("timestamp"),
            "unidade_original": original,
            "valor_total": F.col("quantidade") * F.col("valor_unitario"),
            "tipo_valor": F.lit("PRATICADO"),
            "fonte_item": F.lit("API_PRECO_PRATICADO"),
        }
    ).withColumns({c: F.col(c).try_cast("timestamp") for c in dates})
    out = out.withColumns(
        {
            "unidade_padronizada": units.standard_unit("unidade_original"),
            "unidade_comparavel": units.comparable_unit("unidade_original", F.lit(None).cast("string"), "capacidade_unidade_fornecimento"),
        }
    )
    return out.withColumn("descricao_item", F.coalesce(filled("descricao_item"), F.col("_d"))).select(*SILVER)


def tender_items(tenders: DataFrame, items: DataFrame, key: str = "id_compra") -> DataFrame:
    """Legacy tender and item rows; a missing unit price or total follows from the other."""
    out = items.join(tenders, key, "left").withColumns(
        {c: parse_decimal(c) for c in ("quantidade", "valor_unitario", "valor_total")}
    )
    price = F.coalesce("valor_unitario", F.try_divide("valor_total", "quantidade"))
    total = F.coalesce("valor_total", F.col("quantidade") * F.col("valor_unitario"))
    unit = units.comparable_unit("sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade")
    return out.withColumns({"valor_unitario": price, "valor_total": total, "unidade_comparavel": unit})


#: Columns of the pilot's silver rows and the raw fields that they are read from; what the candidates' table adds.
PILOT_FIELDS = {
    "codigo_catmat": ["codigoItemCatalogo", "codigo_item_catalogo", "codigo_catmat"], "data_resultado": ["dataResultado", "data_resultado"],
    "data_compra": ["dataCompra", "data_compra"], "id_compra": ["idCompra", "id_compra"], "id_item_compra": ["idItemCompra", "id_item_compra"],
    "descricao_item": ["descricaoItem", "descricao_item"], "quantidade": ["quantidade", "quantidadeItem"], "preco_unitario": ["precoUnitario", "preco_unitario"],
    "ni_fornecedor": ["niFornecedor", "ni_fornecedor"], "nome_fornecedor": ["nomeFornecedor", "nome_fornecedor"], "codigo_uasg": ["codigoUasg", "codigo_uasg"],
    "nome_uasg": ["nomeUasg", "nome_uasg"], "sigla_unidade_fornecimento": ["siglaUnidadeFornecimento", "sigla_unidade_fornecimento"],
    "nome_unidade_fornecimento": ["nomeUnidadeFornecimento", "nome_unidade_fornecimento"],
    "capacidade_unidade_fornecimento": ["capacidadeUnidadeFornecimento", "capacidade_unidade_fornecimento"],
}
PILOT_METADATA = [
    "descricao_catalogo", "familia_codigo", "familia_material", "categoria_tecnica", "segmento_analitico", "prioridade", "total_registros_api",
]
PILOT_ORDER = [
    "codigo_catmat", "descricao_catalogo", "categoria_tecnica", "segmento_analitico", "prioridade", "data_referencia", "ano", "mes_referencia", "id_compra",
    "id_item_compra", "descricao_item", "quantidade", "preco_unitario", "valor_total_calculado", "ni_fornecedor", "nome_fornecedor", "codigo_uasg", "nome_uasg",
    "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade_unidade_fornecimento",
]


def pilot_silver(records: DataFrame, candidates: DataFrame, start: str, end: str) -> DataFrame:
    """Pilot records of a closed period with what the candidates' table says of their codes, total, year and month; other columns stay.

    Each code must be once in ``candidates``.
    """
    used = {n for names in PILOT_FIELDS.values() for n in names}
    rest = [c for c in records.columns if c not in used]
    out = records.select(*[either(records, names).alias(c) for c, names in PILOT_FIELDS.items()], *rest)
    out = typed(out, ["quantidade", "preco_unitario"], ["data_resultado", "data_compra"], ["codigo_catmat"])
    out = out.withColumn("data_referencia", F.coalesce("data_resultado", "data_compra"))
    out = out.where(F.col("data_referencia").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    about = candidates.withColumnsRenamed({"codigo": "codigo_catmat", "descricao": "descricao_catalogo"})
    about = about.select("codigo_catmat", *[c for c in PILOT_METADATA if c in about.columns])
    out = out.join(about, "codigo_catmat", "left").withColumns(
        {
            "valor_total_calculado": F.col("quantidade") * F.col("preco_unitario"),
            "ano": F.year("data_referencia"),
            "mes_referencia": F.date_format("data_referencia", "yyyy-MM"),
        }
    )
    first = [c for c in PILOT_ORDER if c in out.columns]
    return out.select(*first, *[c for c in out.columns if c not in first])


#: Source columns of the pilot's rows.
PILOT = {
    "codigo_catmat": ["codigo_catmat", "codigo_item_catalogo"], "data_referencia": ["data_referencia", "data_resultado", "data_compra"],
    "quantidade": ["quantidade", "quantidade_item"], "preco_unitario": ["preco_unitario", "valor_unitario"],
    "valor_total_calculado": ["valor_total_calculado", "valor_total"],
    "sigla_unidade_fornecimento": ["sigla_unidade_fornecimento", "unidade_fornecimento"], "nome_unidade_fornecimento": ["nome_unidade_fornecimento"],
    "capacidade_unidade_fornecimento": ["capacidade_unidade_fornecimento"],
    "id_compra": ["id_compra"], "id_item_compra": ["id_item_compra"], "id_compra_item": ["id_compra_item"],
    "descricao_material": ["descricao_catalogo", "descricao_item", "descricao"], "cnpj_fornecedor": ["ni_fornecedor", "cnpj_fornecedor", "fornecedor_id"],
    "fornecedor_nome": ["nome_fornecedor", "fornecedor_nome", "fornecedor"], "uasg": ["codigo_uasg", "uasg"], "orgao": ["nome_uasg", "orgao", "nome_orgao"],
    "uf_uasg": ["uf_uasg", "estado", "uf", "sigla_uf"], "municipio": ["municipio", "nome_municipio"],
}
#: Fields of a pilot row's id, before its position.
PILOT_ID = ("codigo_catmat", "id_compra", "id_item_compra", "id_compra_item", "data_referencia")


def pilot_gold(pilot: DataFrame, codes: DataFrame, schema: StructType, family: str) -> DataFrame:
    """Pilot rows of some codes in the schema of the gold fact.

    A row's id holds its position, from 1, among all rows of the pilot in the order of the id's fields and then of all other
    columns, so that the same rows have the same ids in any layout of files; rows equal in every column have one id each.
    Only rows of ``codes`` are sorted: as the code comes first, of the others only their number before each code counts.
    """
    source = resolve_aliases(pilot, PILOT)
    texts = [c for c in PILOT if c not in ("codigo_catmat", "data_referencia") and not c.startswith(("quantidade", "preco", "valor", "capacidade"))]
    source = typed(source, ["quantidade", "preco_unitario", "valor_total_calculado", "capacidade_unidade_fornecimento"], ["data_referencia"], ["codigo_catmat"])
    source = source.withColumns({c: clean_text(c) for c in texts})
    total = F.coalesce("valor_total_calculado", F.col("quantidade") * F.col("preco_unitario"))
    source = source.withColumn("valor_total_calculado", total)
    rest = sorted(c for c in source.columns if c not in PILOT_ID)
    wanted = codes.select("codigo_catmat").distinct().withColumn("_wanted", F.lit(True))
    marked = source.join(F.broadcast(wanted), "codigo_catmat", "left")
    # one derivation: rows of other codes are written as their code alone
    code = in_parts("codigo_catmat").alias("codigo_catmat")
    rows = cut(marked.select(code, "_wanted", *[F.when(F.col("_wanted"), F.col(c)).alias(c) for c in source.columns if c != "codigo_catmat"]), "rows")
    others = F.count_if(F.col("_wanted").isNull())
    by_code = rows.groupBy("codigo_catmat").agg(F.max("_wanted").alias("_wanted"), others.alias("_n"))  # a row for each code
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("codigo_catmat")).rowsBetween(W.unboundedPreceding, 0))
    starts = by_code.withColumn("_others", before).where("_wanted").select(F.col("codigo_catmat").alias("_c"), "_others")
    ids = {c: f"_id_{c}" for c in PILOT_ID}
    later = StructType([f for f in schema.fields if f.name != "purchase_id"])
    shape = lambda r: _pilot_columns(r, later, family, ids)
    placed = row_position(rows.where("_wanted").select(*source.columns), [*PILOT_ID, *rest], "_place", shape, is_cut=True)
    placed = placed.join(F.broadcast(starts), F.col(ids["codigo_catmat"]) == F.col("_c"))
    key = keys.pilot_id(*ids.values(), F.col("_place") + F.col("_others") + 1)
    return align(placed.withColumn("purchase_id", key), schema)


def _pilot_columns(source: DataFrame, schema: StructType, family: str, ids: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` from the pilot's typed rows, and under the names in ``ids`` what their ids are made of."""
    out = source.withColumns(
        {
            "data_publicacao": F.col("data_referencia"),
            "familia_material": F.lit(family),
            "valor_unitario": F.col("preco_unitario"),
            "valor_total": F.col("valor_total_calculado"),
            "unidade_comparavel": units.comparable_unit_upper(
                "capacidade_unidade_fornecimento", "sigla_unidade_fornecimento", "nome_unidade_fornecimento"
            ),
            "tipo_preco": F.lit("PRATICADO"),
            "fonte": F.lit("Compras.gov.br"),
            "unidade_fornecimento_informada": F.col("sigla_unidade_fornecimento").isNotNull() | F.col("nome_unidade_fornecimento").isNotNull(),
            "hist_item_repetido": F.lit(False),
            "dq_duplicidade": F.lit(False),
            "is_price_outlier": F.lit(False),
            "outlier_gravidade": F.lit("SEM_ALERTA"),
        }
    )
    missing = [F.col(c).isNull() for c in ("data_publicacao", "codigo_catmat", "quantidade", "valor_unitario", "unidade_comparavel")]
    out = out.withColumns({"dq_possui_erro": reduce(lambda a, b: a | b, missing)} | {n: F.col(c) for c, n in ids.items()})
    return align(out, StructType([*schema.fields, *[out.schema[n] for n in ids.values()]]))


#: Columns of the table for exploration and where they may come from.
EXPLORATION = {
    "data": ["data_publicacao", "data_resultado", "data_compra", "data"],
    "codigo_catmat": ["codigo_catmat", "codigo_item_catalogo", "codigo_item", "codigo"],
    "descricao": ["descricao_material", "descricao_item", "descricao"], "familia": ["familia_material", "familia", "familia_codigo"],
    "quantidade": ["quantidade", "quantidade_item", "qtd"], "preco_unitario": ["preco_unitario_praticado", "valor_unitario", "preco_unitario", "preco"],
    "valor_total": ["valor_total", "valor_total_item", "valor_item"],
    "unidade": ["sigla_unidade_fornecimento", "nome_unidade_fornecimento", "sigla_unidade_medida", "nome_unidade_medida", "unidade_fornecimento", "unidade_medida", "unidade"],
    "fornecedor_nome": ["fornecedor_nome", "nome_fornecedor", "fornecedor"],
    "fornecedor_id": ["fornecedor_id", "cnpj_fornecedor", "ni_fornecedor", "cpf_cnpj_fornecedor"], "uasg": ["uasg", "codigo_uasg"], "estado": ["estado", "uf", "sigla_uf"],
    "purchase_id": ["purchase_id"], "id_item_compra": ["id_item_compra"], "id_compra_item": ["id_compra_item"], "id_compra": ["id_compra"],
    "numero_item": ["numero_item", "numero_item_compra"],
}
EXPLORATION_NEEDS = ("data", "codigo_catmat", "familia", "quantidade", "preco_unitario")


def exploration_table(df: DataFrame) -> DataFrame:
    """The 17 columns of the exploration from those of any version of the fact; a missing total is quantity times price. Without what it needs, an error."""
    missing = [c for c in EXPLORATION_NEEDS if not set(EXPLORATION[c]) & set(df.columns)]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    numbers = {c: parse_decimal_comma(c) for c in ("quantidade", "preco_unitario", "valor_total")}
    texts = {c: F.trim(F.col(c).cast("string")) for c in EXPLORATION if c not in (*numbers, "data", "codigo_catmat")}
    out = typed(resolve_aliases(df, EXPLORATION).select(*EXPLORATION), [], ["data"], ["codigo_catmat"]).withColumns(numbers | texts)
    total = F.coalesce("valor_total", F.col("quantidade") * F.col("preco_unitario"))
    informed = F.coalesce(F.col("unidade") != "", F.lit(False))
    return out.withColumns({"valor_total": total, "ano": F.year("data"), "unidade_informada": informed})


#: Columns of catalogue items, in order, and the raw fields of those that are read.
ITEM_FIELDS = {
    "descricao": ["descricaoItem", "descricao"], "codigo_grupo": ["codigoGrupo", "codigo_grupo"], "nome_grupo": ["nomeGrupo", "nome_grupo"],
    "codigo_classe": ["codigoClasse", "codigo_classe"], "nome_classe": ["nomeClasse", "nome_classe"], "codigo_pdm": ["codigoPdm", "codigo_pdm"],
    "nome_pdm": ["nomePdm", "nome_pdm"], "status_item": ["statusItem", "status_item"], "item_sustentavel": ["itemSustentavel", "item_sustentavel"], "codigo_ncm": ["codigo_ncm"],
}


def catalogue_items(items: DataFrame) -> DataFrame:
    """Items of chosen product groups in 18 columns, with numeric codes; of a code the first by family, group, description."""
    family = F.col("familia_codigo")
    out = items.select(
        either(items, ["codigoItem", "codigo"]).try_cast("long").alias("codigo"),
        either(items, ITEM_FIELDS["descricao"]).alias("descricao"),
        family,
        F.initcap(F.replace(family, F.lit("_"), F.lit(" "))).alias("familia_material"),
        *[either(items, names).alias(c) for c, names in ITEM_FIELDS.items() if c != "descricao"],
        F.lit(1).alias("classificacao_score"),
        F.lit("Selecionado por PDM revisado").alias("classificacao_motivo"),
        F.lit(True).alias("material_relevante"),
        F.lit(False).alias("selecionado"),
        F.lit("").alias("observacao_revisao"),
    ).where("codigo is not null")
    order = ["familia_codigo", "nome_pdm", "descricao", "codigo"]
    rest = [c for c in out.columns if c not in order]
    return one_per(out, ["codigo"], *[F.asc_nulls_last(c) for c in [*order, *rest]])


REVIEW_NEEDS = ("data", "familia", "codigo_catmat", "descricao", "unidade", "quantidade", "preco_unitario", "valor_total")
REVIEW_TEXTS = ("familia", "descricao", "unidade", "fornecedor_nome", "fornecedor_id", "uasg", "estado", "id_compra")


def review_input(df: DataFrame) -> DataFrame:
    """Input of the outlier review: numbers and dates typed, eight texts trimmed or added, the unit of analysis. Without what it needs, an error."""
    missing = [c for c in REVIEW_NEEDS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    texts = {c: F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string") for c in REVIEW_TEXTS}
    out = typed(df, ["quantidade", "preco_unitario", "valor_total"], ["data"], ["codigo_catmat"]).withColumns(texts)
    unit = F.coalesce(F.nullif(F.col("unidade"), F.lit("")), F.lit("UNIDADE_NAO_INFORMADA"))
    return out.withColumns({"ano": F.year("data"), "unidade_analise": unit})
