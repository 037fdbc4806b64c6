"""Queries on the choice of materials and product groups, and on enrichment and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import keys, text, units
from quarrymill.operators import classify, filters, joins, quality, typing
from quarrymill.plans.adapter import FLAGS, GAPS, PURCHASES, codes, purchases, table, with_gaps
from quarrymill.plans.purchases import KEY, flagged, names, query
from quarrymill.sources.scratch import cut

_UPPER = "trim(regexp_replace(upper(strip_accents({c})), '\\s+', ' ', 'g'))"


@query("closed_period", f"WITH {PURCHASES} SELECT {KEY} FROM purchases WHERE data_publicacao BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'")
def _(spark, sf_dir):
    return filters.in_closed_period(purchases(spark, sf_dir), "1997-01-01", "1998-12-31").select(*names(KEY))


@query("error_rows", f"WITH {FLAGS} SELECT {KEY}, diferenca_valor_pct FROM (SELECT * REPLACE (round(diferenca_valor_pct + 1e-7, 4) AS diferenca_valor_pct) FROM flags) WHERE dq_possui_erro")
def _(spark, sf_dir):
    return filters.error_rows(flagged(spark, sf_dir)).select(*names(KEY), "diferenca_valor_pct")


def _word(n, words):
    """Words by the remainder of a number."""
    out = F.when(n == 0, words[0])
    for i, w in enumerate(words[1:], 1):
        out = out.when(n == i, w)
    return out


@query("relevant_materials", "SELECT p_partkey AS codigo, p_name AS descricao FROM part WHERE p_size % 5 IN (0, 1, 3)")
def _(spark, sf_dir):
    told = _word(F.col("p_size") % 5, [" Sim", "TRUE", "nao", "1", "x"])
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("codigo"), F.col("p_name").alias("descricao"), told.alias("material_relevante"))
    return filters.relevant_materials(df).select("codigo", "descricao")


@query(
    "candidate_codes",
    "SELECT p_size AS codigo, CAST(max(p_partkey % 13) AS BIGINT) AS registros FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 13 > 0 AND p_partkey % 3 = 0 GROUP BY 1",
)
def _(spark, sf_dir):
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("codigo"), (k % 13).alias("registros"), F.when(k % 4 == 0, "ERRO").otherwise("OK").alias("status"),
        F.when(k % 3 == 0, "sim").otherwise("").alias("selecionado"),
    )
    return filters.candidates(df).select("codigo", "registros")


def _groups(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = k % 7 - 3, k % 5 - 2
    code = F.when(k % 11 == 0, "x").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        code.alias("codigo_pdm"), F.col("p_name").alias("nome_pdm"), a.alias("score_medicao"), b.alias("score_eletrico"),
        (a + b).alias("score_total"), (a + b > 3).alias("elegivel"), F.when(k % 6 == 0, "yes").otherwise("no").alias("selecionado"),
    )


_GROUPS = """g AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS codigo_pdm, p_name AS nome_pdm, p_partkey % 7 - 3 AS a, p_partkey % 5 - 2 AS b,
  p_partkey % 7 - 3 + p_partkey % 5 - 2 AS score_total, p_partkey % 6 = 0 AS chosen FROM part)"""


@query(
    "group_candidates",
    f"""WITH {_GROUPS}, r AS (SELECT *, score_total > 3 AS elegivel, row_number() OVER (PARTITION BY codigo_pdm ORDER BY score_total > 3 DESC, score_total DESC, nome_pdm) AS k
    FROM g WHERE codigo_pdm IS NOT NULL AND (a > 0 OR b > 0)) SELECT codigo_pdm, elegivel, score_total, nome_pdm FROM r WHERE k = 1""",
)
def _(spark, sf_dir):
    return filters.group_candidates(_groups(spark, sf_dir)).select("codigo_pdm", "elegivel", "score_total", "nome_pdm")


def _selected(rows: str) -> str:
    return f"""WITH {_GROUPS}, t AS (SELECT * FROM g WHERE codigo_pdm IS NOT NULL AND {rows}),
    r AS (SELECT *, row_number() OVER (PARTITION BY codigo_pdm ORDER BY score_total DESC, nome_pdm) AS k FROM t WHERE CASE WHEN (SELECT bool_or(chosen) FROM t) THEN chosen ELSE score_total > 3 END)
    SELECT CAST(codigo_pdm AS VARCHAR) AS codigo_pdm, score_total, nome_pdm FROM r WHERE k = 1"""


@query("groups_selected", _selected("true"))
def _(spark, sf_dir):
    return filters.selected_or_eligible(_groups(spark, sf_dir).where("codigo_pdm <> 'x'")).select("codigo_pdm", "score_total", "nome_pdm")


@query("groups_eligible", _selected("NOT chosen"))
def _(spark, sf_dir):
    rows = _groups(spark, sf_dir).where("codigo_pdm <> 'x' and selecionado = 'no'")
    return filters.selected_or_eligible(rows).select("codigo_pdm", "score_total", "nome_pdm")


@query("candidate_catalogue", "SELECT CAST(p_size AS BIGINT) AS codigo, min(p_name) AS descricao FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 2 = 0 GROUP BY 1")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.when(k % 11 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("codigo")
    df = table(spark, sf_dir, "part").select(code, F.col("p_name").alias("descricao"), (k % 2 == 0).alias("selecionado"))
    return filters.candidate_catalogue(df, only_selected=True).select("codigo", "descricao")


@query(
    "family_per_group",
    """WITH r AS (SELECT p_size AS codigo_pdm, p_brand AS familia_codigo, p_partkey % 9 AS score_selecao, p_name AS nome_pdm,
    row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_partkey % 9 DESC, p_name) AS k FROM part) SELECT * EXCLUDE (k) FROM r WHERE k = 1""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("codigo_pdm"), F.col("p_brand").alias("familia_codigo"), (F.col("p_partkey") % 9).alias("score_selecao"), F.col("p_name").alias("nome_pdm")
    )
    return classify.best_family_per_group(df)


_A, _B, _X = {"RING": 20, "WIDGET": 15}, {"BRUSHED": 18, "STEEL": 12, "TIN": 5}, {"PROMO": -25}


def _score_sql(terms: dict[str, int]) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{k}') THEN {w} ELSE 0 END" for k, w in terms.items())


@query(
    "group_eligibility",
    f"""WITH d AS (SELECT p_partkey, {_UPPER.format(c="p_name || ' / ' || p_type")} AS t FROM part),
    s AS (SELECT p_partkey, {_score_sql(_A)} AS score_medicao, {_score_sql(_B)} AS score_eletrico, {_score_sql(_X)} AS score_exclusao FROM d)
    SELECT *, score_medicao + score_eletrico + score_exclusao AS score_total,
    score_medicao > 0 AND score_eletrico > 0 AND score_medicao + score_eletrico + score_exclusao >= 30 AS elegivel FROM s""",
)
def _(spark, sf_dir):
    out = classify.group_eligibility(table(spark, sf_dir, "part"), ["p_name", "p_type"], _A, _B, _X)
    return out.select("p_partkey", "score_medicao", "score_eletrico", "score_exclusao", "score_total", "elegivel")


_T = _UPPER.format(c="p_name")


def _words_sql(w: str) -> str:
    return f"regexp_matches(t, '(^|\\W){w}($|\\W)')"


@query(
    "item_classes",
    f"""WITH d AS (SELECT p_partkey, p_size, {_T} AS t FROM part)
    SELECT p_partkey, CASE WHEN contains(t, 'BOLT') OR contains(t, 'NUT') THEN 'FIXACAO' WHEN {_words_sql('RED')} AND {_words_sql('RING')} THEN 'AMBAS'
      WHEN {_words_sql('RING')} THEN 'REATIVA' ELSE 'ATIVA' END AS categoria,
    CASE WHEN contains(t, 'BROKEN') OR NOT (contains(t, 'RING') OR contains(t, 'WIDGET') OR contains(t, 'BOLT')) OR NOT (contains(t, 'SMALL') OR contains(t, 'RED') OR contains(t, 'BLUE')) THEN 'DESCARTAR'
      WHEN {_words_sql('RING')} AND NOT {_words_sql('RED')} OR contains(t, 'BLUE') THEN 'ESPECIALIZADO' WHEN p_size * 2 >= 65 THEN 'ADERENTE' ELSE 'REVISAR' END AS situacao FROM d""",
)
def _(spark, sf_dir):
    t = text.upper_text("p_name")
    category = classify.item_category(t, [("FIXACAO", ["BOLT", "NUT"])], "RED", "RING", ("AMBAS", "REATIVA", "ATIVA"))
    status = classify.item_status(t, F.col("p_size") * 2, ["BROKEN"], ["RING", "WIDGET", "BOLT"], ["SMALL", "RED", "BLUE"], ["BLUE"], "RED", "RING")
    return table(spark, sf_dir, "part").select("p_partkey", category.alias("categoria"), status.alias("situacao"))


@query(
    "best_items",
    """WITH d AS (SELECT p_size AS codigo, p_name AS descricao, p_brand AS categoria_tecnica, p_partkey % 10 AS score_relevancia_tecnica, p_partkey % 4 AS s FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY codigo ORDER BY CASE s WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 99 END, score_relevancia_tecnica DESC, categoria_tecnica, descricao) AS k FROM d)
    SELECT codigo, descricao, categoria_tecnica, score_relevancia_tecnica, ['ADERENTE', 'REVISAR', 'ESPECIALIZADO'][s] AS status_classificacao FROM r WHERE k = 1 AND s > 0""",
)
def _(spark, sf_dir):
    k = F.col("p_partkey")
    status = _word(k % 4, ["DESCARTAR", "ADERENTE", "REVISAR", "ESPECIALIZADO"])
    df = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("codigo"), F.col("p_name").alias("descricao"), F.col("p_brand").alias("categoria_tecnica"),
        (k % 10).alias("score_relevancia_tecnica"), status.alias("status_classificacao"),
    )
    return classify.best_items(df)


@query(
    "rank_candidates",
    """WITH l AS (SELECT l_partkey, arg_max(CAST(l_quantity AS BIGINT), l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1),
    c AS (SELECT p_partkey AS codigo, contains(p_type, 'PROMO') AS promo, p_size AS tech, coalesce(n, 0) AS total_registros_api, p_partkey % 4 = 0 AS penal FROM part LEFT JOIN l ON l_partkey = p_partkey),
    s AS (SELECT *, round(CASE WHEN total_registros_api > 0 THEN round(10 * log10(total_registros_api + 1), 2) ELSE 0 END + 1e-7, 4) AS score_volume, promo AND (tech < 35 OR penal) AS rev FROM c)
    SELECT codigo, total_registros_api, score_volume, round(tech + score_volume + 1e-7, 4) AS score_preliminar, rev AS revisao_manual_obrigatoria,
    CASE WHEN total_registros_api = 0 THEN 'Sem registros de preço' WHEN tech < 20 THEN 'Baixa aderência técnica'
      WHEN rev THEN 'Revisão técnica obrigatória' ELSE 'Candidato para auditoria temporal' END AS criterio_selecao FROM s""",
)
def _(spark, sf_dir):
    family = F.when(F.contains("p_type", F.lit("PROMO")), "PROMO").otherwise(F.col("p_type"))
    catalogue = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("codigo"), family.alias("familia_material"), F.col("p_size").alias("score_relevancia_tecnica"),
        F.when(F.col("p_partkey") % 4 == 0, "X").alias("termos_penalizados"),
    )
    coverage = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(
        F.col("l_partkey").alias("codigo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordem"), F.col("l_quantity").cast("long").alias("total_registros_api")
    )
    out = classify.rank_candidates(catalogue, coverage, "PROMO")
    return out.select("codigo", "total_registros_api", "score_volume", "score_preliminar", "revisao_manual_obrigatoria", "criterio_selecao")


@query(
    "extraction_report",
    f"""WITH {GAPS}, p AS (SELECT *, CASE WHEN numero_item <> 2 THEN id_compra_item END AS pid, CASE WHEN numero_item <> 3 THEN id_compra_item END AS item FROM gaps WHERE codigo_catmat <> 11),
    m AS (SELECT *, count(*) OVER (PARTITION BY codigo_catmat, pid) > 1 AS r, item IS NOT NULL AND count(*) OVER (PARTITION BY codigo_catmat, item) > 1 AS h,
      data_publicacao >= TIMESTAMP '1994-01-01' AND data_publicacao < TIMESTAMP '1997-01-01' AS i FROM p)
    SELECT codigo_catmat, coalesce(count(DISTINCT numero_item), 0) AS paginas, count(numero_item) AS registros_api, count(*) FILTER (WHERE i) AS registros_periodo,
    count(*) FILTER (WHERE NOT i) AS fora_periodo, count(*) FILTER (WHERE numero_item IS NOT NULL AND data_publicacao IS NULL) AS sem_data, count(*) FILTER (WHERE r) AS observacoes_duplicadas,
    count(*) FILTER (WHERE h) AS linhas_com_item_historico, count(DISTINCT item) FILTER (WHERE h) AS itens_unicos_com_historico
    FROM (SELECT DISTINCT codigo_catmat FROM gaps) LEFT JOIN m USING (codigo_catmat) GROUP BY 1""",
)
def _(spark, sf_dir):
    n, item = F.col("numero_item"), F.col("id_compra_item")
    df = with_gaps(purchases(spark, sf_dir)).withColumns({"purchase_id": F.when(n != 2, item), "id_compra_item": F.when(n != 3, item), "pagina": n})
    df = cut(df)
    return quality.extraction_report(df.where("codigo_catmat <> 11"), df, "1994-01-01", "1996-12-31")


@query("catalogue_families", "SELECT l_orderkey, l_linenumber, l_partkey AS codigo_catmat, p_type AS familia_material FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 5 <> 0")
def _(spark, sf_dir):
    fact = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("codigo_catmat"), F.lit("?").alias("familia_material"))
    catalogue = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("codigo"), F.col("p_type").alias("familia_material"))
    return joins.with_catalogue(fact, catalogue)


@query(
    "unit_enrichment",
    """SELECT p_partkey, upper(p_brand) || CASE WHEN p_size % 3 = 2 THEN '|CAP=2.5' ELSE '' END AS unidade_comparavel FROM part WHERE p_partkey % 4 <> 0 UNION ALL
    SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 0""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    bronze = part.where("p_partkey % 4 <> 0").select(
        "p_partkey", F.lit(None).cast("string").alias("sigla_unidade_fornecimento"), F.lower("p_brand").alias("nome_unidade_fornecimento"),
        _word(F.col("p_size") % 3, [F.lit(0.0), F.lit(1.0), F.lit(2.5)]).alias("capacidade"),
    )
    return joins.enrich_units(part.select("p_partkey"), bronze, "p_partkey").select("p_partkey", "unidade_comparavel")


@query("units_missing", f"WITH {PURCHASES} SELECT {KEY} FROM purchases WHERE unidade_comparavel IS NULL")
def _(spark, sf_dir):
    return joins.unmatched(purchases(spark, sf_dir)).select(*names(KEY))


@query(
    "code_descriptions",
    f"""WITH {PURCHASES}, n AS (SELECT codigo_catmat, descricao_item, row_number() OVER (PARTITION BY codigo_catmat ORDER BY count(*) DESC, descricao_item) AS r FROM purchases GROUP BY 1, 2)
    SELECT c AS codigo_catmat, descricao_item FROM (SELECT DISTINCT p_size AS c FROM part) LEFT JOIN n ON c = codigo_catmat AND r = 1""",
)
def _(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.col("p_size").alias("codigo_catmat")).distinct()
    return joins.describe_codes(codes, purchases(spark, sf_dir)).select("codigo_catmat", "descricao_item")


@query(
    "published_compare",
    """WITH a AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority > '2' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS prioridade, a.n AS linhas_preparado, b.n AS linhas_publicado, a.n IS NOT DISTINCT FROM b.n AS igual FROM a FULL JOIN b ON a.k = b.k""",
)
def _(spark, sf_dir):
    count = lambda t: t.groupBy(F.col("o_orderpriority").alias("prioridade")).agg(F.count(F.lit(1)).alias("linhas"))
    orders = table(spark, sf_dir, "orders")
    return joins.compare_tables(count(orders.where("o_orderkey % 2 = 0")), count(orders.where("o_orderkey % 3 = 0 and o_orderpriority > '2'")), "prioridade")


@query(
    "small_functions",
    f"""SELECT p_partkey, {_T} AS maiusculo, regexp_matches(lower(p_name), '(^|\\W)ring($|\\W)') AS palavra, p_size % 5 IN (0, 1) AS verdade,
    round(CASE WHEN p_size > 0 THEN round(10 * log10(p_size + 1), 2) ELSE 0 END + 1e-7, 4) AS cobertura, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_name ELSE 'NAO_IDENTIFICADO' END AS fornecedor,
    'MED-' || substr(sha1(p_partkey || '|' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, '')), 1, 20) AS piloto,
    upper(p_brand) || CASE WHEN p_size = 1 THEN '' ELSE '|CAP=' || p_size END AS unidade, round(p_size + 0.25 + 1e-7, 4) AS decimal_virgula FROM part""",
)
def _(spark, sf_dir):
    size = F.col("p_size")
    brand, name = F.when(size % 2 == 0, F.col("p_brand")), F.when(size % 3 == 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.upper_text("p_name").alias("maiusculo"),
        text.has_word(F.lower("p_name"), "ring").alias("palavra"),
        text.parse_bool(_word(size % 5, ["Yes", " 1 ", "no", "", "2"])).alias("verdade"),
        keys.coverage_score("p_size").alias("cobertura"),
        keys.supplier_key(brand, name).alias("fornecedor"),
        keys.pilot_id("p_partkey", brand).alias("piloto"),
        units.comparable_unit_upper("p_size", F.lit(" "), F.lower("p_brand")).alias("unidade"),
        text.parse_decimal_comma(F.concat(F.lit("R$ "), size.cast("string"), F.lit(",25"))).alias("decimal_virgula"),
    )


_PILOT_ORDER = """codigo_catmat, id_compra, id_item_compra, id_compra_item, data_referencia, capacidade_unidade_fornecimento, cnpj_fornecedor, descricao_material,
  fornecedor_nome, nome_unidade_fornecimento, preco_unitario, quantidade, sigla_unidade_fornecimento, uasg, uf_uasg, valor_total_calculado"""


@query(
    "pilot_history",
    f"""WITH {GAPS}, p AS (SELECT codigo_catmat, nullif(id_compra, '') AS id_compra, CAST(NULL AS VARCHAR) AS id_item_compra, id_compra_item, data_publicacao AS data_referencia,
      capacidade AS capacidade_unidade_fornecimento, nullif(trim(cnpj_fornecedor), '') AS cnpj_fornecedor, descricao_item AS descricao_material, fornecedor_nome,
      nullif(nome_unidade_fornecimento, '') AS nome_unidade_fornecimento, valor_unitario AS preco_unitario, quantidade, sigla_unidade_fornecimento, CAST(uasg AS VARCHAR) AS uasg, uf AS uf_uasg,
      coalesce(CASE WHEN numero_item <> 4 THEN valor_total END, quantidade * valor_unitario) AS valor_total_calculado FROM gaps),
    n AS (SELECT *, row_number() OVER (ORDER BY {', '.join(f"{c.strip()} NULLS FIRST" for c in _PILOT_ORDER.split(','))}) AS place FROM p),
    u AS (SELECT *, upper(coalesce(sigla_unidade_fornecimento, nome_unidade_fornecimento)) || CASE WHEN capacidade_unidade_fornecimento = 100 THEN '|CAP=100' ELSE '' END AS unit FROM n)
    SELECT 'MED-' || substr(sha1(codigo_catmat || '|' || coalesce(id_compra, '') || '||' || id_compra_item || '|' || coalesce(strftime(data_referencia, '%Y-%m-%d %H:%M:%S'), '') || '|' || place), 1, 20) AS purchase_id,
    data_referencia AS data_publicacao, codigo_catmat, 'MEDIDORES' AS familia_material, round(valor_total_calculado + 1e-7, 4) AS valor_total, cnpj_fornecedor, unit AS unidade_comparavel, uf_uasg,
    'PRATICADO' AS tipo_preco, false AS dq_duplicidade, data_referencia IS NULL OR quantidade IS NULL OR unit IS NULL AS dq_possui_erro, 'SEM_ALERTA' AS outlier_gravidade
    FROM u WHERE codigo_catmat % 3 = 0""",
)
def _(spark, sf_dir):
    df = with_gaps(purchases(spark, sf_dir))
    names_ = {"data_publicacao": "data_referencia", "valor_unitario": "preco_unitario", "cnpj_fornecedor": "ni_fornecedor", "uasg": "codigo_uasg", "uf": "estado", "capacidade": "capacidade_unidade_fornecimento"}
    total = F.when(F.col("numero_item") != 4, F.col("valor_total"))
    kept = ["id_compra", "id_compra_item", "codigo_catmat", "descricao_item", "quantidade", "sigla_unidade_fornecimento", "nome_unidade_fornecimento", "fornecedor_nome"]
    pilot = df.select(*kept, total.alias("valor_total_calculado"), *[F.col(a).alias(b) for a, b in names_.items()])
    wanted = codes(spark, sf_dir).where("codigo_catmat % 3 = 0")
    schema = "purchase_id string, data_publicacao timestamp, codigo_catmat long, familia_material string, valor_total double, cnpj_fornecedor string, unidade_comparavel string, uf_uasg string, tipo_preco string, dq_duplicidade boolean, dq_possui_erro boolean, outlier_gravidade string"
    return typing.pilot_gold(pilot, wanted, spark.createDataFrame([], schema).schema, "MEDIDORES")
