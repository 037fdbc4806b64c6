"""Queries on standardisation, classification, star schema, audit and landed records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions import keys, text
from quarrymill.operators import audit, classify, joins, quality, standardize, star
from quarrymill.operators.filters import without_family
from quarrymill.operators.ranks import row_position
from quarrymill.plans.adapter import GAPS, GOLD, PURCHASES, gold, purchases, table, with_gaps
from quarrymill.plans.purchases import query
from quarrymill.sources import bronze
from quarrymill.sources.scratch import cut
from quarrymill.streaming.incremental import upsert

_NORM = "trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "text_standardize",
    f"SELECT s_suppkey, {_NORM.format(c='s_name')} AS s_name_normalizado, trim(regexp_replace(upper(strip_accents(s_name)), '\\s+', ' ', 'g')) AS s_name_maiusculo, "
    "trim(s_name) AS s_name_limpo FROM supplier",
)
def _(spark, sf_dir):
    out = standardize.standardize_text(table(spark, sf_dir, "supplier"), "s_name")
    return out.select("s_suppkey", "s_name_normalizado", "s_name_maiusculo", "s_name_limpo")


@query(
    "text_report",
    """WITH c AS (SELECT lang, text, trim(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS t FROM documents)
    SELECT lang, count(*) AS linhas, count(*) FILTER (WHERE nullif(t, '') IS DISTINCT FROM text) AS alteradas, count(*) FILTER (WHERE t = '') AS vazias FROM c GROUP BY 1""",
)
def _(spark, sf_dir):
    return standardize.text_report(table(spark, sf_dir, "documents"), "text", "lang")


_AMOUNT = "'R$ ' || replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '#'), '.', ','), '#', '.')"


@query("amount_typing", f"SELECT l_orderkey, l_linenumber, {_AMOUNT} AS bruto, round(l_extendedprice, 2) AS valor FROM lineitem")
def _(spark, sf_dir):
    raw = F.concat(F.lit("R$ "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")).alias("bruto")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw).withColumn("valor", F.col("bruto"))
    return standardize.type_amounts(df, ["valor"])


@query(
    "amount_rejects",
    "SELECT 'o_orderpriority' AS coluna, count(*) AS preenchidos, count(*) AS rejeitados, min(o_orderpriority) AS exemplo FROM orders "
    "UNION ALL SELECT 'o_totalprice', count(*), 0, NULL FROM orders",
)
def _(spark, sf_dir):
    return standardize.amount_rejects(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_totalprice"])


@query(
    "unit_harmonize",
    f"WITH {PURCHASES} SELECT codigo_catmat, count(*) AS linhas, count(unidade_comparavel) AS com_unidade, count(DISTINCT unidade_comparavel) AS unidades FROM purchases GROUP BY 1",
)
def _(spark, sf_dir):
    return standardize.unit_coverage(purchases(spark, sf_dir), "codigo_catmat")


@query(
    "identity_keys",
    f"""WITH {PURCHASES} SELECT id_compra_item, data_publicacao, substr(sha256(concat_ws('|', id_compra, id_compra_item, CAST(codigo_catmat AS VARCHAR),
    coalesce(unidade_comparavel, 'None'), cnpj_fornecedor)), 1, 24) AS purchase_id, id_compra_item AS chave_item, cnpj_fornecedor AS chave_fornecedor FROM purchases""",
)
def _(spark, sf_dir):
    fields = ["id_compra", "id_compra_item", "codigo_catmat", "unidade_comparavel", "cnpj_fornecedor"]
    out = standardize.add_keys(purchases(spark, sf_dir), fields, ["id_compra_item", "id_compra"], ("cnpj_fornecedor", "fornecedor_nome"))
    return out.select("id_compra_item", "data_publicacao", "purchase_id", "chave_item", "chave_fornecedor")


@query(
    "date_keys",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS data, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS data_key,
    CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS mes_key, CAST(year(o_orderdate) AS INTEGER) AS ano, strftime(o_orderdate, '%Y-%m') AS ano_mes,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS inicio_mes FROM orders""",
    dates=("data", "inicio_mes"),
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns(keys.date_keys("o_orderdate")).select("o_orderkey", *keys.date_keys("o_orderdate"))


#: Rules over the invented prose of the documents, with the shape of the category rules.
FAMILIES = {
    "alpha": {"label": "Alpha", "priority": 10, "include": [("thing", 3), ("thre", 2), ("ble of", 2)], "exclude": ["worthless", "idiot"]},
    "beta": {"label": "Beta", "priority": 20, "include": [("tion the", 4), ("ment", 2), ("heit", 3)], "exclude": ["token"]},
    "gamma": {"label": "Gamma", "priority": 5, "include": [("cion", 3), ("keit", 2), ("queue", 1)], "exclude": []},
}


def _family_sql() -> str:
    n = _NORM.format(c="coalesce(text, '')")
    rules, drops = [], []
    for o, (k, f) in enumerate(FAMILIES.items()):
        rules += [f"({o}, '{k}', '{f['label']}', {f['priority']}, {i}, '{t}', {w})" for i, (t, w) in enumerate(f["include"])]
        drops += [f"('{k}', '{t}')" for t in f["exclude"]]
    return f"""WITH d AS (SELECT doc_id, {n} AS t FROM documents),
    r(ordem, familia, rotulo, prioridade, posicao, termo, peso) AS (VALUES {', '.join(rules)}), x(familia, termo) AS (VALUES {', '.join(drops)}),
    h AS (SELECT doc_id, ordem, familia, rotulo, prioridade, sum(peso) AS score, count(*) AS n,
      string_agg(termo || ' (+' || peso || ')', '; ' ORDER BY posicao) AS motivo FROM d JOIN r ON contains(t, termo) GROUP BY 1, 2, 3, 4, 5),
    g AS (SELECT h.* FROM h WHERE score >= 2 AND NOT EXISTS (SELECT 1 FROM x JOIN d ON contains(d.t, x.termo) WHERE x.familia = h.familia AND d.doc_id = h.doc_id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prioridade, n DESC, ordem) AS k FROM g)
    SELECT d.doc_id, b.familia AS familia_codigo, b.rotulo AS familia_material, CAST(coalesce(b.score, 0) AS BIGINT) AS classificacao_score,
    coalesce(b.motivo, CASE WHEN t = '' THEN '{classify.NO_TEXT}' ELSE '{classify.NO_MATCH}' END) AS classificacao_motivo
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1"""


@query("classify_docs", _family_sql())
def _(spark, sf_dir):
    out = classify.classify(table(spark, sf_dir, "documents"), "text", FAMILIES)
    return out.select("doc_id", "familia_codigo", "familia_material", "classificacao_score", "classificacao_motivo")


@query(
    "keyword_tier",
    """WITH w(i, w) AS (VALUES (0, 'SMALL RING'), (1, 'RED'), (2, 'WIDGET'), (3, 'RING')),
    s AS (SELECT p_partkey, w, i, CASE WHEN upper(p_name) = w THEN 100 WHEN starts_with(upper(p_name), w) THEN 80 WHEN contains(upper(p_name), w) THEN 60 ELSE 0 END AS score FROM part, w),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, i) AS k FROM s)
    SELECT p_partkey, CASE WHEN score > 0 THEN w END AS palavra, CASE WHEN score > 0 THEN score END AS score FROM r WHERE k = 1""",
)
def _(spark, sf_dir):
    best = classify.keyword_tier(text.upper_text("p_name"), ["SMALL RING", "RED", "WIDGET", "RING"])
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.palavra", "b.score")


TERMS = {"RING": 25, "SMALL": 10, "WIDGET": 18, "RED": -12}


@query(
    "term_scores",
    "SELECT p_partkey, CAST(" + " + ".join(f"CASE WHEN contains(upper(p_name), '{t}') THEN {w} ELSE 0 END" for t, w in TERMS.items())
    + " + CASE WHEN contains(upper(p_name), 'SMALL') THEN 0 ELSE -100 END AS INTEGER) AS escore, concat_ws(', ', "
    + ", ".join(f"CASE WHEN contains(upper(p_name), '{t}') THEN '{t}' END" for t in TERMS) + ") AS termos FROM part",
)
def _(spark, sf_dir):
    t = text.upper_text("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", classify.anchored_score(t, TERMS, {}, "SMALL").alias("escore"), classify.term_score(t, TERMS)[1].alias("termos")
    )


def with_attributes(df):
    """Purchases with attributes of buyers, materials and purchases, by rules on their numbers."""
    u, n = F.col("uasg"), F.col("numero_item")
    return df.withColumns(
        {
            "purchase_id": keys.first_present("id_compra_item"),
            "tipo_valor": F.lit("PRATICADO"),
            "id_item_compra": F.concat_ws("/", "id_compra", n.cast("string")),
            "nome_orgao": F.concat(F.lit("ORGAO "), (u % 7).cast("string")),
            "nome_municipio": F.concat_ws(" - ", "uf", (u % 3).cast("string")),
            "poder": F.when(u % 3 == 0, "EXECUTIVO").when(u % 3 == 1, " LEGISLATIVO "),
            "esfera": F.when(u % 2 == 0, "FEDERAL").otherwise("MUNICIPAL"),
            "forma": F.when(n % 3 == 0, "SISRP").when(n % 3 == 1, "nan").otherwise("SISPP"),
            "modalidade": F.when(n % 2 == 0, "DISPENSA").otherwise("PREGAO"),
            "criterio_de_julgamento": F.lit("MENOR PRECO"),
            "codigo_pdm": F.col("capacidade").cast("int").cast("string"),
            "codigo_classe": F.when(F.col("codigo_catmat") % 4 > 0, (F.col("codigo_catmat") % 4).cast("string")),
        }
    )


_SEV = "CASE WHEN NOT is_price_outlier THEN NULL WHEN ratio >= 5 OR ratio <= 0.20 THEN 'CRITICO' WHEN ratio >= 3 OR ratio <= 0.33 THEN 'ALTO' ELSE 'MODERADO' END"
#: Attributes of buyers in SQL.
_BUYER = {
    "orgao": "'ORGAO ' || (uasg % 7)", "municipio": "uf || ' - ' || (uasg % 3)",
    "poder": "CASE uasg % 3 WHEN 0 THEN 'EXECUTIVO' WHEN 1 THEN 'LEGISLATIVO' END", "esfera": "CASE WHEN uasg % 2 = 0 THEN 'FEDERAL' ELSE 'MUNICIPAL' END",
}
_UNIT_KEY = "codigo_catmat || '|' || coalesce(unidade_comparavel, 'UNIDADE_NAO_INFORMADA')"


#: Columns that the fact and the attributes read.
_FACT = ["id_compra", "id_compra_item", "numero_item", "data_publicacao", "quantidade", "valor_total", "capacidade", "cnpj_fornecedor", "uasg", "uf"]


@query(
    "fact_purchases",
    f"""WITH {GOLD} SELECT id_compra_item AS purchase_id, id_compra, id_compra || '/' || numero_item AS id_item_compra, id_compra_item, CAST(numero_item AS BIGINT) AS numero_item,
    CAST(data_publicacao AS DATE) AS data, CAST(strftime(data_publicacao, '%Y%m%d') AS INTEGER) AS data_key,
    CAST(strftime(data_publicacao, '%Y%m') AS INTEGER) AS mes_key, codigo_catmat, cnpj_fornecedor AS fornecedor_key, CAST(uasg AS VARCHAR) AS uasg_key,
    {_UNIT_KEY} AS unidade_key, quantidade,
    round(valor_unitario + 1e-7, 4) AS valor_unitario, round(valor_total + 1e-7, 4) AS valor_total, 'PRATICADO' AS tipo_preco, uf,
    {_BUYER['municipio']} AS municipio, {_BUYER['poder']} AS poder, {_BUYER['esfera']} AS esfera,
    CASE numero_item % 3 WHEN 0 THEN 'SISRP' WHEN 2 THEN 'SISPP' END AS forma_compra, CASE WHEN numero_item % 2 = 0 THEN 'DISPENSA' ELSE 'PREGAO' END AS modalidade,
    'MENOR PRECO' AS criterio_julgamento, CAST(NULL AS VARCHAR) AS fonte, hist_item_repetido AS historico_item,
    dq_possui_erro AS possui_erro, dq_duplicidade AS duplicado, is_price_outlier AS alerta_preco, {_SEV} AS gravidade FROM gold""",
    dates=("data",),
)
def _(spark, sf_dir):
    return star.fact_purchases(with_attributes(gold(spark, sf_dir, history=True, keep=_FACT)))


def _mode(key: str, value: str) -> str:
    return f"(SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS r FROM purchases WHERE {value} IS NOT NULL GROUP BY 1, 2)"


@query(
    "dim_material",
    f"""WITH {PURCHASES}, f AS {_mode('codigo_catmat', 'familia_material')}, d AS {_mode('codigo_catmat', 'descricao_item')},
    g AS {_mode('codigo_catmat', 'CAST(CAST(capacidade AS INTEGER) AS VARCHAR)')}
    SELECT f.k AS codigo_catmat, f.v AS familia_material, d.v AS descricao_item, g.v AS codigo_pdm, CASE WHEN f.k % 4 > 0 THEN CAST(f.k % 4 AS VARCHAR) END AS codigo_classe,
    f.k || ' - ' || d.v AS material_rotulo FROM f JOIN d ON f.k = d.k AND f.r = 1 AND d.r = 1 JOIN g ON f.k = g.k AND g.r = 1""",
)
def _(spark, sf_dir):
    return star.dim_material(with_attributes(purchases(spark, sf_dir)))


@query("dim_supplier", f"WITH {PURCHASES}, f AS {_mode('cnpj_fornecedor', 'fornecedor_nome')} SELECT k AS fornecedor_key, v AS fornecedor_nome FROM f WHERE r = 1")
def _(spark, sf_dir):
    return star.dim_supplier(purchases(spark, sf_dir))


@query("dim_uasg", f"WITH {PURCHASES} SELECT CAST(uasg AS VARCHAR) AS uasg_key, min(uf) AS uf, {', '.join(f'min({e}) AS {c}' for c, e in _BUYER.items())} FROM purchases GROUP BY 1")
def _(spark, sf_dir):
    return star.dim_buyer(with_attributes(purchases(spark, sf_dir)))


@query(
    "dim_unit",
    f"""WITH {PURCHASES}, n AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS r
      FROM (SELECT {_UNIT_KEY} AS k, nullif(nome_unidade_fornecimento, '') AS v FROM purchases) WHERE v IS NOT NULL GROUP BY k, v),
    m AS (SELECT {_UNIT_KEY} AS unidade_key, min(codigo_catmat) AS codigo_catmat, min(coalesce(unidade_comparavel, 'UNIDADE_NAO_INFORMADA')) AS unidade_comparavel,
      CAST(NULL AS VARCHAR) AS sigla_unidade_fornecimento, CAST(min(capacidade) AS DOUBLE) AS capacidade FROM purchases GROUP BY 1)
    SELECT m.*, n.v AS nome_unidade_fornecimento FROM m LEFT JOIN n ON n.k = unidade_key AND r = 1""",
)
def _(spark, sf_dir):
    return star.dim_unit(purchases(spark, sf_dir))


@query(
    "dim_calendar",
    f"""WITH {PURCHASES}, d AS (SELECT CAST(unnest(generate_series(min(CAST(data_publicacao AS DATE)), max(CAST(data_publicacao AS DATE)), INTERVAL 1 DAY)) AS DATE) AS data FROM purchases)
    SELECT data, CAST(strftime(data, '%Y%m%d') AS INTEGER) AS data_key, CAST(strftime(data, '%Y%m') AS INTEGER) AS mes_key, CAST(date_trunc('month', data) AS DATE) AS inicio_mes,
    CAST(year(data) AS INTEGER) AS ano, CAST(month(data) AS INTEGER) AS mes_numero,
    ['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][month(data)] AS mes_nome,
    ['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'][month(data)] || '/' || year(data) AS mes_ano, year(data) || '-T' || quarter(data) AS ano_trimestre,
    ['Seg','Ter','Qua','Qui','Sex','Sáb','Dom'][isodow(data)] AS dia_semana_nome,
    strftime(data, '%Y-%m') AS ano_mes, CAST(quarter(data) AS INTEGER) AS trimestre_numero, 'T' || quarter(data) AS trimestre,
    CASE WHEN month(data) <= 6 THEN 'S1' ELSE 'S2' END AS semestre, CAST(day(data) AS INTEGER) AS dia, CAST(isodow(data) AS INTEGER) AS dia_semana, isodow(data) >= 6 AS fim_de_semana FROM d""",
    dates=("data", "inicio_mes"),
)
def _(spark, sf_dir):
    return star.dim_calendar(purchases(spark, sf_dir).select(F.to_date("data_publicacao").alias("data")))


@query("integrated_history", f"WITH {PURCHASES} SELECT familia_material, count(*) AS linhas FROM purchases WHERE NOT contains(upper(familia_material), 'PROMO') GROUP BY 1 UNION ALL SELECT 'NOVA', count(*) FROM purchases WHERE contains(upper(familia_material), 'PROMO')")
def _(spark, sf_dir):
    df = purchases(spark, sf_dir)
    pilot = df.where(F.contains("familia_material", F.lit("PROMO"))).withColumn("familia_material", F.lit("NOVA"))
    both = without_family(df, "PROMO").unionByName(pilot)
    return both.groupBy("familia_material").agg(F.count(F.lit(1)).alias("linhas"))


@query(
    "referential_checks",
    """SELECT 'referencia_l_orderkey' AS validacao, CAST(count(*) AS DOUBLE) AS encontrado, 0.0 AS esperado, count(*) = 0 AS aprovado
    FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL
    SELECT 'referencia_l_partkey', CAST(count(*) AS DOUBLE), 0.0, count(*) = 0 FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) UNION ALL
    SELECT 'referencia_l_suppkey', CAST(count(*) AS DOUBLE), 0.0, count(*) = 0 FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0))""",
)
def _(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    dims = {"l_orderkey": (t("orders"), "o_orderkey"), "l_partkey": (t("part"), "p_partkey"), "l_suppkey": (t("supplier").where("s_suppkey % 7 <> 0"), "s_suppkey")}
    return audit.expect_references(t("lineitem"), dims)


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS posicao, '{c}' AS coluna, '{t}' AS tipo, count(*) FILTER (WHERE {c} IS NULL) AS nulos, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) + 1e-7, 4) AS proporcao_nulos, count(DISTINCT {c}) AS distintos, min(CAST({c} AS VARCHAR)) AS exemplo FROM {name}"
        for i, (c, t) in enumerate(columns.items())
    )


@query("column_profile", _profile_sql("part", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"}))
def _(spark, sf_dir):
    return audit.column_profile(table(spark, sf_dir, "part").drop("p_retailprice"))


@query(
    "table_inventory",
    f"""WITH {GAPS}, g AS (SELECT id_compra, id_compra_item, numero_item, data_publicacao, codigo_catmat, familia_material, descricao_item, quantidade, valor_unitario, valor_total,
      sigla_unidade_fornecimento, nome_unidade_fornecimento, capacidade, cnpj_fornecedor, fornecedor_nome, uasg, uf, count(*) AS n FROM gaps GROUP BY ALL)
    SELECT 'purchases' AS tabela, CAST(sum(n) AS BIGINT) AS linhas, 19 AS colunas, CAST(sum(n - 1) AS BIGINT) AS linhas_repetidas,
    CAST(min(data_publicacao) AS DATE) AS data_minima, CAST(max(data_publicacao) AS DATE) AS data_maxima FROM g""",
    dates=("data_minima", "data_maxima"),
)
def _(spark, sf_dir):
    return audit.inventory(cut(with_gaps(purchases(spark, sf_dir))), "purchases", "data_publicacao")


@query(
    "version_compare",
    """SELECT 'orders' AS tabela, true AS colunas_iguais, true AS tipos_iguais, count(*) AS linhas_a, count(*) AS linhas_b, true AS conteudo_igual FROM orders UNION ALL
    SELECT 'part', true, true, count(*), count(*) FILTER (WHERE p_size > 1), count(*) = count(*) FILTER (WHERE p_size > 1) FROM part UNION ALL
    SELECT 'nulls', true, true, count(*), count(*), false FROM supplier UNION ALL SELECT 'moved', true, true, count(*), count(*), false FROM supplier UNION ALL
    SELECT 'typed', true, false, count(*), count(*), false FROM supplier UNION ALL SELECT 'twice', true, true, count(*) * 3, count(*) * 3, false FROM supplier UNION ALL
    SELECT 'order', true, true, count(*) * 2, count(*) * 2, true FROM supplier""",
)
def _(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    s, none = t("supplier").select("s_suppkey", "s_name"), F.lit(None).cast("string")
    key, name = F.col("s_suppkey"), F.col("s_name")
    old = {
        "orders": t("orders"), "part": t("part"), "nulls": s.select(none.alias("a"), name.alias("b")), "moved": s.select(key.alias("k"), name.alias("n")),
        "typed": s.select(key.alias("k")), "twice": s.union(s).union(s.withColumn("s_name", F.lit("x"))), "order": s.union(s),
    }
    new = {
        "orders": t("orders").orderBy(F.desc("o_orderkey")), "part": t("part").where("p_size > 1"), "nulls": s.select(name.alias("a"), none.alias("b")),
        "moved": s.select(key.alias("k"), F.concat(F.lit("Supplier#"), F.lpad(((key % 7) + 1).cast("string"), 9, "0")).alias("n")),
        "typed": s.select(key.cast("int").alias("k")), "twice": s.union(s.withColumn("s_name", F.lit("x"))).union(s.withColumn("s_name", F.lit("x"))),
        "order": s.union(s.orderBy(F.desc("s_suppkey"))),
    }
    return audit.compare_versions(old, new)


_PAIRS = [("id_item_compra", "id_item_compra_raw"), ("id_compra_item", "id_compra_item_raw"), ("purchase_id", "id_item_compra_raw"), ("purchase_id", "id_compra_item_raw"), ("vazio", "id_compra_item_raw")]


def _pair_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS coluna_gold, '{b}' AS coluna_bronze, (SELECT count({a}) FROM g) AS gold_preenchidos, (SELECT count({b}) FROM b) AS bronze_preenchidos,
      (SELECT count(DISTINCT {a}) FROM g) AS gold_unicos, (SELECT count(DISTINCT {b}) FROM b) AS bronze_unicos, (SELECT count(*) FROM g WHERE {a} IN (SELECT {b} FROM b)) AS correspondencias,
      round(round(100.0 * (SELECT count(*) FROM g WHERE {a} IN (SELECT {b} FROM b)) / (SELECT count({a}) FROM g), 2) + 1e-7, 4) AS percentual_correspondencia"""


@query(
    "key_matches",
    """WITH g AS (SELECT CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_orderkey AS VARCHAR) END AS id_item_compra, l_orderkey || '-' || l_linenumber AS id_compra_item,
      CASE WHEN l_linenumber = 1 THEN l_orderkey || '-1' ELSE CAST(l_partkey AS VARCHAR) END AS purchase_id FROM lineitem),
    b AS (SELECT CAST(o_orderkey AS VARCHAR) AS id_item_compra_raw, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || '-' || (o_orderkey % 4) END AS id_compra_item_raw FROM orders)
    """ + " UNION ALL ".join(_pair_sql(a, b) for a, b in _PAIRS[:4]),
)
def _(spark, sf_dir):
    n, o, line = F.col("l_orderkey"), F.col("o_orderkey"), F.col("l_linenumber").cast("string")
    text = lambda c: c.cast("string")
    gold_side = table(spark, sf_dir, "lineitem").select(
        F.when(n % 5 > 0, F.concat(F.lit(" "), text(n))).otherwise("nan").alias("id_item_compra"), F.concat_ws("-", text(n), line).alias("id_compra_item"),
        F.when(line == "1", F.concat(text(n), F.lit("-1 "))).otherwise(text(F.col("l_partkey"))).alias("purchase_id"), F.lit(" ").alias("vazio"),
    )
    raw = table(spark, sf_dir, "orders").select(text(o).alias("id_item_compra_raw"), F.when(o % 3 > 0, F.concat_ws("-", text(o), text(o % 4))).otherwise("").alias("id_compra_item_raw"))
    return joins.key_matches(gold_side, raw, _PAIRS)


@query(
    "key_conflicts",
    f"""WITH {PURCHASES}, g AS (SELECT id_compra_item, count(DISTINCT cnpj_fornecedor) > 1 AS a, count(DISTINCT codigo_catmat) > 1 AS b, count(DISTINCT uasg) > 1 AS c FROM purchases GROUP BY 1)
    SELECT 'cnpj_fornecedor' AS campo, count(*) FILTER (WHERE a) AS conflitos FROM g UNION ALL SELECT 'codigo_catmat', count(*) FILTER (WHERE b) FROM g
    UNION ALL SELECT 'uasg', count(*) FILTER (WHERE c) FROM g""",
)
def _(spark, sf_dir):
    return joins.key_conflicts(purchases(spark, sf_dir), "id_compra_item", ["cnpj_fornecedor", "codigo_catmat", "uasg"])


@query("bronze_props", "SELECT event_type, count(*) AS registros, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) + 1e-7, 4) AS soma FROM events GROUP BY 1")
def _(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit('{"resultado": ['), F.col("props"), F.lit("]}")).alias("texto"))
    return bronze.unwrap(files, "k double").groupBy("event_type").agg(F.count(F.lit(1)).alias("registros"), F.sum("k").alias("soma"))


#: Envelopes around a record P, and how often P is among the records of each reader: service, enrichment's audit, audit of landed units.
_ENVELOPES = [
    ("[P, 5, P]", 2, 2, 2),
    ('{"_embedded": {"z": [P], "b": [P, P, P]}, "resultado": [P, P]}', 1, 2, 2),
    ('{"_embedded": {"s": "[1]", "n": null, "b": [P, P, P], "a": [P]}}', 3, 3, 3),
    ('{"dados": {"y": 1, "x": [P, P], "a": [P]}}', 0, 2, 2),
    ('{"content": [P], "items": [P, P], "dados": {}}', 1, 2, 2),
    ('{"_embedded": [P, P]}', 0, 0, 2),
    ('{"licitacoes": [P], "outros": [P, P]}', 1, 0, 0),
    ("{no json", 0, 0, 0),
]


@query(
    "bronze_envelopes",
    "WITH e(i, a, b, c) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (_, a, b, c) in enumerate(_ENVELOPES))
    + f"""), k AS (SELECT event_id % {len(_ENVELOPES)} AS i, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1),
    r AS (SELECT 'servico' AS leitor, i, n * a AS registros, k * a AS soma FROM k JOIN e USING (i) UNION ALL SELECT 'auditoria', i, n * b, k * b FROM k JOIN e USING (i)
      UNION ALL SELECT 'bronze', i, n * c, k * c FROM k JOIN e USING (i))
    SELECT leitor, CAST(i AS INTEGER) AS envelope, registros, CAST(soma AS BIGINT) AS soma FROM r WHERE registros > 0""",
)
def _(spark, sf_dir):
    i = (F.col("event_id") % len(_ENVELOPES)).cast("int")
    envelope = F.get(F.array(*[F.lit(e) for e, *_ in _ENVELOPES]), i)
    files = table(spark, sf_dir, "events").select(i.alias("envelope"), F.replace(envelope, F.lit("P"), F.col("props")).alias("texto"))
    readers = {"servico": bronze.records_of(F.col("texto")), "auditoria": bronze.audit_records(F.col("texto")), "bronze": bronze.bronze_audit_records(F.col("texto"))}
    out = None
    for name, records in readers.items():
        one = bronze.unwrap_records(files, records, "k long").select(F.lit(name).alias("leitor"), "envelope", "k")
        out = one if out is None else out.union(one)
    return out.groupBy("leitor", "envelope").agg(F.count(F.lit(1)).alias("registros"), F.sum("k").alias("soma"))


@query(
    "page_cut",
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pagina, props FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY pagina) AS r FROM p),
    c AS (SELECT user_id, min(CASE WHEN r > 1 THEN pagina END) AS cut FROM s GROUP BY 1)
    SELECT user_id, count(*) AS paginas FROM s JOIN c USING (user_id) WHERE cut IS NULL OR pagina < cut GROUP BY 1""",
)
def _(spark, sf_dir):
    page = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    pages = table(spark, sf_dir, "events").select("user_id", page.alias("pagina"), F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("texto"))
    return bronze.cut_repeated_pages(pages, "user_id", "pagina", "texto").groupBy("user_id").agg(F.count(F.lit(1)).alias("paginas"))


#: What pages of one user say about their number, and the last page by it: null has no say, so short pages count.
_TOTALS = [('"totalPaginas": 3, ', 3, True), ('"totalPaginas": 0, "totalPages": "4", ', 4, True), ('"totalPages": "many", ', None, True), ('"total_pages": 2.9, ', 2, True), ("", None, False)]


@query(
    "page_stop",
    """WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pagina, event_id, props FROM events),
    t(i, total, told) AS (VALUES """ + ", ".join(f"({i}, {'NULL' if n is None else n}, {str(told).lower()})" for i, (_, n, told) in enumerate(_TOTALS))
    + f"""), s AS (SELECT *, event_id % 11 = 0 AS nothing, event_id % 7 = 0 AS short FROM p JOIN t ON user_id % {len(_TOTALS)} = i),
    c AS (SELECT user_id, min(pagina) FILTER (WHERE nothing) AS cut, min(pagina) FILTER (WHERE pagina >= total OR NOT told AND (short OR nothing)) AS last FROM s GROUP BY 1)
    SELECT user_id, count(*) AS paginas, max(pagina) AS ultima FROM s JOIN c USING (user_id) WHERE (cut IS NULL OR pagina < cut) AND (last IS NULL OR pagina <= last) GROUP BY 1""",
)
def _(spark, sf_dir):
    page, n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")), F.col("event_id")
    record = lambda k: F.concat(F.lit('{"id": '), (n * 2 + k).cast("string"), F.lit("}"))
    inside = F.when(n % 11 == 0, "").when(n % 7 == 0, record(0)).otherwise(F.concat_ws(", ", record(0), record(1)))
    told = F.get(F.array(*[F.lit(t) for t, *_ in _TOTALS]), (F.col("user_id") % len(_TOTALS)).cast("int"))
    text = F.concat(F.lit("{"), told, F.lit('"resultado": ['), inside, F.lit("]}"))
    pages = table(spark, sf_dir, "events").select("user_id", page.cast("long").alias("pagina"), text.alias("texto"))
    kept = bronze.cut_repeated_pages(pages, "user_id", "pagina", "texto", page_size=2)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("paginas"), F.max("pagina").alias("ultima"))


@query(
    "field_fill",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS campo, CAST(coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS preenchidos, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS ausentes,
        round(100.0 * coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) / sum(n) + 1e-7, 4) AS percentual, count(v) AS distintos, coalesce(string_agg(v, '; ' ORDER BY v) FILTER (WHERE r <= 15), '') AS exemplos
        FROM (SELECT v, n, row_number() OVER (ORDER BY v NULLS LAST) AS r FROM (SELECT trim({c}) AS v, count(*) AS n FROM part GROUP BY 1))"""
        for c in ("p_brand", "p_type", "p_name")
    ),
)
def _(spark, sf_dir):
    return quality.field_fill(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])


@query(
    "latest_by_code",
    """WITH r AS (SELECT l_partkey AS codigo, l_orderkey % 3 AS corrida, row_number() OVER (PARTITION BY l_orderkey % 3 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS posicao, l_quantity AS total FROM lineitem WHERE l_orderkey % 3 < 2)
    SELECT codigo, arg_max(total, corrida * 100000000 + posicao) AS total, max(corrida * 100000000 + posicao) % 100000000 AS posicao FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    """Two runs over the same codes: the last row of the later run stays."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]

    def run(k: int):
        rows = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 3 == k).select("l_partkey", *order)
        return row_position(rows, order).select(F.col("l_partkey").alias("codigo"), F.col("l_quantity").alias("total"), (F.col("posicao") + 1).alias("posicao"))

    return upsert(run(0), run(1))
