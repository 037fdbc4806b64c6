"""Purchases derived from the order tables, in Spark and in SQL.

Some rows are spoilt by rules on the order key (no quantity, no price, no unit, a wrong total), and the rows of some
orders occur twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.units import comparable_unit
from quarrymill.operators.outliers import flag_outliers
from quarrymill.operators.quality import apply_quality, needed
from quarrymill.sources.scratch import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table; if it has fewer splits than the cluster has cores, its rows are dealt out once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _code() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different codes of the materials that may be purchased, without deriving purchases."""
    return table(spark, sf_dir, "part").select(_code().alias("codigo_catmat")).distinct()


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # customers meet the narrow orders, so that order lines are shuffled by their order alone
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        dealt(t("lineitem"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    k = F.col("l_orderkey")
    copies = F.when(k % 53 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    unit = F.when(F.col("l_returnflag") == "A", "unidade").when(F.col("l_returnflag") == "N", "metro").otherwise("rolo")
    out = joined.withColumn("_copy", F.explode(copies)).select(
        k.cast("string").alias("id_compra"),
        F.col("l_linenumber").alias("numero_item"),
        F.concat_ws("-", k.cast("string"), F.col("l_linenumber").cast("string")).alias("id_compra_item"),
        F.col("l_shipdate").cast("timestamp").alias("data_publicacao"),
        _code().alias("codigo_catmat"),
        F.col("p_type").alias("familia_material"),
        F.col("p_name").alias("descricao_item"),
        F.when(k % 97 != 0, F.col("l_quantity")).alias("quantidade"),
        F.when(k % 101 == 0, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("valor_unitario"),
        F.when(k % 83 == 0, F.col("l_extendedprice") * 1.05).otherwise(F.col("l_extendedprice")).alias("valor_total"),
        F.lit(None).cast("string").alias("sigla_unidade_fornecimento"),
        F.when(k % 89 == 0, "").otherwise(unit).alias("nome_unidade_fornecimento"),
        F.when(F.col("p_size") % 3 == 0, 0.0).when(F.col("p_size") % 3 == 1, 1.0).otherwise(100.0).alias("capacidade"),
        F.col("l_suppkey").cast("string").alias("cnpj_fornecedor"),
        F.col("s_name").alias("fornecedor_nome"),
        F.col("o_custkey").alias("uasg"),
        F.col("n_name").alias("uf"),
    )
    return out.withColumn("ano", F.year("data_publicacao")).withColumn(
        "unidade_comparavel", comparable_unit("sigla_unidade_fornecimento", "nome_unidade_fornecimento", "capacidade")
    )


def with_flags(df: DataFrame, history: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with quality flags; what these and ``keep`` need is written before the flags and not shuffled as a whole after that."""
    return apply_quality(cut(df if keep is None else df.select(*needed(df, keep))), history, keep)


def gold(spark: SparkSession, sf_dir: str, history: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Purchases, or their columns ``keep`` and those of the limits, with quality and outlier flags."""
    return flag_outliers(with_flags(purchases(spark, sf_dir), history, keep and [*keep, "codigo_catmat", "unidade_comparavel", "ano", "valor_unitario"]))


def with_gaps(df: DataFrame) -> DataFrame:
    """Purchases with what real records lack, by rules on the order: tax numbers, names, purchases, dates, quantities below zero."""
    k = F.col("id_compra").cast("long")
    return df.withColumns(
        {
            "cnpj_fornecedor": F.when(k % 61 == 0, " ").when(k % 67 == 0, None).otherwise(F.col("cnpj_fornecedor")),
            "fornecedor_nome": F.when(k % 134 == 0, None).otherwise(F.col("fornecedor_nome")),
            "quantidade": F.when(k % 103 == 0, -F.col("quantidade")).otherwise(F.col("quantidade")),
            "data_publicacao": F.when(k % 113 == 0, None).otherwise(F.col("data_publicacao")),
            "ano": F.when(k % 113 == 0, None).otherwise(F.col("ano")),
            "id_compra": F.when(k % 109 == 0, None).when(k % 107 == 0, "").otherwise(F.col("id_compra")),
            "sigla_unidade_fornecimento": F.when(k % 4 == 0, "CX").when(k % 4 == 1, "PC"),
        }
    )


def gaps(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """Purchases with gaps, or their columns ``keep``, and quality flags."""
    return with_flags(with_gaps(purchases(spark, sf_dir)), keep=keep)


PURCHASES = """
purchases AS (
  SELECT *, CASE WHEN unit IS NULL THEN NULL WHEN capacidade = 100 THEN unit || '|CAP=100' ELSE unit END AS unidade_comparavel
  FROM (
    SELECT CAST(l_orderkey AS VARCHAR) AS id_compra, l_linenumber AS numero_item,
           l_orderkey || '-' || l_linenumber AS id_compra_item, CAST(l_shipdate AS TIMESTAMP) AS data_publicacao,
           CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS codigo_catmat, p_type AS familia_material,
           p_name AS descricao_item, CASE WHEN l_orderkey % 97 <> 0 THEN l_quantity END AS quantidade,
           CASE WHEN l_orderkey % 101 = 0 THEN 0.0 ELSE l_extendedprice / l_quantity END AS valor_unitario,
           CASE WHEN l_orderkey % 83 = 0 THEN l_extendedprice * 1.05 ELSE l_extendedprice END AS valor_total,
           CASE WHEN l_orderkey % 89 = 0 THEN '' WHEN l_returnflag = 'A' THEN 'unidade' WHEN l_returnflag = 'N' THEN 'metro'
                ELSE 'rolo' END AS nome_unidade_fornecimento,
           CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'UN' WHEN l_returnflag = 'N' THEN 'M'
                ELSE 'RO' END AS unit,
           CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 100.0 END AS capacidade,
           CAST(l_suppkey AS VARCHAR) AS cnpj_fornecedor, s_name AS fornecedor_nome, o_custkey AS uasg, n_name AS uf,
           CAST(year(l_shipdate) AS INTEGER) AS ano
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN (SELECT unnest([1, 2]) AS copia) ON copia = 1 OR l_orderkey % 53 = 0
  )
)""".replace("\\\\", "\\")

FLAGS = (
    PURCHASES
    + """,
flags AS (
  SELECT *, dq_quantidade_invalida OR dq_valor_unitario_invalido OR dq_valor_total_invalido OR dq_unidade_ausente
            OR dq_unidade_comparavel_ausente OR dq_valor_inconsistente OR dq_duplicidade AS dq_possui_erro
  FROM (
    SELECT *, quantidade IS NULL OR quantidade <= 0 AS dq_quantidade_invalida, valor_unitario <= 0 AS dq_valor_unitario_invalido,
           valor_total <= 0 AS dq_valor_total_invalido, nome_unidade_fornecimento = '' AS dq_unidade_ausente,
           unidade_comparavel IS NULL AS dq_unidade_comparavel_ausente,
           abs(valor_total - quantidade * valor_unitario) / nullif(abs(valor_total), 0) AS diferenca_valor_pct,
           coalesce(abs(valor_total - quantidade * valor_unitario) / nullif(abs(valor_total), 0) > 0.02, false) AS dq_valor_inconsistente,
           count(*) OVER (PARTITION BY id_compra_item) > 1 AS hist_item_repetido,
           count(*) OVER (PARTITION BY id_compra_item, id_compra, numero_item, codigo_catmat, data_publicacao, cnpj_fornecedor, uasg,
                          quantidade, valor_unitario, unidade_comparavel) > 1 AS dq_duplicidade
    FROM purchases
  )
)"""
)

GOLD = (
    FLAGS
    + """,
limits AS (
  SELECT *, greatest(0, q1 - 1.5 * (q3 - q1)) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT codigo_catmat AS c, unidade_comparavel AS u, ano AS a, quantile_cont(valor_unitario, 0.25) AS q1,
           quantile_cont(valor_unitario, 0.5) AS med, quantile_cont(valor_unitario, 0.75) AS q3
    FROM flags WHERE valor_unitario > 0 AND NOT dq_duplicidade AND unidade_comparavel IS NOT NULL
    GROUP BY 1, 2, 3 HAVING count(*) >= 8
  ) WHERE q3 > q1
),
gold AS (
  SELECT f.*, q1, med, q3, lo, hi, coalesce(valor_unitario < lo OR valor_unitario > hi, false) AS is_price_outlier,
         valor_unitario / med AS ratio
  FROM flags f LEFT JOIN limits ON codigo_catmat = c AND unidade_comparavel = u AND ano = a AND valor_unitario > 0
       AND NOT dq_duplicidade
)"""
)
_GAPS = """,
gaps AS (
  SELECT * REPLACE (CASE WHEN k % 61 = 0 THEN ' ' WHEN k % 67 = 0 THEN NULL ELSE cnpj_fornecedor END AS cnpj_fornecedor,
      CASE WHEN k % 134 = 0 THEN NULL ELSE fornecedor_nome END AS fornecedor_nome, CASE WHEN k % 103 = 0 THEN -quantidade ELSE quantidade END AS quantidade,
      CASE WHEN k % 113 = 0 THEN NULL ELSE data_publicacao END AS data_publicacao, CASE WHEN k % 113 = 0 THEN NULL ELSE ano END AS ano,
      CASE WHEN k % 109 = 0 THEN NULL WHEN k % 107 = 0 THEN '' ELSE id_compra END AS id_compra),
    CASE k % 4 WHEN 0 THEN 'CX' WHEN 1 THEN 'PC' END AS sigla_unidade_fornecimento,
    coalesce(nullif(trim(CASE WHEN k % 61 = 0 THEN ' ' WHEN k % 67 = 0 THEN NULL ELSE cnpj_fornecedor END), ''), CASE WHEN k % 134 = 0 THEN NULL ELSE fornecedor_nome END, 'NAO_IDENTIFICADO') AS fornecedor_chave
  FROM (SELECT *, CAST(id_compra AS BIGINT) AS k FROM purchases)
)"""
#: Purchases with gaps, in SQL, and the same with flags.
GAPS = PURCHASES + _GAPS
GAP_FLAGS = GAPS + FLAGS[len(PURCHASES) :].replace("FROM purchases", "FROM gaps").replace(
    "OR dq_duplicidade AS dq_possui_erro", "OR dq_duplicidade OR data_publicacao IS NULL AS dq_possui_erro"
).replace("nome_unidade_fornecimento = '' AS dq_unidade_ausente", "nome_unidade_fornecimento = '' AND sigla_unidade_fornecimento IS NULL AS dq_unidade_ausente")
SEVERITY = (
    "CASE WHEN {r} >= 5 OR {r} <= 0.20 THEN 'CRITICO' WHEN {r} >= 3 OR {r} <= 0.33 THEN 'ALTO' ELSE 'MODERADO' END"
)
