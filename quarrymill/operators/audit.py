"""Inventories, profiles, expectations and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.joins import orphans
from quarrymill.operators.repeats import surplus


def inventory(df: DataFrame, name: str, date: str | None = None) -> DataFrame:
    """Rows, columns, repeated rows beyond the first, first and last date; rows are compared by digest first, see ``repeats``.

    ``df`` is read three times, so it should be cut.
    """
    day = F.col(date).cast("date") if date else F.lit(None).cast("date")
    sums = df.agg(F.count(F.lit(1)).alias("linhas"), F.min(day).alias("data_minima"), F.max(day).alias("data_maxima"))
    both = sums.crossJoin(F.broadcast(surplus(df)))  # one row each
    return both.select(
        F.lit(name).alias("tabela"), "linhas", F.lit(len(df.columns)).alias("colunas"), F.col("repetidas").alias("linhas_repetidas"), "data_minima", "data_maxima"
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, nulls, share, different values, least value; one aggregation for all."""
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        aggs.append(
            F.struct(
                F.lit(i + 1).alias("posicao"),
                F.lit(c).alias("coluna"),
                F.lit(t).alias("tipo"),
                F.count_if(F.col(c).isNull()).alias("nulos"),
                F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("proporcao_nulos"),
                F.count_distinct(c).alias("distintos"),
                F.min(F.col(c).cast("string")).alias("exemplo"),
            ).alias(f"_{i}")
        )
    return df.agg(*aggs).select(F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("p")).select("p.*")


def _tagged(c: str, kind: str) -> list[Column]:
    """Type, null mark and value of a column for a hash; nested values as text that names their nulls."""
    value = F.col(f"`{c}`")
    if kind.startswith(("array", "map", "struct")):
        value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return [F.lit(kind), F.col(f"`{c}`").isNull(), value]


def content_hash(df: DataFrame) -> DataFrame:
    """linhas, colunas, hash: the same for the same rows in any order, as often as they occur.

    Each row has two hashes of 64 bits over its columns in order, with their types and null marks; both are added up. So a null
    that changes its column, a value that changes its row, another type, and a row twice in place of two rows are seen, but for
    a chance of about 2^-100.
    """
    fields = [x for c, t in df.dtypes for x in _tagged(c, t)]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *fields).cast("decimal(20,0)")), F.lit(0)).cast("string") for seed in (0, 1)]
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.lit(len(df.columns)).alias("colunas"), F.concat_ws(":", *sums).alias("hash"))


def compare_versions(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Per table: whether columns in order and types are equal, row counts and hashes of both versions."""
    rows = None
    for name in sorted({*old, *new}):
        a, b = old.get(name), new.get(name)
        if a is None or b is None:
            # a table of one version only is a difference
            n = (a if b is None else b).agg(F.count(F.lit(1)).alias("n"))
            none = F.lit(None).cast("long")
            one = n.select(
                F.lit(name).alias("tabela"), F.lit(False).alias("colunas_iguais"), F.lit(False).alias("tipos_iguais"),
                (none if a is None else F.col("n")).alias("linhas_a"), (none if b is None else F.col("n")).alias("linhas_b"), F.lit(False).alias("conteudo_igual"),
            )
            rows = one if rows is None else rows.union(one)
            continue
        x = content_hash(a).select(F.col("linhas").alias("linhas_a"), F.col("hash").alias("hash_a"))
        y = content_hash(b).select(F.col("linhas").alias("linhas_b"), F.col("hash").alias("hash_b"))
        one = x.crossJoin(y).select(  # one row each
            F.lit(name).alias("tabela"),
            F.lit(a.columns == b.columns).alias("colunas_iguais"),
            F.lit(a.dtypes == b.dtypes).alias("tipos_iguais"),
            "linhas_a",
            "linhas_b",
            (F.col("hash_a") == F.col("hash_b")).alias("conteudo_igual"),
        )
        rows = one if rows is None else rows.union(one)
    return rows


def expect(df: DataFrame, name: str, found: Column, wanted: Column) -> DataFrame:
    """One row: validacao, encontrado, esperado, aprovado."""
    out = df.agg(found.cast("double").alias("encontrado"), wanted.cast("double").alias("esperado"))
    return out.select(F.lit(name).alias("validacao"), "encontrado", "esperado", F.col("encontrado").eqNullSafe(F.col("esperado")).alias("aprovado"))


def expect_none(df: DataFrame, name: str) -> DataFrame:
    return expect(df, name, F.count(F.lit(1)), F.lit(0))


def expect_references(fact: DataFrame, keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """No fact key without its dimension row, one expectation per key."""
    rows = None
    for key, (dim, dim_key) in keys.items():
        one = expect_none(orphans(fact, key, dim, dim_key), f"referencia_{key}")
        rows = one if rows is None else rows.union(one)
    return rows


def expect_codes(df: DataFrame, codes: DataFrame, name: str) -> DataFrame:
    """All of ``codes`` are in ``df``."""
    there = df.select("codigo_catmat").distinct().withColumn("_there", F.lit(1))
    return expect(codes.select("codigo_catmat").distinct().join(there, "codigo_catmat", "left"), name, F.count("_there"), F.count(F.lit(1)))


def code_sets(a: DataFrame, b: DataFrame, key: str = "codigo_catmat") -> DataFrame:
    """Different keys of two tables, and whether they are in both or in one: AMBOS, SO_A, SO_B."""
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "SO_A").when(F.col("_a").isNull(), "SO_B").otherwise("AMBOS")
    return x.join(y, key, "full_outer").select(key, side.alias("presenca"))


#: Columns of the fact that the expectations read.
FACT_READ = ["codigo_catmat", "fornecedor_key", "uasg_key", "unidade_key", "data", "uf"]


def staging_expectations(
    tables: dict[str, DataFrame], new_codes: DataFrame, old_codes: DataFrame, states: int, forecast_rows: int, production: DataFrame | None = None
) -> DataFrame:
    """The expectations on a staged star schema, one row each.

    ``tables``: compras (with ``FACT_READ``), previsao, material, fornecedor, uasg, unidade, calendario, cenario; each is read
    several times, so they should be cut. ``new_codes`` replace ``old_codes``; ``forecast_rows`` is what the new ones should
    have. With ``production``, the published fact, rows of all other codes must be as many as there.
    """
    fact, forecast, material = (tables[k] for k in ("compras", "previsao", "material"))
    new, old = (c.select("codigo_catmat").distinct() for c in (new_codes, old_codes))
    mine = forecast.join(new, "codigo_catmat", "left_semi")
    wide = mine.groupBy("codigo_catmat", "mes").pivot("cenario", ["BASE", "INFERIOR", "SUPERIOR"]).agg(F.sum("quantidade_prevista"))
    ordered = (F.col("INFERIOR") <= F.col("BASE")) & (F.col("BASE") <= F.col("SUPERIOR"))
    kept = fact.select("codigo_catmat").union(forecast.select("codigo_catmat")).distinct()
    twice = material.groupBy("codigo_catmat").agg(F.count(F.lit(1)).alias("n"))
    keys = [
        ("CATMATs da compra na dimensão", fact, "codigo_catmat", "material", "codigo_catmat"),
        ("CATMATs da previsão na dimensão", forecast, "codigo_catmat", "material", "codigo_catmat"),
        ("Fornecedores cobertos", fact, "fornecedor_key", "fornecedor", "fornecedor_key"),
        ("UASGs cobertas", fact, "uasg_key", "uasg", "uasg_key"),
        ("Unidades cobertas", fact, "unidade_key", "unidade", "unidade_key"),
        ("Cenários cobertos", forecast, "cenario", "cenario", "cenario"),
        ("Datas das compras cobertas", fact, "data", "calendario", "data"),
        ("Datas da previsão cobertas", forecast, "mes", "calendario", "data"),
    ]
    parts = [
        expect(fact, "Estado preenchido na FatoCompras", F.count("uf"), F.count(F.lit(1))),
        expect(tables["uasg"], "Estado preenchido na DimUASG", F.count("uf"), F.count(F.lit(1))),
        expect(fact, "UFs representadas", F.count_distinct("uf"), F.lit(states)),
        expect_codes(fact, new, "CATMATs novos no histórico"),
        expect_codes(forecast, new, "CATMATs novos na previsão"),
        expect_codes(material, new, "CATMATs novos na dimensão"),
        expect_none(old.join(new, "codigo_catmat", "left_anti").join(kept, "codigo_catmat", "left_semi"), "CATMATs antigos removidos"),
        expect(mine, "Linhas previstas", F.count(F.lit(1)), F.lit(forecast_rows)),
        expect_none(mine.where("quantidade_prevista < 0"), "Previsões não negativas"),
        expect_none(wide.where(~F.coalesce(ordered, F.lit(False))), "Ordem dos cenários"),
        expect(twice, "DimMaterial sem duplicidade", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.lit(0)),
        *[expect_none(orphans(df, key, tables[dim], dim_key), name) for name, df, key, dim, dim_key in keys],
    ]
    if production is not None:
        both = old.union(new).distinct()
        published, staged = (df.join(both, "codigo_catmat", "left_anti") for df in (production, fact))
        sides = published.select(F.lit(1).alias("p"), F.lit(None).cast("int").alias("s")).union(staged.select(F.lit(None).cast("int"), F.lit(1)))
        parts.append(expect(sides, "Linhas de outras famílias preservadas", F.count("s"), F.count("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def layer_summary(layers: dict[str, DataFrame], column: str = "uf") -> DataFrame:
    """Per layer: rows, rows with a state, different states."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("linhas"), F.count(column).alias("preenchidos"), F.count_distinct(column).alias("ufs"))
        one = one.select(F.lit(name).alias("camada"), "*")
        out = one if out is None else out.union(one)
    return out


def layer_expectations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Summaries of layers against expected ones; a layer on one side only is not as expected."""
    names = ["linhas", "preenchidos", "ufs"]
    a = expected.select("camada", *[F.col(c).alias(f"{c}_esperados") for c in names])
    b = found.select("camada", *[F.col(c).alias(f"{c}_encontrados") for c in names])
    equal = F.lit(True)
    for c in names:
        equal = equal & F.coalesce(F.col(f"{c}_esperados") == F.col(f"{c}_encontrados"), F.lit(False))
    return a.join(b, "camada", "full_outer").withColumn("resultado", equal)


def approved(expectations: DataFrame) -> DataFrame:
    return expectations.agg(F.coalesce(F.bool_and("aprovado"), F.lit(False)).alias("aprovado"), F.count(F.lit(1)).alias("validacoes"))
