"""Known answers for jobs on tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import audit, backtest, classify, hierarchy, joins, outliers, quality, series, star, typing
from quarrymill.sources import bronze, tables
from quarrymill.streaming import incremental

FACT = """purchase_id string, id_compra string, id_compra_item string, numero_item int, data_publicacao timestamp, codigo_catmat long,
quantidade double, valor_unitario double, valor_total double, cnpj_fornecedor string, uasg long, sigla_unidade_fornecimento string,
nome_unidade_fornecimento string, unidade_comparavel string"""


def fact(spark, rows):
    base = dict(purchase_id="p", id_compra="c", id_compra_item="i", numero_item=1, data_publicacao="2023-05-01 00:00:00", codigo_catmat=1,
                quantidade=1.0, valor_unitario=10.0, valor_total=10.0, cnpj_fornecedor="s", uasg=1, sigla_unidade_fornecimento="UN",
                nome_unidade_fornecimento="unidade", unidade_comparavel="UN")
    names = [x.split()[0] for x in FACT.replace("\n", " ").split(",")]
    data = [tuple((base | r)[n] for n in names) for r in rows]
    text = spark.createDataFrame(data, FACT.replace("timestamp", "string"))
    return text.withColumn("data_publicacao", F.col("data_publicacao").try_cast("timestamp")).withColumn("ano", F.year("data_publicacao"))


def test_duplicates_and_history(spark):
    other = dict(data_publicacao="2023-06-01 00:00:00", cnpj_fornecedor="t")
    got = quality.apply_quality(fact(spark, [{}, other]))
    assert got.where("hist_item_repetido").count() == 2 and got.where("dq_duplicidade").count() == 0
    assert quality.apply_quality(fact(spark, [{}, {}])).where("dq_duplicidade").count() == 2
    many = [dict(numero_item=k, id_compra_item=f"i{k}", purchase_id=f"p{k}") for k in range(3)]
    assert quality.apply_quality(fact(spark, many)).where("dq_duplicidade").count() == 0


def test_flags(spark):
    rows = [dict(quantidade=None), dict(valor_unitario=0.0), dict(valor_total=11.0), dict(sigla_unidade_fornecimento=" ", nome_unidade_fornecimento=None),
            dict(codigo_catmat=None), dict(data_publicacao="nonsense"), dict(unidade_comparavel="None")]
    got = quality.apply_quality(fact(spark, [dict(r, id_compra_item=str(k), numero_item=k) for k, r in enumerate(rows)]))
    hits = {r["numero_item"]: {c for c in got.columns if c.startswith("dq_") and c != "dq_possui_erro" and r[c]} for r in got.collect()}
    assert hits == {0: {"dq_quantidade_invalida"}, 1: {"dq_valor_unitario_invalido", "dq_valor_inconsistente"}, 2: {"dq_valor_inconsistente"},
                    3: {"dq_unidade_ausente"}, 4: {"dq_codigo_ausente"}, 5: {"dq_data_invalida"}, 6: {"dq_unidade_comparavel_ausente"}}
    report = {r["regra"]: r["registros"] for r in quality.quality_report(got).collect()}
    assert report["dq_valor_inconsistente"] == 2


def test_outlier_by_unit_and_year(spark):
    prices = [(10.0 + k % 2 * 1.0, "M") for k in range(8)] + [(100.0, "M"), (100.0, "RO|CAP=100")]
    rows = [dict(valor_unitario=p, valor_total=p, unidade_comparavel=u, numero_item=k, id_compra_item=str(k)) for k, (p, u) in enumerate(prices)]
    got = outliers.flag_outliers(quality.apply_quality(fact(spark, rows)))
    found = got.where("is_price_outlier").collect()
    assert [r["numero_item"] for r in found] == [8] and found[0]["outlier_gravidade"] == "CRITICO"
    assert found[0]["outlier_q1"] == 10 and found[0]["outlier_q3"] == 11 and found[0]["outlier_limite_superior"] == 12.5
    assert got.where("outlier_mediana is not null").count() == 9


FAMILIES = {
    "cabos": {"label": "Cabos", "priority": 10, "include": [("cabo eletrico", 5), ("cabo", 1)], "exclude": ["cabo de rede"]},
    "medidores": {"label": "Medidores", "priority": 20, "include": [("medidor", 3), ("energia", 3)], "exclude": []},
}


def test_classification(spark):
    texts = [(1, "Cabo elétrico de potência, cobre"), (2, "Cabo de rede categoria 6"), (3, "Medidor eletrônico de energia"), (4, None), (5, "cabo")]
    df = spark.createDataFrame(texts, "codigo long, descricao string")
    got = classify.classify(df, "descricao", FAMILIES)
    by = {r["codigo"]: r for r in got.collect()}
    assert [by[k]["familia_codigo"] for k in range(1, 6)] == ["cabos", None, "medidores", None, None]
    assert by[1]["classificacao_motivo"] == "cabo eletrico (+5); cabo (+1)" and by[4]["classificacao_motivo"] == classify.NO_TEXT
    over = spark.createDataFrame([(1, "excluir", None), (2, "incluir", "medidores")], "codigo long, acao string, familia_codigo string")
    out = {r["codigo"]: (r["familia_codigo"], r["classificacao_score"], r["material_relevante"]) for r in classify.override(got, over, FAMILIES).collect()}
    assert out[1] == (None, 0, False) and out[2] == ("medidores", 999, True) and out[3][0] == "medidores"
    with pytest.raises(Exception, match="bad override"):
        classify.override(got, over.withColumn("acao", F.lit("x")), FAMILIES).collect()


def test_item_status(spark):
    df = spark.createDataFrame([("MEDIDOR DE ENERGIA TRIFASICO",), ("MEDIDOR DE AGUA",), ("MEDIDOR ENERGIA REATIVA",)], "t string")
    status = classify.item_status(F.col("t"), F.lit(70), ["AGUA"], ["MEDIDOR"], ["ENERGIA"], ["ALICATE"], "ATIVA", "REATIVA")
    assert [r[0] for r in df.select(status).collect()] == ["ADERENTE", "DESCARTAR", "ESPECIALIZADO"]
    labels = classify.item_category(F.col("t"), [("tri", ["TRIFASICO"])], "ATIVA", "REATIVA", ("both", "reactive", "plain"))
    assert [r[0] for r in df.select(labels).collect()] == ["tri", "plain", "reactive"]


def test_bronze(spark, tmp_path):
    import json

    (tmp_path / "a").mkdir()
    payloads = {"1": {"resultado": [{"v": 1}, 5, {"v": 2}]}, "2": [{"v": 3}], "3": {"_embedded": {"x": [{"v": 4}]}}, "4": {"items": [{"v": 5}]}, "5": {"resultado": []}}
    for k, p in payloads.items():
        (tmp_path / "a" / f"{k}.json").write_text(json.dumps(p))
    (tmp_path / "bad.json").write_text("{nope")
    files = bronze.scan(spark, str(tmp_path))
    assert bronze.file_report(files).first().asDict() == {"arquivos": 6, "invalidos": 1}
    assert sorted(r["v"] for r in bronze.unwrap(files, "v int").collect()) == [1, 2, 3, 4, 5]
    pages = spark.createDataFrame([(1, 1, '[{"a":1},{"a":2}]'), (1, 2, '[{"a":3}]'), (1, 3, '[{"a":2},{"a":1}]'), (1, 4, '[{ "a":3}]'), (1, 5, "[4]"), (2, 1, "[]")], "c int, p int, t string")
    # other records in another order are another page; a page without records ends a sequence
    assert sorted((r["c"], r["p"]) for r in bronze.cut_repeated_pages(pages, "c", "p", "t").collect()) == [(1, 1), (1, 2), (1, 3)]


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x"'), ("line\r\nbreak", "bar | inside")], "x string, y string")
    tables.write_report(df, str(tmp_path / "r"))
    text = "".join(f.read_text() for f in (tmp_path / "r").glob("part-*"))
    assert "\r" not in text
    got = {tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "r")).collect()}
    assert got == {("a;b", 'say "x"'), ("line break", "bar | inside")}


def test_silver(spark):
    raw = spark.createDataFrame([("c1", 7, "10", "1,5", "2023-01-05", "UN", "x")], "idCompra string, codigoItemCatalogo long, quantidade string, precoUnitario string, dataCompra string, siglaUnidadeFornecimento string, descricaoItem string")
    cat = spark.createDataFrame([(7, "Fam", "desc")], "codigo long, familia_material string, descricao string")
    r = typing.silver(raw, cat).first()
    assert r["valor_total"] == 15.0 and r["unidade_comparavel"] == "UN" and r["familia_material"] == "Fam" and r["tipo_valor"] == "PRATICADO"
    old = typing.tender_items(spark.createDataFrame([("c1",)], "id_compra string"), spark.createDataFrame([("c1", "10", None, "1.000,00", None, "unidade", None)], "id_compra string, quantidade string, valor_unitario string, valor_total string, sigla_unidade_fornecimento string, nome_unidade_fornecimento string, capacidade string"))
    assert old.first()["valor_unitario"] == 100.0 and old.first()["unidade_comparavel"] == "UN"


def test_alignment_and_checks(spark):
    schema = spark.createDataFrame([], "a long, f boolean, s string").schema
    r = typing.align(spark.createDataFrame([("5", "sim")], "a string, f string"), schema).first()
    assert tuple(r) == (5, True, None)
    with pytest.raises(ValueError):
        joins.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "codigo int, v string")
    a_, b_ = (x.withColumnsRenamed({"k": "codigo"}).withColumn("posicao", F.lit(9 if x is a else 1)) for x in (a, b))
    assert sorted(r["v"] for r in incremental.upsert(a_, b_).collect()) == ["x", "z"]
    assert [r["codigo"] for r in incremental.pending(a.withColumnRenamed("k", "codigo"), b).collect()] == [1]
    same = audit.compare_versions({"t": a}, {"t": a.orderBy(F.desc("k"))}).first()
    assert same["conteudo_igual"] and same["colunas_iguais"]


def test_series_profile_and_backtest(spark):
    rows = [(1, f"2020-{m:02d}-10 00:00:00", 2.0) for m in range(1, 13)] + [(1, "2022-12-01 00:00:00", 4.0), (2, "2021-05-01 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "codigo_catmat long, d string, quantidade double").withColumn("data_publicacao", F.col("d").cast("timestamp"))
    s = series.monthly_series(df, ["codigo_catmat"])
    assert s.count() == 72
    profile = {r["codigo_catmat"]: r for r in series.intermittency(s, ["codigo_catmat"]).collect()}
    assert profile[1]["meses_ativos"] == 13 and profile[1]["adi"] == pytest.approx(35 / 12) and profile[2]["adi"] == 36
    for n, want in ((14, []), (15, [12]), (24, [21, 18, 15]), (36, [33, 30, 27, 24])):
        assert spark.range(1).select(backtest.rolling_folds(F.lit(n))).first()[0] == want
    assert spark.range(1).select(backtest.yearly_folds(F.lit(50))).first()[0] == [24, 36, 38]
    by = ["codigo_catmat"]
    chosen = backtest.choose(series.as_arrays(s, by), series.intermittency(s, by), by)
    months = backtest.scenarios(chosen, by)
    assert months.count() == 24 and months.where("previsao_inferior > previsao_base or previsao_base > previsao_superior").count() == 0
    assert all(r["total_base"] > 0 for r in backtest.scenario_summary(months, by).collect())


def test_allocation(spark):
    history = spark.createDataFrame([("S", "SEGMENTO", 1, 10.0, 1, 1), ("S", "SEGMENTO", 2, 30.0, 3, 1), ("M", "INDIVIDUAL", 3, 0.0, 0, 0)],
                                    "unidade_modelagem string, nivel_modelagem string, codigo_catmat long, quantidade_historica double, compras_distintas long, meses_ativos long")
    w = hierarchy.weights(history)
    got = {r["codigo_catmat"]: r["peso_rateio"] for r in w.collect()}
    assert got == pytest.approx({1: 0.3, 2: 0.7, 3: 1.0}) and hierarchy.weight_errors(w).count() == 0
    f = spark.createDataFrame([("S", "2024-01-01", 10.0, 5.0, 20.0)], "unidade_modelagem string, mes string, previsao_base double, previsao_inferior double, previsao_superior double")
    out = hierarchy.allocate(f, w)
    assert hierarchy.preservation(f, out).where("preservado").count() == 3
    long = star.fact_forecast(out.withColumn("mes", F.to_date("mes")).select("codigo_catmat", "mes", *hierarchy.SCENARIOS), ["codigo_catmat", "mes"])
    assert {(r["cenario"], r["ordem_cenario"]) for r in long.collect()} == {("INFERIOR", 1), ("BASE", 2), ("SUPERIOR", 3)}
    with pytest.raises(Exception, match="no weights"):
        hierarchy.allocate(f.withColumn("unidade_modelagem", F.lit("?")), w).collect()


def test_every_query_with_sql_is_registered(spark, sf_dir):
    from quarrymill.plans import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_tables_of_one_version_only_are_differences(spark):
    from quarrymill.operators.audit import compare_versions

    df = spark.range(3)
    got = {r["tabela"]: r.asDict() for r in compare_versions({"a": df, "b": df}, {"b": df, "c": df}).collect()}
    assert got["b"]["conteudo_igual"] and not got["a"]["conteudo_igual"] and not got["c"]["conteudo_igual"]
    assert (got["a"]["linhas_a"], got["a"]["linhas_b"], got["c"]["linhas_a"], got["c"]["linhas_b"]) == (3, None, None, 3)


def test_next_steps_of_the_forecast_follow_the_level(spark):
    from quarrymill.operators.hierarchy import for_star

    df = spark.createDataFrame([("Individual", 2.0, 0.5, 0.3), ("SEGMENTO", 1.0, 0.5, None)], "nivel_modelagem string, previsao_base double, incerteza double, wape double")
    got = for_star(df).collect()
    assert [r["tipo_demanda"] for r in got] == ["INTERMITENTE_INDIVIDUAL", "INTERMITENTE_SEGMENTO"]
    assert got[0]["proximo_passo"].startswith("Recalibrar com consumo interno") and got[1]["proximo_passo"].startswith("Recalibrar o segmento")


def test_capacities_and_units(spark):
    from quarrymill.functions.units import comparable_unit

    rows = [("un", None, 1.0), (None, " Metro ", 2.5), ("Peça", None, 100.0), ("zz", None, 0.0), (None, None, 3.0), ("KG", None, 1e20), ("kg", None, 0.0000001), ("kg", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    got = [r["u"] for r in df.select(comparable_unit("a", "b", "c").alias("u")).collect()]
    assert got == ["UN", "M|CAP=2.5", "PC|CAP=100", "ZZ", None, "KG|CAP=100000000000000000000", "KG|CAP=0", "KG"]


def test_staging_gate_sees_each_fault(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    fact = one([(1, "PE", "f", "u", "1|UN", "2024-01-01"), (7, "SP", "f", "u", "7|UN", "2024-01-01")], "codigo_catmat long, uf string, fornecedor_key string, uasg_key string, unidade_key string, data string")
    forecast = one([(1, "2024-01-01", c, q) for c, q in (("INFERIOR", 1.0), ("BASE", 2.0), ("SUPERIOR", 3.0))], "codigo_catmat long, mes string, cenario string, quantidade_prevista double")
    tables = {
        "compras": fact, "previsao": forecast, "material": one([(1,), (7,)], "codigo_catmat long"), "fornecedor": one([("f",)], "fornecedor_key string"),
        "uasg": one([("u", "PE")], "uasg_key string, uf string"), "unidade": one([("1|UN",), ("7|UN",)], "unidade_key string"),
        "calendario": one([("2024-01-01",)], "data string"), "cenario": one([("BASE",), ("INFERIOR",), ("SUPERIOR",)], "cenario string"),
    }
    new, old = one([(1,)], "codigo_catmat long"), one([(9,)], "codigo_catmat long")

    def failed(production=fact, **changed):
        rows = audit.staging_expectations(tables | changed, new, old, 2, 3, production).collect()
        assert len(rows) == 20
        return {r["validacao"] for r in rows if not r["aprovado"]}

    assert failed() == set()
    assert audit.approved(audit.staging_expectations(tables, new, old, 2, 3)).first()["aprovado"]
    bare = fact.where("codigo_catmat = 1").withColumn("uf", F.lit(None).cast("string"))
    assert failed(compras=bare) == {"Estado preenchido na FatoCompras", "UFs representadas", "Linhas de outras famílias preservadas"}
    assert failed(material=one([(1,), (1,)], "codigo_catmat long")) == {"DimMaterial sem duplicidade", "CATMATs da compra na dimensão"}
    assert failed(previsao=forecast.where("cenario <> 'BASE'")) == {"Linhas previstas", "Ordem dos cenários"}
    assert failed(previsao=forecast.withColumn("quantidade_prevista", -F.col("quantidade_prevista"))) == {"Previsões não negativas", "Ordem dos cenários"}
    assert failed(compras=fact.union(fact.where("codigo_catmat = 1").withColumn("codigo_catmat", F.lit(9).cast("long")))) == {
        "CATMATs antigos removidos", "CATMATs da compra na dimensão"
    }
    empty = one([], "data string")
    assert failed(calendario=empty, fornecedor=tables["fornecedor"].where("false")) == {"Fornecedores cobertos", "Datas das compras cobertas", "Datas da previsão cobertas"}


def test_summary_for_the_star(spark):
    summary = spark.createDataFrame([(1, "M1", "individual", 1.0, 2.0, 3.0), (2, "S", "SEGMENTO", 1.0, 2.0, 3.0)], "codigo_catmat long, unidade_modelagem string, nivel_modelagem string, previsao_12m_inferior double, previsao_12m_base double, previsao_12m_superior double")
    units = spark.createDataFrame([("M1", 0.5, 1.0, 4, 10, 0.25)], "unidade_modelagem string, wape_validacao double, mae_validacao double, janelas_validacao int, meses_com_demanda int, percentual_meses_sem_demanda double")
    weights = spark.createDataFrame([(1, 70.0), (2, 30.0)], "codigo_catmat long, quantidade_historica double")
    got = {r["codigo_catmat"]: r for r in star.forecast_summary(hierarchy.summary_for_star(summary, units, weights)).collect()}
    assert list(got[1].asDict()) == list(star.SUMMARY)
    assert (got[1]["tipo_demanda"], got[1]["wape_validacao_percentual"], got[1]["quantidade_historica_total"]) == ("INTERMITENTE_INDIVIDUAL", 50.0, 70.0)
    assert got[2]["tipo_demanda"] == "INTERMITENTE_SEGMENTO" and got[2]["wape_validacao_percentual"] is None and got[2]["previsao_12m_cenario_superior"] == 3.0
    with pytest.raises(ValueError):
        hierarchy.summary_for_star(summary, units.union(units), weights)
    old = spark.createDataFrame([(2,)], "codigo_catmat long")
    both = star.integrate_codes(summary, summary.where("codigo_catmat = 2").drop("nivel_modelagem"), old)
    assert both.columns == summary.columns and {r["codigo_catmat"]: r["nivel_modelagem"] for r in both.collect()} == {1: "individual", 2: None}


def test_demand_is_not_forecast_as_nothing(spark):
    """A unit with demand long ago: the recent means are zero, so Croston takes their place; years with demand are counted."""
    a = [0.0] * 84
    a[2] = a[14] = 5.0
    df = spark.createDataFrame([("u", "INDIVIDUAL", a, datetime.date(2024, 12, 1))], "unidade_modelagem string, nivel_modelagem string, a array<double>, ultimo_mes date")
    by = ["unidade_modelagem", "nivel_modelagem"]
    assert all(r["previsao_base"] > 0 for r in backtest.unit_forecast(df, by).collect())
    got = backtest.unit_summary(df, by).first()
    assert (got["meses_com_demanda"], got["anos_ativos"], got["meses_historicos"], got["quantidade_historica_total"]) == (2, 2, 84, 10.0)
    assert got["percentual_meses_sem_demanda"] == 82 / 84
