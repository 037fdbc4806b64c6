"""Ranks, repeats, hashes, contexts and resumable tables against plain versions."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import analytics, audit, joins, measures, quality, ranks, repeats, series, typing
from quarrymill.sources import bronze
from quarrymill.streaming import incremental


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def prices(spark):
    """A group with a third of all rows, groups with ties, a null group, null values."""
    rng = random.Random(3)
    rows = [("hot", 2020, rng.choice([5.0, 5.0, rng.random() * 100])) for _ in range(3000)] + [("one", 2020, 1.5), ("two", 2021, 1.0), ("two", 2021, 4.0), ("none", 2020, None)]
    rows += [(rng.choice("abcdefgh"), rng.choice([2020, None]), float(rng.randint(1, 9))) for _ in range(6000)] + [(None, 2020, float(k)) for k in range(50)]
    return rows, spark.createDataFrame(rows, "g string, y int, v double")


@pytest.mark.parametrize("hot", [10**6, 5, 0])
def test_quantiles_are_exact_on_both_ways(prices, hot):
    rows, df = prices
    groups = defaultdict(list)
    for g, y, v in rows:
        if v is not None:
            groups[g, y].append(v)
    qs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["y"]): r for r in rows_of(ranks.exact_quantiles(df, ["g", "y"], "v", qs, hot))}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values) and got[k]["q"] == pytest.approx(list(np.quantile(values, qs)), abs=1e-9)
    whole = ranks.exact_quantiles(df, [], "v", [0.5], hot).first()
    assert whole["q"][0] == pytest.approx(statistics.median(v for *_, v in rows if v is not None))
    assert ranks.exact_quantiles(df.where("false"), ["g"], "v", qs, hot).count() == 0


def test_a_hot_group_is_split(prices, spark):
    """No part of the ranked way holds the hot group alone."""
    _, df = prices
    counts = df.where("v is not null").groupBy("g", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.repartitionByRange(4, "g", "_v").withColumn("p", F.spark_partition_id())
    assert parts.where("g = 'hot'").select("p").distinct().count() > 1


def test_positions_are_gapless_and_in_order(spark):
    rows = [(k % 7, None if k % 5 == 0 else f"s{k % 3}", k % 2) for k in range(5000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(7)
    got = sorted(rows_of(ranks.row_position(df, ["a", "b", "c"])), key=lambda r: r["posicao"])
    assert [r["posicao"] for r in got] == list(range(5000))
    keys = [(r["a"], r["b"] or "", r["c"]) for r in got]
    assert keys == sorted(keys) and Counter(keys) == Counter((a, b or "", c) for a, b, c in rows)
    same = spark.createDataFrame([(1,)] * 300, "a int").repartition(3)
    assert sorted(r["posicao"] for r in rows_of(ranks.row_position(same, ["a"]))) == list(range(300))
    assert ranks.row_position(df.where("false"), ["a"]).count() == 0


def test_modes_and_distinct_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", "q", None]), rng.choice([10, 9, 100, None]), rng.choice(["q", "z"])) for _ in range(400)] + [("only", None, None, None)]
    df = spark.createDataFrame(rows, "k string, a string, n int, b string")
    got = {r["k"]: r for r in rows_of(ranks.modes(df, ["k"], {c: F.col(c) for c in ("a", "n", "b")}))}
    counts = {r["k"]: r for r in rows_of(ranks.distinct_counts(df, ["k"], {c: F.col(c) for c in ("a", "n", "b")}))}
    assert set(got) == set(counts) == {"x", "y", None, "only"}
    for k in got:
        for i, c in enumerate(("a", "n", "b"), 1):
            values = Counter(r[i] for r in rows if r[0] == k and r[i] is not None)
            assert got[k][c] == (min(values, key=lambda v: (-values[v], v)) if values else None)
            assert counts[k][c] == len(values)
    plan = analytics.mode_of(df, "k", ["a"])._jdf.queryExecution().toString()
    assert "mode(" not in plan


def test_repeats_of_wide_rows(spark):
    rng = random.Random(9)
    rows = [tuple(rng.choice([None, "a", "b", ""]) for _ in range(3)) + (rng.choice([None, 1.5, 2.0]),) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double")
    flags = {"linha": [F.col(c) for c in df.columns], "par": [F.col("a"), F.col("b")], "chave": [F.col("a")]}
    got = rows_of(repeats.with_repeats(df, flags, {"chave": F.coalesce(F.col("a") != "", F.lit(False))}))
    whole, pair, key = Counter(rows), Counter(r[:2] for r in rows), Counter(r[0] for r in rows if r[0])
    assert Counter(tuple(r.values()) for r in got) == Counter((*r, whole[r] > 1, pair[r[:2]] > 1, key[r[0]] > 1) for r in rows)
    assert repeats.surplus(df).first()["repetidas"] == len(rows) - len(whole)
    assert repeats.surplus(df.where("false")).first()["repetidas"] == 0


def test_values_of_one_digest_are_told_apart(spark, monkeypatch):
    """With a digest of a few values nearly all differ inside a digest, and the flags stay right."""
    monkeypatch.setattr(repeats, "digest", lambda columns: [F.pmod(F.xxhash64(*columns), F.lit(3)), F.lit(0).cast("long")])
    rows = [(k % 40, "x" if k % 3 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = rows_of(repeats.with_repeats(df, {"linha": [F.col("k"), F.col("t")], "k_": [F.col("k")]}))
    assert Counter((r["k"], r["t"], r["linha"], r["k_"]) for r in got) == Counter((*r, Counter(rows)[r] > 1, Counter(k for k, _ in rows)[r[0]] > 1) for r in rows)
    assert repeats.surplus(df).first()["repetidas"] == len(rows) - len(set(rows))


def test_flags_do_not_shuffle_rows(spark):
    from test_operators import fact

    plan = quality.apply_quality(fact(spark, [{}, {}]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def content(df):
    return audit.content_hash(df).first()["hash"]


def test_content_hash_is_that_of_the_multiset(spark):
    base = [(None, "a", 1), ("b", None, 2), ("c", "d", 3)]
    make = lambda rows, kind="int": spark.createDataFrame(rows, f"x string, y string, n {kind}")
    assert content(make(base)) == content(make(base[::-1]).repartition(3))
    others = [[("a", None, 1), *base[1:]], [(None, "a", 2), ("b", None, 1), base[2]], base[:2], [*base[:2], base[1]], [*base, base[0]], [(None, "a", None), *base[1:]], []]
    hashes = [content(make(r)) for r in (base, *others)]
    assert len(set(hashes)) == len(hashes)
    assert content(make(base)) != content(make(base, "long"))
    assert content(make([base[0]] * 3 + [base[1]])) != content(make([base[0]] + [base[1]] * 3))
    nested = lambda v: spark.createDataFrame([(v,)], "s struct<a:string,b:string>")
    assert content(nested((None, "x"))) != content(nested(("x", None)))


def test_random_multisets_differ(spark):
    rng = random.Random(1)
    seen = {}
    for _ in range(12):
        rows = [(rng.choice([None, "a"]), rng.choice([None, "a"])) for _ in range(3)]
        h = content(spark.createDataFrame(rows, "x string, y string"))
        key = tuple(sorted(map(str, rows)))
        assert seen.setdefault(h, key) == key
    assert len(set(seen.values())) == len(seen)


FACT = "familia_material string, codigo_catmat long, unidade_comparavel string, cnpj_fornecedor string, fornecedor_nome string, ano int, data_publicacao string, quantidade double, valor_unitario double, valor_total double"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("F", 1, "UN", "s1", "A", 2020, "2020-01-05", 2.0, 5.0, 10.0), ("F", 1, "UN", "s2", "B", 2020, "2020-06-05", 3.0, 60.0, 180.0),
        ("F", 1, "UN", "s1", "A", 2021, "2021-02-01", 1.0, 4.0, 4.0), ("G", 2, "UN", None, None, 2021, "2021-03-01", 4.0, 1.0, None),
        ("G", 3, "UN", "s3", "C", 2021, "2020-03-01", 4.0, 2.0, 8.0), ("G", 3, None, "s3", "C", 2021, "2021-03-01", 0.0, 3.0, 6.0),
    ]
    return spark.createDataFrame(rows, FACT).withColumn("data_publicacao", F.to_timestamp("data_publicacao"))


def test_price_index_is_over_the_median_of_the_group(facts):
    got = {(r["familia_material"], r["codigo_catmat"]): r for r in rows_of(measures.price_index(facts, ["familia_material", "codigo_catmat"]))}
    assert got["F", 1]["mediana_comparavel"] == 5.0 and got["F", 1]["indice_preco"] == pytest.approx((194 / 6) / 5)
    assert got["G", 2]["mediana_comparavel"] == 1.0 and got["G", 2]["indice_preco"] is None  # no total
    assert got["G", 3]["mediana_comparavel"] is None and got["G", 3]["indice_preco"] is None  # a missing unit is a second unit
    both = {r["familia_material"]: r["mediana_comparavel"] for r in rows_of(measures.price_index(facts, ["familia_material"]))}
    assert both == {"F": 5.0, "G": None}  # two materials with the unit UN have two unit keys


def test_filters_that_a_measure_leaves_out(facts):
    by_name = {(r["familia_material"], r["fornecedor_nome"]): r for r in rows_of(measures.concentration(facts, ["familia_material", "fornecedor_nome"]))}
    assert by_name["F", "A"]["maior_participacao"] == pytest.approx(14 / 194) and by_name["F", "B"]["hhi"] == pytest.approx(10000 * (180 / 194) ** 2)
    assert by_name["G", None]["hhi"] is None and by_name["G", "C"]["hhi"] == 10000
    plain = {r["familia_material"]: r for r in rows_of(measures.concentration(facts, ["familia_material"]))}
    assert plain["F"]["hhi"] == pytest.approx(10000 * ((14 / 194) ** 2 + (180 / 194) ** 2)) and plain["F"]["maior_participacao"] == pytest.approx(180 / 194)
    last = {(r["familia_material"], r["ano"]): r["quantidade_12m"] for r in rows_of(measures.last_months(facts, ["familia_material", "ano"]))}
    # after 1 March 2020, whose own day is out
    assert last == {("F", 2020): 4.0, ("F", 2021): 4.0, ("G", 2021): 4.0}
    sums = measures.in_contexts(facts, ["familia_material", "ano"], {"v": F.col("valor_total")}, {"ano": ("ano",), "tudo": ("familia_material", "ano")})
    assert {(r["familia_material"], r["ano"]): (r["v"], r["v_ano"], r["v_tudo"]) for r in rows_of(sums)} == {
        ("F", 2020): (190.0, 194.0, 208.0), ("F", 2021): (4.0, 194.0, 208.0), ("G", 2021): (14.0, 14.0, 208.0)
    }


def test_duplicate_kinds_and_best_key(spark):
    rows = [("c1", "k1", "2020-01-01", 5.0), ("c1", "k1", "2020-01-01", 5.0), ("c2", " k1", "2020-01-02", 6.0), ("", "", None, 1.0), ("", None, None, 1.0), (None, "k2", None, 1.0), (None, "k3", None, 1.0)]
    df = spark.createDataFrame(rows, "id_compra string, purchase_id string, data_publicacao string, quantidade double")
    got = rows_of(quality.duplicate_kinds(df, "purchase_id"))
    flags = {(r["id_compra"], r["purchase_id"]): (r["dup_confirmada"], r["dup_linha"], r["dup_comercial"], r["compra_varios_itens"]) for r in got}
    assert flags["c1", "k1"] == (True, True, True, True)  # one item written twice is a purchase of many rows
    assert flags["c2", " k1"] == (True, False, False, False)
    assert flags["", ""] == flags["", None] == flags[None, "k2"] == (False, False, False, False)
    assert quality.best_key(df, ["purchase_id", "id_compra", "quantidade"]) == "id_compra"  # two of three, not three of five
    assert quality.best_key(df.where("false"), ["id_compra"]) is None
    assert not any(r["dup_confirmada"] for r in rows_of(quality.duplicate_kinds(df, None)))


def test_upsert_keeps_the_last_row_of_the_last_run(spark, tmp_path):
    path = str(tmp_path / "state")
    table = lambda rows: spark.createDataFrame(rows, "codigo long, posicao int, v string")
    state = lambda: {r["codigo"]: r["v"] for r in rows_of(incremental.read_table(spark, path))}
    incremental.upsert_table(path, table([(k, k, f"a{k}") for k in range(50)] + [(3, 99, "later"), (3, 98, "earlier")]), run=1)
    assert len(state()) == 50 and state()[3] == "later"
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    second = table([(3, 1, "b3"), (70, 2, "b70"), (70, 3, "c70")])
    incremental.upsert_table(path, second, run=2)
    assert state()[3] == "b3" and state()[70] == "c70" and state()[4] == "a4" and len(state()) == 51
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert len(kept) >= len(before) - 2  # only touched partitions are written again
    once = state()
    incremental.upsert_table(path, second, run=2)  # a run that is done again
    incremental.upsert_table(path, table([(3, 500, "old")]), run=1)  # and one that comes late
    assert state() == once
    before_, now = table([(1, 5, "x"), (2, 1, "y")]), table([(2, 1, "z"), (2, 7, "zz"), (2, 3, "q")])
    assert {r["codigo"]: r["v"] for r in rows_of(incremental.upsert(before_, now))} == {1: "x", 2: "zz"}


def test_records_follow_the_order_of_the_page(spark):
    text = [('{"_embedded":{"z":[{"v":1}],"b":[{"v":2}]}}',), ('{"content":[{"v":3}],"resultado":[{"v":4}]}',), ('{"dados":{"q":"[","y":[{"v":5}],"a":[{"v":6}]}}',), ('{"_embedded":[{"v":7}]}',)]
    df = spark.createDataFrame(text, "texto string")

    def read(records):
        return [None if r[0] is None else [int(x.split(":")[1].strip("}")) for x in r[0]] for r in df.select(F.transform(records, lambda x: F.to_json(x))).collect()]

    assert read(bronze.records_of(F.col("texto"))) == [[1], [4], None, None]
    assert read(bronze.audit_records(F.col("texto"))) == [[1], [4], [5], None]
    assert read(bronze.bronze_audit_records(F.col("texto"))) == [[1], [4], [5], [7]]


def test_pages_end_where_a_reader_would_have_stopped(spark):
    page = lambda told, n: "{" + told + '"resultado":[' + ",".join('{"i":%d}' % i for i in n) + "]}"
    rows = [(1, k, page('"totalPaginas":2,', [k, 9])) for k in (1, 2, 3)] + [(2, 1, page("", [1, 2])), (2, 2, page("", [3])), (2, 3, page("", [4, 5]))]
    rows += [(3, 1, page('"totalPaginas":"x",', [1])), (3, 2, page("", [2, 3])), (3, 3, page("", [])), (3, 4, page("", [7, 8]))]
    rows += [(4, 1, page('"totalPaginas":null,"totalPages":"",', [1, 2])), (4, 2, page('"totalPages":0,"total_pages":5,', [3])), (4, 3, page("", [1, 2]))]
    df = spark.createDataFrame(rows, "c int, p int, t string")
    kept = sorted((r["c"], r["p"]) for r in bronze.cut_repeated_pages(df, "c", "p", "t", page_size=2).collect())
    assert kept == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2)]


def test_key_pairs_in_one_pass(spark):
    left = spark.createDataFrame([(" 1", "x"), ("2", "x"), ("2", None), ("nan", "y"), (None, "z")], "a string, b string")
    right = spark.createDataFrame([("2",), ("2 ",), ("3",), ("",)], "r string").withColumn("s", F.lit("x"))
    got = rows_of(joins.key_matches(left, right, [("a", "r"), ("b", "s"), ("missing", "r"), ("b", "r")]))
    assert [tuple(r.values()) for r in got] == [("a", "r", 3, 3, 2, 2, 2, 66.67), ("b", "s", 4, 4, 3, 1, 2, 50.0), ("b", "r", 4, 3, 3, 2, 0, 0.0)]


def test_pilot_ids_follow_the_content(spark):
    import hashlib

    rows = [(5, "c2", None, "i1", "2020-01-01", 1.0, 2.0), (5, "c1", None, "i1", None, 1.0, 2.0), (5, "c1", None, "i1", None, 1.0, 2.0), (6, "c1", "t", "i9", "2020-01-02", 3.0, None), (None, "c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "codigo_catmat int, id_compra string, id_item_compra string, id_compra_item string, data_referencia string, quantidade double, preco_unitario double")
    codes = spark.createDataFrame([(5,), (6,)], "codigo_catmat long")
    schema = spark.createDataFrame([], "purchase_id string, codigo_catmat long, valor_total double, dq_possui_erro boolean, fonte string, outlier_gravidade string").schema
    got = rows_of(typing.pilot_gold(df.repartition(3), codes, schema, "M"))
    parts = ["5|c1||i1||2", "5|c1||i1||3", "5|c2||i1|2020-01-01 00:00:00|4", "6|c1|t|i9|2020-01-02 00:00:00|5"]
    assert sorted(r["purchase_id"] for r in got) == sorted("MED-" + hashlib.sha1(p.encode()).hexdigest()[:20] for p in parts)
    assert {r["fonte"] for r in got} == {"Compras.gov.br"} and all(r["dq_possui_erro"] for r in got)  # no unit


def test_years_of_a_unit_are_those_of_its_rows(spark):
    fact = spark.createDataFrame([("u", 1, "2020-03-01", 2.0), ("u", 2, "2020-05-01", -2.0)], "unidade_modelagem string, codigo_catmat long, data_publicacao string, quantidade double")
    months = [("u", "SEGMENTO", "s", f"{y}-{m:02d}-01", 2.0 if (y, m) == (2020, 3) else 0.0) for y in range(2019, 2023) for m in range(1, 13)]
    units = spark.createDataFrame(months, "unidade_modelagem string, nivel_modelagem string, segmento_modelagem string, mes string, quantidade double")
    w = spark.createDataFrame([("u", 1, 0.25), ("u", 2, 0.75)], "unidade_modelagem string, codigo_catmat long, peso_rateio double")
    r = series.unit_diagnostic(fact, units, w).first().asDict()
    assert (r["anos_ativos"], r["catmats"], r["registros"], r["quantidade_total"], r["meses_ativos"], r["peso_maximo"]) == (1, 2, 2, 0.0, 1, 0.75)
    assert r["percentual_meses_sem_demanda"] == 47 / 48 and r["estrategia_previsao"].startswith("Modelo agregado")


def test_concentration_leaves_errors_out(spark):
    rows = [("2020", "F", "s1", "A", 60.0, False), ("2020", "F", " ", "B", 30.0, False), ("2020", "F", None, None, 10.0, False), ("2020", "F", "s9", "Z", 900.0, True), ("2020", "G", "s1", "A", 0.0, None)]
    df = spark.createDataFrame(rows, "ano string, familia_material string, cnpj_fornecedor string, fornecedor_nome string, valor_total double, dq_possui_erro boolean")
    got = {r["familia_material"]: r for r in rows_of(analytics.supplier_concentration(df))}
    f, g = got["F"], got["G"]
    assert (f["fornecedores"], f["valor_total"], f["hhi"], f["participacao_top1"], f["participacao_top3"]) == pytest.approx((3, 100.0, 4600.0, 0.6, 1.0))
    assert (g["hhi"], g["participacao_top1"], g["classificacao_hhi"]) == (None, 0.0, "BAIXA")
