"""What bounds the time of queries on large tables: code that the JVM compiles, and tables that are derived and read once."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text
from quarrymill.operators import audit, ranks, star, typing
from quarrymill.plans import adapter, catalog, forecasts, layers, reference, selection
from quarrymill.plans.adapter import purchases

#: The JVM interprets methods of more bytes of code.
COMPILED = 8000


def largest_method(df):
    """Bytes of the largest method that Spark makes for the plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        parts = debug.codegenStringSeq(plan)
        return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _flagged(df):
    flags = ("hist_item_repetido", "dq_possui_erro", "dq_duplicidade", "is_price_outlier")
    return df.withColumns({c: F.lit(False) for c in flags} | {"outlier_gravidade": F.lit(None).cast("string")})


def test_fact_is_compiled(spark, sf_dir, tmp_path):
    purchases(spark, sf_dir).write.parquet(str(tmp_path / "p"))
    fact = star.fact_purchases(reference.with_attributes(_flagged(spark.read.parquet(str(tmp_path / "p")))))
    assert largest_method(fact) < COMPILED / 2


def test_fact_reads_no_description(spark, sf_dir, monkeypatch):
    seen, real = [], adapter.cut
    monkeypatch.setattr(adapter, "cut", lambda df, *a: seen.append(set(df.columns)) or real(df, *a))
    catalog.QUERIES["fact_purchases"](spark, sf_dir)
    assert len(seen) == 1 and not {"descricao_item", "familia_material", "fornecedor_nome"} & seen[0]


def test_cleaned_texts_are_what_the_pattern_gives(spark):
    odd = ["".join(p) for n in range(4) for p in itertools.product(" \t\n\r\x0b\fx", repeat=n)]
    words = [a + w + b for w in ("nan", "None", "<NA>", "NaN", "none", "Nones", "<NA>x") for a, b in itertools.product(("", " ", "\t", "  "), repeat=2)]
    df = spark.createDataFrame([(t,) for t in [*odd, *words, None, "texto longo", "dois  brancos", "\u00a0\u2003"]], "t string")
    plain = F.trim(F.regexp_replace("t", r"\s{2,}|[\r\n\t]", " "))
    old = F.when(plain.isin("", "nan", "None", "<NA>"), None).otherwise(plain)
    assert df.where(~text.clean_text("t").eqNullSafe(old)).isEmpty()
    trimmed = F.trim("t")
    assert df.where(~text.present("t").eqNullSafe(F.when(trimmed.isin("", "nan", "None", "<NA>"), None).otherwise(trimmed))).isEmpty()
    assert df.where(~text.in_parts("t").eqNullSafe(F.col("t"))).isEmpty()


@pytest.fixture
def written(monkeypatch):
    """(label, columns, rows) of the tables that are written between steps."""
    seen = []
    for module in (ranks, typing, layers, forecasts):
        real = getattr(module, "cut", None)

        def cut(df, label="cut", real=real):
            out = real(df, label)
            seen.append((label, out.columns, out.count()))
            return out

        if real:
            monkeypatch.setattr(module, "cut", cut)
    return seen


def test_integrated_star_writes_what_its_gate_reads(spark, sf_dir, written):
    got = {r["tabela"]: r for r in catalog.QUERIES["integrated_star"](spark, sf_dir).collect()}
    assert [c for label, c, _ in written if label == "facts"] == [audit.FACT_READ]
    keys = {"fornecedor": "fornecedor_key", "uasg": "uasg_key", "unidade": "unidade_key", "calendario": "data_key"}
    for table, key in keys.items():  # each dimension is written, with as many rows as the query counts
        assert [n for _, c, n in written if c[0] == key and len(c) > 1 and n == got[table]["linhas"]]
    assert (got["aprovado"]["linhas"], got["aprovado"]["codigos"]) == (20, 1)


def test_staging_gate_writes_what_it_reads(spark, sf_dir, written):
    assert catalog.QUERIES["staging_gate"](spark, sf_dir).count() == 20
    facts = [c for _, c, _ in written if "fornecedor_key" in c and "codigo_catmat" in c]
    assert facts == [audit.FACT_READ]


def test_pilot_sorts_rows_of_its_codes_alone(spark, sf_dir, written, monkeypatch):
    calls, real = [], adapter.purchases
    monkeypatch.setattr(selection, "purchases", lambda *a: calls.append(1) or real(*a))
    n = catalog.QUERIES["pilot_history"](spark, sf_dir).count()
    rows, ranges = ([w for w in written if w[0] == label] for label in ("rows", "ranges"))
    whole = real(spark, sf_dir).count()
    assert len(calls) == 1 and [r for *_, r in rows] == [whole] and [r for *_, r in ranges] == [n] and n < whole / 2
    assert not {"quantidade", "descricao_material", "fornecedor_nome"} & set(ranges[0][1])


def test_pilot_positions_count_rows_of_other_codes(spark):
    import hashlib

    rows = [(c, f"c{i}", None, f"i{i}", None, float(i)) for i in range(40) for c in (i % 5 if i % 7 else None,)]
    df = spark.createDataFrame(rows, "codigo_catmat int, id_compra string, id_item_compra string, id_compra_item string, data_referencia string, quantidade double")
    df = df.withColumn("preco_unitario", F.lit(2.0))
    codes = spark.createDataFrame([(1,), (3,), (9,)], "codigo_catmat long")
    schema = spark.createDataFrame([], "codigo_catmat long, purchase_id string, valor_total double").schema
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {("MED-" + hashlib.sha1(f"{r[0]}|{r[1]}||{r[3]}||{k + 1}".encode()).hexdigest()[:20], r[0], r[5] * 2) for k, r in enumerate(ordered) if r[0] in (1, 3)}
    got = typing.pilot_gold(df.repartition(3), codes, schema, "M")
    assert got.columns == schema.names and {(r["purchase_id"], r["codigo_catmat"], r["valor_total"]) for r in got.collect()} == want
    none = typing.pilot_gold(df, codes.where("codigo_catmat = 9"), schema, "M")
    assert none.count() == 0


def test_silver_records_stay_in_place_and_are_compiled(spark, sf_dir, tmp_path):
    layers.raw_records(spark, sf_dir).write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    catalogue = purchases(spark, sf_dir).groupBy(F.col("codigo_catmat").alias("codigo")).agg(F.min("descricao_item").alias("descricao"))
    out = typing.silver(records, catalogue)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert out.columns == typing.SILVER and largest_method(out) < COMPILED / 2


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_silver_has_each_record_once_beyond_a_broadcast(spark, monkeypatch, most):
    from quarrymill.sources import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most)
    records = spark.createDataFrame([("1", "a"), ("1", None), ("x", "b"), (None, ""), ("2", "")], "codigoItemCatalogo string, descricaoItem string")
    catalogue = spark.createDataFrame([(1, "d1", "f"), (1, "d0", "g"), (2, None, "h"), (None, "n", "n")], "codigo long, descricao string, familia_material string")
    got = [tuple(r) for r in typing.silver(records, catalogue).select("codigo_catmat", "descricao_item", "familia_material").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([(1, "a", "g"), (1, "d0", "g"), (None, "b", None), (None, None, None), (2, None, "h")], key=key)


def test_amounts_are_what_the_patterns_give(spark):
    parts = ["R$", " ", ".", ",", "1", "23", "-", "\t", "e5", "x"]
    df = spark.createDataFrame([("".join(p),) for n in range(5) for p in itertools.product(parts, repeat=n)] + [(None,)], "t string")
    t = F.regexp_replace(F.replace(F.col("t"), F.lit("R$"), F.lit("")), r"\s", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    swap = F.translate(F.translate(t, ".", ""), ",", ".")
    both = F.when(comma & dot & last, swap).when(comma & dot, F.translate(t, ",", "")).when(comma, F.translate(t, ",", ".")).otherwise(t)
    number = lambda x: F.when(F.rlike(x, F.lit(text._NUMBER)), x.try_cast("double"))
    df = df.withColumns({"a": number(both), "b": number(F.when(comma, swap).otherwise(t))})
    assert df.where(~text.parse_decimal("t").eqNullSafe(F.col("a")) | ~text.parse_decimal_comma("t").eqNullSafe(F.col("b"))).isEmpty()
    assert df.where("a is not null").count() > 100


def test_upper_text_is_what_the_patterns_give(spark):
    odd = ["".join(p) for n in range(4) for p in itertools.product([" ", "\t", "\x0b", "a", "\u00e7", "\u00c1", "e\u0301", "\u00df", "\u00aa"], repeat=n)]
    df = spark.createDataFrame([(t,) for t in odd] + [(None,)], "t string")
    folded = lambda c: F.regexp_replace(F.translate(c, "".join(text._FOLDS), "".join(text._FOLDS.values())), "[\\u0300-\\u036f]", "")
    t = F.coalesce("t", F.lit(""))
    assert df.where(text.upper_text("t") != F.trim(F.regexp_replace(F.upper(folded(t)), r"\s+", " "))).isEmpty()
    assert df.where(text.normalize_text("t") != F.trim(F.regexp_replace(folded(F.lower(t)), "[^a-z0-9]+", " "))).isEmpty()
