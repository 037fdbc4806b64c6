"""Steps whose volume must not jump where a table of keys no longer fits a broadcast."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import quality, repeats
from quarrymill.sources import scratch


@pytest.fixture
def tight(monkeypatch):
    """No table of more than two rows is broadcast by count."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    rows = [(i, str(i % 700), "x" if i % 3 else None) for i in range(1000)] + [(i, str(i % 700), "y") for i in range(1000, 1010)]
    return rows, scratch.cut(spark.createDataFrame(rows, "i int, a string, b string"))


def test_repeats_beyond_a_broadcast_are_right_and_leave_rows_in_place(spark, tight):
    rows, df = _rows(spark)
    flags = {"chave": [F.col("a")], "linha": [F.col("a"), F.col("b")]}
    out = repeats.with_repeats(df, flags, {"chave": F.col("a") != "5"})
    keys, whole = [r[1] for r in rows], [r[1:] for r in rows]
    want = {r[0]: (r[1] != "5" and keys.count(r[1]) > 1, whole.count(r[1:]) > 1) for r in rows}
    assert {r["i"]: (r["chave"], r["linha"]) for r in out.collect()} == want
    assert out.columns == ["i", "a", "b", "chave", "linha"]
    assert "SortMergeJoin" not in _plan(out) and "hashpartitioning" not in _plan(out)


def test_counts_of_repeated_rows_are_those_of_the_flags(spark, tight):
    _, df = _rows(spark)
    flags = {"linha": [F.col("a"), F.col("b")], "chave": [F.col("a")]}
    only = {"chave": F.col("a") != "5"}
    marked = repeats.with_repeats(df, flags, only).agg(*[F.count_if(k).alias(k) for k in flags]).first()
    assert repeats.repeated_rows(df, flags, only).first() == marked and marked["chave"] > marked["linha"] > 0
    assert repeats.repeated_rows(df.where("false"), flags, only).first() == (0, 0)


def test_duplicate_counts_are_the_report(spark, tight):
    rows = [("p1", 1, "k1"), ("p1", 1, "k1"), ("p1", 2, "k2"), ("", 3, "k3"), ("", 4, " "), (None, 5, None)]
    df = scratch.cut(spark.createDataFrame(rows, "id_compra string, quantidade int, purchase_id string"))
    report = lambda d: sorted(map(tuple, d.collect()))
    assert report(quality.duplicate_counts(df, "purchase_id")) == report(quality.duplicate_report(quality.duplicate_kinds(df, "purchase_id"), "purchase_id"))
    assert set(quality.duplicate_kinds(df, "purchase_id", kinds=("dup_linha",)).columns) == {*df.columns, "dup_linha"}


def test_quality_without_history_has_the_same_errors(spark, sf_dir):
    from quarrymill.plans.adapter import purchases

    df = scratch.cut(purchases(spark, sf_dir))
    with_it, without = quality.apply_quality(df), quality.apply_quality(df, history=False)
    assert set(with_it.columns) - set(without.columns) == {"hist_item_repetido"}
    assert with_it.drop("hist_item_repetido").exceptAll(without).isEmpty()


def test_modes_shuffle_equal_rows_once(spark):
    """Rows of one key and equal values are counted before they are split into columns."""
    from quarrymill.operators import ranks

    df = spark.createDataFrame([("k", "a", "x")] * 3 + [("k", "b", "x"), ("l", None, "y")], "k string, a string, b string")
    out = ranks.modes(df, ["k"], {"a": F.col("a"), "b": F.col("b")})
    assert {tuple(r) for r in out.collect()} == {("k", "a", "x"), ("l", None, "y")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate")  # the lowest aggregation lies below the expansion


def test_clean_text_is_what_two_replacements_give(spark):
    import itertools

    from quarrymill.functions.text import clean_text

    df = spark.createDataFrame([("x" + "".join(p) + "y",) for n in range(5) for p in itertools.product(" \t\n\r\x0b\f", repeat=n)], "t string")
    old = F.trim(F.regexp_replace(F.regexp_replace("t", r"[\r\n\t]+", " "), r"\s{2,}", " "))
    assert df.where(~clean_text("t").eqNullSafe(old)).isEmpty()


def test_staging_gate_derives_purchases_once(spark, sf_dir, monkeypatch):
    from quarrymill.plans import adapter, catalog, forecasts

    calls, real = [], adapter.purchases
    counted = lambda *a: calls.append(1) or real(*a)
    monkeypatch.setattr(adapter, "purchases", counted)
    monkeypatch.setattr(forecasts, "purchases", counted)
    rows = {r["validacao"]: r["aprovado"] for r in catalog.QUERIES["staging_gate"](spark, sf_dir).collect()}
    assert len(rows) == 20 and len(calls) == 1
