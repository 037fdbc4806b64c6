"""What steps shuffle and write between them: no more than the columns that are needed after."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import outliers, quality, repeats
from quarrymill.plans import catalog, purchases
from quarrymill.sources import scratch


@pytest.fixture
def written(monkeypatch):
    """Labels and columns of the tables that are written between steps, with no table of more than two rows broadcast by count."""
    seen, real = [], scratch.cut

    def cut(df, label="cut"):
        seen.append((label, df.columns))
        return real(df, label)

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 2)
    for module in (repeats, outliers, purchases):
        monkeypatch.setattr(module, "cut", cut)
    return seen


def _same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _odd(spark):
    rows = [(i, str(i % 70) if i % 5 else (" " if i % 2 else None), "x" if i % 3 else None, "wide") for i in [*range(100), 7, 10, 15, 20]]
    return scratch.cut(spark.createDataFrame(rows, "i int, a string, b string, c string"))


def test_rows_near_a_repeat_carry_the_kept_columns_alone(spark, written):
    df = _odd(spark)
    flags = {"chave": [F.col("a")], "linha": [F.col(c) for c in df.columns]}
    only = {"chave": F.col("a").isNotNull()}
    narrow = repeats.with_repeats(df, flags, only, ["i"])
    carried = [columns for label, columns in written if label == "marked"]
    assert len(carried) == 2 and all(not {"a", "b", "c"} & set(columns) for columns in carried)
    assert narrow.columns == ["i", "chave", "linha"]
    assert _same_rows(narrow, repeats.with_repeats(df, flags, only).select("i", "chave", "linha"))


@pytest.mark.parametrize("most", [2, 1_000_000])
def test_kept_columns_with_values_of_one_digest(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most)
    df = _odd(spark)
    flags = {"chave": [F.col("a")], "linha": [F.col(c) for c in df.columns]}
    want = repeats.with_repeats(df, flags).select("i", "chave", "linha").collect()
    monkeypatch.setattr(repeats, "digest", lambda columns: [F.pmod(F.xxhash64(*columns), F.lit(3)), F.lit(0).cast("long")])
    assert sorted(repeats.with_repeats(df, flags, keep=["i"]).collect()) == sorted(want)


@pytest.mark.parametrize("most", [2, 1_000_000])
def test_unrepeated_rows_are_those_without_either_flag(spark, monkeypatch, most):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most)
    df = _odd(spark)
    for key in ("a", None):
        want = quality.duplicate_kinds(df.withColumn("id_compra", F.lit("")), key, ["i"], ("dup_confirmada", "dup_linha")).where("not (dup_confirmada or dup_linha)")
        got = quality.unrepeated(df.withColumn("id_compra", F.lit("")), key, ["i", "a"])
        assert got.columns == ["i", "a"] and _same_rows(got, want.select("i", "a")) and not got.isEmpty()


@pytest.mark.parametrize("name", ["measures_by_family", "outliers_raw_unit", "unit_quality"])
def test_purchases_are_not_shuffled_whole_beyond_a_broadcast(spark, sf_dir, written, name):
    catalog.QUERIES[name](spark, sf_dir).collect()
    carried = [set(columns) for label, columns in written if label == "marked"]
    assert carried and not any({"descricao_item", "fornecedor_nome", "capacidade"} & columns for columns in carried)


def test_summary_writes_its_columns_alone(spark, sf_dir, written):
    from quarrymill.operators import analytics

    catalog.QUERIES["exec_summary"](spark, sf_dir).collect()
    assert ("cut", analytics.SUMMARY_COLUMNS) in written
