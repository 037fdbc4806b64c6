"""What queries on purchases write between steps as these grow: needed columns alone, and no price once more for each quantile."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import ranks, series
from quarrymill.plans import adapter, catalog, forecasts, purchases
from quarrymill.sources import scratch


@pytest.fixture
def written(monkeypatch):
    """Labels, columns and rows of the tables that are written between steps."""
    seen, real = [], scratch.cut

    def cut(df, label="cut"):
        out = real(df, label)
        seen.append((label, set(df.columns), out.count()))
        return out

    for module in (ranks, series, adapter, purchases, forecasts):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    return seen


def test_values_of_small_groups_are_not_counted_first(spark, written):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(30)] + [("b", 1.0), ("b", None), (None, 3.0)], "g string, v double")
    want = {("a", 30, 3.0), ("b", 1, 1.0), (None, 1, 3.0)}
    for hot, counted in ((30, 0), (29, 7), (6, 7)):
        written.clear()
        assert {(r["g"], r["n"], r["q"][0]) for r in ranks.exact_quantiles(df, ["g"], "v", [0.5], hot).collect()} == want
        assert sum(n for label, _, n in written if label == "counts") == counted


def test_two_levels_write_no_price_again(spark, sf_dir, written):
    catalog.QUERIES["outliers_two_level"](spark, sf_dir).where(F.col("gravidade") == "X").collect()
    wide = [columns for label, columns, n in written if n > 1000]
    assert len(wide) == 1 and not {"descricao_item", "familia_material", "fornecedor_nome", "uf", "capacidade"} & wide[0]


@pytest.mark.parametrize("name, tables, unread", [
    ("benchmark_rows", 1, {"descricao_item", "fornecedor_nome", "uf", "capacidade"}),
    ("price_outliers", 1, {"descricao_item", "familia_material", "fornecedor_nome", "uf", "capacidade"}),
    ("alloc_mean_forecast", 2, {"descricao_item", "fornecedor_nome", "uf", "capacidade"}),
    ("price_statistics", 2, {"fornecedor_nome", "uf", "capacidade"}),
    ("dup_kinds", 1, {"purchase_id"}),
    ("supplier_hhi", 1, {"descricao_item", "uf", "capacidade"}),
    ("monthly_indicators", 2, {"descricao_item", "fornecedor_nome", "uf", "capacidade"}),
    ("monthly_series", 1, {"fornecedor_nome", "uf", "capacidade"}),
])
def test_rows_are_written_in_the_columns_that_are_read(spark, sf_dir, written, name, tables, unread):
    catalog.QUERIES[name](spark, sf_dir).collect()
    wide = [columns for _, columns, n in written if n > 1000 and "mes" not in columns]
    assert len(wide) == tables and not any(unread & columns for columns in wide)
