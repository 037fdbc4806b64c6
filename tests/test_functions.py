"""Known answers for column functions and models."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import keys, models, text, units


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("1.000,00", 1000.0), ("R$ 1.234,5", 1234.5), ("1,234.5", 1234.5), ("3,5", 3.5), ("1.000", 1.0), ("1,234,567", None), ("1d", None),
     ("NaN", None), ("", None), (None, None), ("-2", -2.0), ("1e3", 1000.0)],
)
def test_amounts(spark, raw, want):
    assert one(spark, text.parse_decimal(F.col("v").cast("string")), v=raw) == want


def test_text(spark):
    assert one(spark, text.normalize_text("v"), v="  Medição  ß çñº² ") == "medicao cno2"
    assert one(spark, text.upper_text("v"), v=" Potência, 0,6/1 kV ") == "POTENCIA, 0,6/1 KV"
    assert one(spark, text.clean_text("v"), v=" a\r\n b\t\tc  ") == "a b c"
    assert one(spark, text.clean_text("v"), v="nan") is None
    assert one(spark, text.has_word(F.col("v"), "ATIVA"), v="ENERGIA REATIVA") is False
    assert one(spark, text.parse_bool("v"), v=" Sim ") is True


@pytest.mark.parametrize(
    "short, name, cap, want",
    [("RO", None, 100.0, "RO|CAP=100"), ("UN", "", 1.0, "UN"), ("M", None, 0.0, "M"), (None, "Galão", 3.6, "GL|CAP=3.6"), (None, None, 5.0, None), ("xyz", None, None, "XYZ")],
)
def test_units(spark, short, name, cap, want):
    cols = dict(s=F.lit(short).cast("string"), n=F.lit(name).cast("string"), c=F.lit(cap).cast("double"))
    df = spark.range(1).select(*[v.alias(k) for k, v in cols.items()])
    assert df.select(units.comparable_unit("s", "n", "c")).first()[0] == want


def test_keys(spark):
    df = spark.createDataFrame([(5.0, 1.0), (0.3, 1.0), (1.2, 1.0), (1.0, 0.0)], "p double, m double")
    assert [r[0] for r in df.select(keys.severity("p", "m")).collect()] == ["CRITICO", "ALTO", "MODERADO", "REVISAR"]
    assert one(spark, keys.coverage_score(F.lit(9))) == 10.0 and one(spark, keys.coverage_score(F.lit(0))) == 0.0
    assert one(spark, keys.supplier_key(F.lit(" "), F.lit("ACME"))) == "ACME"
    assert len(one(spark, keys.observation_id(F.lit(None), F.lit("a")))) == 24


def series(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_models(spark):
    a = [0, 5, 0, 0, 7]
    assert one(spark, models.croston_rate(series(a), 0.1)) == pytest.approx(2.352381, abs=1e-6)
    assert one(spark, models.croston_rate(series([0, 0]), 0.1)) == 0
    assert one(spark, models.naive(series(a), 2)) == [7, 7]
    assert one(spark, models.moving_average(3)(series(a), 1)) == [pytest.approx(7 / 3)]
    assert one(spark, models.linear_trend(series(range(10)), 3)) == pytest.approx([10, 11, 12])
    assert one(spark, models.linear_trend(series(range(10, 0, -1)), 12))[-1] == 0
    year = list(range(12))
    assert one(spark, models.seasonal_naive(series([1] * 12 + year), 14)) == [*year, 0, 1]
    assert one(spark, models.two_year_mean(series([100] * 5 + [1] * 12 + [3] * 12), 1)) == [2]
    assert one(spark, models.positive_mean_by_frequency(series(a), 1)) == [pytest.approx(6 * 2 / 5)]
    both = [*year, *year]
    for m in (models.seasonal_profile, models.recent_profile):
        got = one(spark, m(series(both), 12))
        assert sum(got) == pytest.approx(66) and got == sorted(got)
    assert one(spark, models.seasonal_profile(series([0] * 24), 2)) == [0, 0]
