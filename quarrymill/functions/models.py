"""Forecast models: an array of monthly demand, oldest first, to an array of ``h`` values of zero or more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[Column, int], Column]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.coalesce(F.try_divide(total(a), F.size(a)), F.lit(0.0))


def last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def flat(value: Column, h: int) -> Column:
    return F.array_repeat(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), h)


def steps(h: int, f: Callable[[Column], Column]) -> Column:
    """f of 0 to h - 1, clipped at zero."""
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.greatest(F.coalesce(f(i), F.lit(0.0)), F.lit(0.0)))


def naive(a: Column, h: int) -> Column:
    return flat(F.try_element_at(a, F.lit(-1)), h)


def historical_mean(a: Column, h: int) -> Column:
    return flat(mean(a), h)


def moving_average(w: int) -> Model:
    return lambda a, h: flat(mean(last(a, w)), h)


def seasonal_naive(a: Column, h: int) -> Column:
    year = last(a, 12)
    return F.when(F.size(a) < 12, historical_mean(a, h)).otherwise(steps(h, lambda i: F.get(year, i % 12)))


def linear_trend(a: Column, h: int) -> Column:
    """Least squares on the position; the mean below six months."""
    n = F.size(a).cast("double")
    mx = (n - 1) / 2
    sxy = F.aggregate(F.transform(a, lambda x, i: (i - mx) * x), F.lit(0.0), lambda s, x: s + x)
    slope = F.try_divide(sxy, n * (n * n - 1) / 12)
    return F.when(F.size(a) < 6, historical_mean(a, h)).otherwise(steps(h, lambda i: mean(a) + slope * (n + i - mx)))


def croston_rate(a: Column, alpha: float) -> Column:
    """Smoothed size over smoothed interval, with the Syntetos-Boylan factor; zero without demand."""
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0).alias("seen"), F.lit(0).alias("pos"))

    def step(s: Column, x: Column) -> Column:
        pos, gap = s["pos"] + 1, (s["pos"] + 1 - s["seen"]).cast("double")
        first = s["seen"] == 0
        return F.when(
            x > 0,
            F.struct(
                F.when(first, x).otherwise(alpha * x + (1 - alpha) * s["d"]).alias("d"),
                F.when(first, gap).otherwise(alpha * gap + (1 - alpha) * s["p"]).alias("p"),
                pos.alias("seen"),
                pos.alias("pos"),
            ),
        ).otherwise(F.struct(s["d"].alias("d"), s["p"].alias("p"), s["seen"].alias("seen"), pos.alias("pos")))

    return F.aggregate(a, zero, step, lambda s: F.coalesce((1 - alpha / 2) * F.try_divide(s["d"], s["p"]), F.lit(0.0)))


def croston(alpha: float) -> Model:
    return lambda a, h: flat(croston_rate(a, alpha), h)


def positive_mean_by_frequency(a: Column, h: int) -> Column:
    active = F.filter(a, lambda x: x > 0)
    return flat(mean(active) * F.try_divide(F.size(active), F.size(a)), h)


def two_year_mean(a: Column, h: int) -> Column:
    """Mean of the last two whole years, counted from the end, by month; all months below one year."""
    years = F.least(F.floor(F.size(a) / 12), F.lit(2)).cast("int")
    recent = F.slice(a, F.greatest(F.size(a) - 12 * years + 1, F.lit(1)), F.greatest(12 * years, F.lit(1)))
    return F.when(years == 0, historical_mean(a, h)).otherwise(flat(mean(recent), h))


def recent_mean(a: Column, h: int) -> Column:
    return flat(mean(last(a, 36)), h)


def _annual(a: Column) -> Column:
    """A year's demand at the level of the last two whole years."""
    return 12 * F.get(two_year_mean(a, 1), F.lit(0))


def _with_profile(a: Column, h: int, raw: Column) -> Column:
    """Annual level spread by a profile of twelve weights, each raised by 0.01."""
    raised = F.transform(raw, lambda x: x + 0.01)
    return steps(h, lambda i: _annual(a) * F.try_divide(F.get(raised, i % 12), total(raised)))


def seasonal_profile(a: Column, h: int) -> Column:
    """Mean of the yearly shares by position, years counted from the end; uniform where no year has demand."""
    n = F.size(a)
    years = F.transform(
        F.sequence(F.lit(1), F.greatest(F.floor(n / 12).cast("int"), F.lit(1))), lambda k: F.slice(a, F.greatest(n - 12 * k + 1, F.lit(1)), F.lit(12))
    )
    active = F.filter(years, lambda y: total(y) > 0)
    shares = F.transform(active, lambda y: F.transform(y, lambda x: x / total(y)))
    uniform = F.array_repeat(F.lit(1 / 12), 12)
    profile = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: mean(F.transform(shares, lambda y: F.get(y, i))))
    return F.when(n < 24, recent_mean(a, h)).otherwise(_with_profile(a, h, F.when(F.size(active) > 0, profile).otherwise(uniform)))


def recent_profile(a: Column, h: int) -> Column:
    """Mean by position in the last 36 months, positions counted from where they begin."""
    recent = last(a, 36)
    by_month = F.transform(
        F.sequence(F.lit(0), F.lit(11)), lambda i: mean(F.filter(recent, lambda x, k: k % 12 == i))
    )
    return F.when(F.size(a) < 24, recent_mean(a, h)).otherwise(_with_profile(a, h, by_month))


#: Models of single materials; the names are fixed values, the first four are for intermittent demand.
POOL: dict[str, Model] = {
    "CROSTON_SBA": croston(0.1),
    "MEDIA_POSITIVA_X_FREQUENCIA": positive_mean_by_frequency,
    "MEDIA_HISTORICA": historical_mean,
    "MEDIA_MOVEL_6M": moving_average(6),
    "INGENUO_ULTIMO_MES": naive,
    "MEDIA_MOVEL_3M": moving_average(3),
    "SAZONAL_12M": seasonal_naive,
    "TENDENCIA_LINEAR": linear_trend,
}
INTERMITTENT = tuple(POOL)[:4]
#: Models of modelling units, simplest first; the names are fixed values.
UNIT_POOL: dict[str, Model] = {
    "CROSTON_SBA": croston(0.2),
    "MEDIA_2_ANOS_UNIFORME": two_year_mean,
    "MEDIA_36_MESES_UNIFORME": recent_mean,
    "SAZONAL_NAIVE_12": seasonal_naive,
    "PERFIL_SAZONAL_HISTORICO": seasonal_profile,
    "PERFIL_SAZONAL_36_MESES": recent_profile,
}
