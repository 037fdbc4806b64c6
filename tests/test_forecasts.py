"""Choice of models, bands and forecasts against a plain version, one series at a time."""

import datetime
import math
import random

import numpy as np
import pytest

from quarrymill.operators import backtest, series

BY = ["codigo"]


def croston(a, h, alpha):
    size = gap = None
    last = 0
    for pos, x in enumerate(a, 1):
        if x > 0:
            size, gap = (x, pos - last) if size is None else (alpha * x + (1 - alpha) * size, alpha * (pos - last) + (1 - alpha) * gap)
            last = pos
    return [0.0 if size is None else (1 - alpha / 2) * size / gap] * h


def trend(a, h):
    if len(a) < 6:
        return [np.mean(a)] * h
    slope, start = np.polyfit(range(len(a)), a, 1)
    return [start + slope * (len(a) + i) for i in range(h)]


def seasonal(a, h):
    return [np.mean(a)] * h if len(a) < 12 else [a[-12:][i % 12] for i in range(h)]


def by_frequency(a, h):
    active = [x for x in a if x > 0]
    return [np.mean(active) * len(active) / len(a) if active else 0.0] * h


SINGLE = {
    "INGENUO_ULTIMO_MES": lambda a, h: [a[-1]] * h, "MEDIA_HISTORICA": lambda a, h: [np.mean(a)] * h, "MEDIA_MOVEL_3M": lambda a, h: [np.mean(a[-3:])] * h,
    "MEDIA_MOVEL_6M": lambda a, h: [np.mean(a[-6:])] * h, "SAZONAL_12M": seasonal, "TENDENCIA_LINEAR": trend, "CROSTON_SBA": lambda a, h: croston(a, h, 0.1),
    "MEDIA_POSITIVA_X_FREQUENCIA": by_frequency,
}
FEW = {"MEDIA_HISTORICA", "MEDIA_MOVEL_6M", "CROSTON_SBA", "MEDIA_POSITIVA_X_FREQUENCIA"}


def clip(f):
    return np.maximum(np.asarray(f, float), 0)


def two_years(a):
    years = min(len(a) // 12, 2)
    return np.mean(a) if not years else np.mean(a[-12 * years :])


def spread(a, profile):
    w = np.asarray(profile, float) + 0.01
    return 12 * two_years(a) * w / w.sum()


def profile_full(a):
    if len(a) < 24:
        return [np.mean(a[-36:])] * 12
    blocks = [a[len(a) - 12 * (k + 1) : len(a) - 12 * k] for k in range(len(a) // 12)]
    shares = [np.asarray(b) / sum(b) for b in blocks if sum(b) > 0]
    return spread(a, np.mean(shares, axis=0) if shares else [1 / 12] * 12)


def profile_recent(a):
    if len(a) < 24:
        return [np.mean(a[-36:])] * 12
    r = a[-36:]
    return spread(a, [np.mean(r[i::12]) for i in range(12)])


UNITS = {
    "CROSTON_SBA": lambda a: croston(a, 12, 0.2), "MEDIA_2_ANOS_UNIFORME": lambda a: [two_years(a)] * 12, "MEDIA_36_MESES_UNIFORME": lambda a: [np.mean(a[-36:])] * 12,
    "SAZONAL_NAIVE_12": lambda a: seasonal(a, 12), "PERFIL_SAZONAL_HISTORICO": profile_full, "PERFIL_SAZONAL_36_MESES": profile_recent,
}


def kind_of(a):
    active = [i for i, x in enumerate(a) if x > 0]
    if not active:
        return "SEM_DEMANDA"
    adi = len(a) if len(active) == 1 else np.mean(np.diff(active))
    values = [a[i] for i in active]
    cv2 = (np.std(values, ddof=1) / np.mean(values)) ** 2 if len(values) > 1 else 0.0
    if adi >= 1.32:
        return "IRREGULAR_INTERMITENTE" if cv2 >= 0.49 else "INTERMITENTE"
    return "ERRATICA" if cv2 >= 0.49 else "REGULAR"


def plain_choice(a):
    """(scores by model, forecast by model, figures by model) of those that the series may use."""
    n = len(a)
    folds = 4 if n >= 36 else 3 if n >= 24 else 2 if n >= 15 else 0
    cuts = [n - 3 * k for k in range(1, folds + 1) if n - 3 * k >= 12]
    few = kind_of(a) in ("INTERMITENTE", "IRREGULAR_INTERMITENTE", "SEM_DEMANDA")
    out = {}
    for name, model in SINGLE.items():
        if cuts and (name in FEW or not few):
            y = np.concatenate([a[c : c + 3] for c in cuts])
            f = np.concatenate([clip(model(a[:c], 3)) for c in cuts])
            e = np.abs(y - f)
            wape = e.sum() / y.sum() * 100 if y.sum() > 0 else None
            out[name] = dict(wape=wape, mae=e.mean(), rmse=math.sqrt((e**2).mean()), vies=(f - y).mean(), erro_q80=np.quantile(e, 0.8), erro_q90=np.quantile(e, 0.9), pontos=len(y), janelas=len(cuts))
    return out


def all_series():
    rng = random.Random(11)
    rows = [[0.0] * 40, [0.0] * 30 + [5.0] + [0.0] * 20, [3.0] * 14, [4.0, 0.0] * 8, [float(k) for k in range(60)], [1.0] + [0.0] * 13, [2.0] * 6 + [0.0] * 30]
    for n in (5, 13, 15, 17, 18, 23, 24, 30, 35, 36, 47, 48, 59, 60, 71, 84):
        for p in (0.15, 0.6, 1.0):
            rows.append([round(rng.lognormvariate(2, 0.9), 3) if rng.random() < p else 0.0 for _ in range(n)])
    return rows


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(k, "INDIVIDUAL" if k % 2 else "segmento", a, datetime.date(2024, 12, 1)) for k, a in enumerate(all_series())]
    return spark.createDataFrame(rows, "codigo int, nivel_modelagem string, a array<double>, ultimo_mes date")


def test_chosen_models_and_bands(spark, arrays):
    long = [(k, m, x) for k, a in enumerate(all_series()) for m, x in enumerate(a)]
    months = spark.createDataFrame(long, "codigo int, mes int, quantidade_total double")
    profile = series.intermittency(months, BY)
    a_ = arrays.drop("nivel_modelagem")
    chosen = {r["codigo"]: r.asDict() for r in backtest.choose(a_, profile, BY).collect()}
    ranks = {}
    for r in backtest.performance(a_, profile, BY).collect():
        ranks.setdefault(r["codigo"], {})[r["modelo"]] = r.asDict()
    wide = {}
    for r in backtest.scenarios(backtest.choose(a_, profile, BY), BY).collect():
        wide.setdefault(r["codigo"], []).append(r.asDict())
    for k, a in enumerate(all_series()):
        want, got = plain_choice(a), chosen[k]
        assert set(ranks.get(k, {})) == set(want)
        for name, figures in want.items():
            for c, v in figures.items():
                assert ranks[k][name][c] == (None if v is None else pytest.approx(v, abs=1e-8)), (k, name, c)
        key = lambda m, w=want: (w[m]["wape"] is None, round(w[m]["wape"] or 0, 7), round(w[m]["mae"], 7), round(w[m]["rmse"], 7))
        name = got["modelo_selecionado"]
        if not want:
            assert name == "CROSTON_SBA" and got["faixa"] == 0 and got["janelas"] == 0
            figures = {"wape": None, "janelas": 0}
        else:
            # best up to rounding; where the best forecasts nothing in spite of demand, the best of those that stand in
            best = [m for m in want if key(m) == min(map(key, want))]
            dead = [m for m in best if sum(a) > 0 and clip(SINGLE[m](a, 12)).sum() == 0]
            stand_in = [m for m in want if m in backtest.STAND_IN]
            others = [m for m in stand_in if key(m) == min(map(key, stand_in))] if dead else []
            assert name in [m for m in best if m not in dead] + others
            figures = want[name]
        f = clip(SINGLE[name](a, 12))
        assert got["f"] == pytest.approx(list(f), abs=1e-7)
        active, zeros = sum(x > 0 for x in a), round(100 * sum(x == 0 for x in a) / len(a), 2)
        wape = figures["wape"]
        fair = wape is not None
        level = "BAIXA"
        if fair and len(a) >= 36 and active >= 18 and zeros <= 50 and figures["janelas"] >= 4 and wape <= 35:
            level = "ALTA"
        elif fair and len(a) >= 24 and active >= 8 and figures["janelas"] >= 3 and wape <= 80:
            level = "MEDIA"
        assert got["confianca_previsao"] == level
        band = figures.get("erro_q90" if level == "BAIXA" else "erro_q80", 0.0)
        rows = sorted(wide[k], key=lambda r: r["mes"])
        assert [r["mes"] for r in rows] == [datetime.date(2025, m, 1) for m in range(1, 13)]
        assert [r["previsao_inferior"] for r in rows] == pytest.approx(list(np.maximum(f - band, 0)), abs=1e-7)
        assert [r["previsao_superior"] for r in rows] == pytest.approx(list(f + band), abs=1e-7)


def test_unit_forecasts(arrays):
    by = ["codigo", "nivel_modelagem"]
    scores, rows = {}, {}
    for r in backtest.unit_scores(arrays, by).collect():
        scores.setdefault(r["codigo"], {})[r["modelo"]] = r.asDict()
    for r in backtest.unit_forecast(arrays, by).collect():
        rows.setdefault(r["codigo"], []).append(r.asDict())
    for k, a in enumerate(all_series()):
        n = len(a)
        cuts = sorted({*range(24, n - 11, 12), n - 12}) if n >= 36 else []
        want = {}
        for name, model in UNITS.items() if cuts else ():
            y = [np.asarray(a[c : c + 12]) for c in cuts]
            f = [clip(model(a[:c])) for c in cuts]
            e = np.abs(np.concatenate(y) - np.concatenate(f))
            total = sum(map(sum, y))
            wape = e.sum() / total if total > 0 else None
            bias = [abs(p.sum() - t.sum()) / t.sum() for t, p in zip(y, f, strict=True) if t.sum() > 0]
            relative = e.mean() / max(np.mean(np.concatenate(y)), 1.0)
            zero = sum(t.sum() > 0 and p.sum() <= 0 for t, p in zip(y, f, strict=True))
            score = (relative if wape is None else wape) + 0.25 * (np.mean(bias) if bias else relative) + 0.5 * zero
            want[name] = (len(cuts), wape, score)
            got = scores[k][name]
            assert got["janelas"] == len(cuts) and got["wape"] == (None if wape is None else pytest.approx(wape)) and got["escore"] == pytest.approx(score, abs=1e-9), (k, name)
        assert set(scores.get(k, {})) == set(want)
        best = min((s for *_, s in want.values()), default=None)
        name = next((m for m in UNITS if m in want and want[m][2] <= best * 1.05 + 1e-12), "CROSTON_SBA")
        f = clip(UNITS[name](a))
        if sum(a) > 0 and f.sum() <= 0:
            f = clip(UNITS["CROSTON_SBA"](a))
        windows, wape, _ = want.get(name, (0, None, None))
        active = sum(x > 0 for x in a)
        years = {(2024 * 12 + 11 - (n - 1 - i)) // 12 for i, x in enumerate(a) if x > 0}
        fair = active >= 24 and len(years) >= 4 and windows >= 3 and wape is not None and wape <= 0.75 and k % 2 == 1
        u = min(max((0.75 if wape is None else wape) + 0.35 * max(0, 1 - active / 36), 0.35 if fair else 0.60, 0.25), 1.25)
        got = sorted(rows[k], key=lambda r: r["mes"])
        assert {r["modelo"] for r in got} == {name} and {r["confianca_previsao"] for r in got} == {"MEDIA" if fair else "BAIXA"}, k
        assert got[0]["incerteza"] == pytest.approx(u)
        assert [r["previsao_base"] for r in got] == pytest.approx(list(f), abs=1e-7)
        assert [r["previsao_inferior"] for r in got] == pytest.approx(list(f * max(0, 1 - u)), abs=1e-7)
        assert [r["previsao_superior"] for r in got] == pytest.approx(list(f * (1 + u)), abs=1e-7)
