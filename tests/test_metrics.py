"""Metrics, backtests and significance tests against direct numpy definitions."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import probability as P
from tessera.operators import metrics as M


def _preds(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 1.2, n)
    p = 0.3 * y + rng.normal(0, 1, n)
    p[::37] = 0.0
    y[::41] = 0.0
    days = pd.bdate_range("2020-01-01", periods=n)
    pdf = pd.DataFrame({"g": "A", "day": [d.date() for d in days], "y_true": y, "y_pred": p})
    return spark.createDataFrame(pdf), y, p


def _sharpe(r, rf=0.02, per=252):
    ex = r / 100 - rf / per
    return 0.0 if np.std(ex) < 1e-9 else np.mean(ex) / np.std(ex) * np.sqrt(per)


def _sortino(r, rf=0.02, per=252):
    ex = r / 100 - rf / per
    d = ex[ex < 0]
    return np.mean(ex) / (np.std(d) if len(d) else 1e-9) * np.sqrt(per)


def _mdd(r):
    c = np.cumprod(1 + r / 100)
    return float(np.min((c / np.maximum.accumulate(c) - 1) * 100))


def test_backtest_matches_numpy(spark):
    df, y, p = _preds(spark)
    got = M.long_short_backtest(df, ["g"], threshold=0.1).collect()[0]
    sig = np.where(p > 0.1, 1.0, np.where(p < -0.1, -1.0, 0.0))
    s = sig * y
    assert got.strategy_sharpe == pytest.approx(_sharpe(s), rel=1e-9)
    assert got.strategy_sortino == pytest.approx(_sortino(s), rel=1e-9)
    assert got.strategy_max_drawdown == pytest.approx(_mdd(s), rel=1e-9)
    assert got.strategy_total_return == pytest.approx(s.sum(), rel=1e-9)
    assert got.strategy_directional == pytest.approx(np.mean(np.sign(p) == np.sign(y)))
    assert got.bh_sharpe == pytest.approx(_sharpe(y), rel=1e-9)
    assert got.num_trades == int((sig != 0).sum())


def test_pesaran_timmermann(spark):
    df, y, x = _preds(spark)
    got = M.pesaran_timmermann(df, ["g"]).withColumn("p", P.norm_sf(F.col("stat"))).collect()[0]
    n = len(y)
    ph = np.mean(np.sign(x) == np.sign(y)); py = np.mean(y > 0); px = np.mean(x > 0)
    ps = py * px + (1 - py) * (1 - px)
    vh = ps * (1 - ps) / n
    vs = (2 * py - 1) ** 2 * px * (1 - px) / n + (2 * px - 1) ** 2 * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / n ** 2
    stat = (ph - ps) / np.sqrt(vh - vs)
    assert got.stat == pytest.approx(stat, rel=1e-9)
    assert got.p == pytest.approx(0.5 * math.erfc(stat / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("h", [1, 5])
def test_diebold_mariano(spark, h):
    rng = np.random.default_rng(3)
    n = 250
    y = rng.normal(0, 1, n); a = y + rng.normal(0, 0.9, n); b = np.zeros(n)
    days = [d.date() for d in pd.bdate_range("2021-01-01", periods=n)]
    df = spark.createDataFrame(pd.DataFrame({"g": "A", "day": days, "y_true": y, "pred_a": a, "pred_b": b}))
    got = M.diebold_mariano(df, ["g"], h, block=16).collect()[0]
    d = (y - a) ** 2 - (y - b) ** 2
    dc = d - d.mean()
    lr = np.mean(dc ** 2) + 2 * sum(np.mean(dc[k:] * dc[:-k]) for k in range(1, h))
    if lr <= 0:
        lr = np.mean(dc ** 2)
    stat = np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n) * d.mean() / np.sqrt(lr / n)
    assert got.stat == pytest.approx(stat, rel=1e-8)


def test_tail_probabilities():
    # t CDF by numerical integration of the density
    def tpdf(x, v):
        return math.gamma((v + 1) / 2) / (math.sqrt(v * math.pi) * math.gamma(v / 2)) * (1 + x * x / v) ** (-(v + 1) / 2)
    for t, v in [(2.0, 10), (-1.3, 4), (0.5, 30)]:
        xs = np.linspace(-60, t, 400001)
        ref = np.trapezoid([tpdf(x, v) for x in xs[::100]], xs[::100]) if False else None
        grid = np.linspace(-200, t, 2_000_001)
        dens = (1 + grid * grid / v) ** (-(v + 1) / 2) * math.gamma((v + 1) / 2) / (math.sqrt(v * math.pi) * math.gamma(v / 2))
        ref = float(np.trapezoid(dens, grid))
        assert P.t_cdf_scalar(t, v) == pytest.approx(ref, abs=2e-6)
    assert P.norm_sf_scalar(1.96) == pytest.approx(0.0249978951, rel=1e-8)


def test_threshold_sweep_and_recommendation(spark):
    df, y, p = _preds(spark)
    sw = M.threshold_sweep(df, ["g"]).toPandas().set_index("threshold").sort_index()
    for th in M.THRESHOLDS:
        sig = np.where(p > th, 1.0, np.where(p < -th, -1.0, 0.0))
        assert sw.loc[th, "exposure"] == pytest.approx(np.mean(sig != 0))
        assert sw.loc[th, "sharpe"] == pytest.approx(_sharpe(sig * y), rel=1e-9)
    rec = M.recommend_threshold(M.threshold_sweep(df, ["g"]), ["g"]).collect()[0]
    valid = sw[sw["exposure"] >= 0.30]
    assert rec.threshold == (float(valid["sharpe"].idxmax()) if len(valid) else 0.0)


def test_auc_with_ties(spark):
    lab = [1, 0, 1, 1, 0, 0, 1, 0]
    sc = [0.9, 0.9, 0.7, 0.5, 0.5, 0.2, 0.2, 0.1]
    df = spark.createDataFrame([("A", l, s) for l, s in zip(lab, sc)], "g string, label int, score double")
    got = M.auc_roc(df, ["g"], "label", "score").collect()[0].auc
    pos = [s for l, s in zip(lab, sc) if l == 1]; neg = [s for l, s in zip(lab, sc) if l == 0]
    ref = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(ref)


def test_t_cdf_known_values():
    for t, df, want in ((1.0, 1, 0.75), (-1.0, 1, 0.25), (1.0, 2, 0.5 + 1 / (2 * 3 ** 0.5)), (0.0, 7, 0.5), (2.2281388519649385, 10, 0.975),
                        (-2.2281388519649385, 10, 0.025), (1.959963984540054, 1e7, 0.975), (300.0, 1, 1 - math.atan(1 / 300.0) / math.pi)):
        assert P.t_cdf_scalar(t, df) == pytest.approx(want, abs=2e-8 if df > 1e6 else 1e-12)
    assert P.t_cdf_scalar(-40.0, 2) == pytest.approx(0.5 * (1 - 40 / math.sqrt(1602)), rel=1e-9)
