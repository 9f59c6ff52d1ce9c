"""Flattened-window models from lag sums against numpy on the windows themselves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import lagged as LG

SHAPE = LG.Shape(("f0", "f1", "f2"), lookback=6, ahead=5)


def panel_of(spark, sizes=(240, 170, 20, 8), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        x = np.cumsum(rng.normal(size=(n, 3)), axis=0) * [0.1, 1.0, 5.0] + [0.0, 50.0, 1000.0]
        for i in range(n):
            rows.append(("ABCD"[k], pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), i, *x[i], float(rng.normal())))
    pdf = pd.DataFrame(rows, columns=["symbol", "day", "i", "f0", "f1", "f2", "r"])
    return spark.createDataFrame(pdf).withColumn("day", F.to_date("day")), pdf


def windows(pdf, symbol):
    g = pdf[pdf.symbol == symbol]
    x, r = g[list(SHAPE.features)].to_numpy(), g["r"].to_numpy()
    n = len(g) - SHAPE.reach
    w = np.stack([x[j:j + SHAPE.lookback].ravel() for j in range(n)])
    y = np.array([[r[j + SHAPE.lookback + 1], r[j + SHAPE.lookback + 1:j + SHAPE.lookback + 6].sum()] for j in range(n)])
    return w, y


def direct_ridge(w, y, alpha, lags):
    f = len(SHAPE.features)
    cells = w.reshape(-1, f)
    sd = np.tile(cells.std(0), SHAPE.lookback)
    z = ((w - np.tile(cells.mean(0), SHAPE.lookback)) / sd)[:, -lags * f:]
    zc, yc = z - z.mean(0), y - y.mean(0)
    bz = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    b = np.zeros((w.shape[1], 2))
    b[-lags * f:] = bz / sd[-lags * f:, None]
    return y.mean(0) - w.mean(0) @ b, b


def folds_of(spark, pdf):
    rows = []
    for s, g in pdf.groupby("symbol"):
        n = len(g) - SHAPE.reach
        if n > 60:
            rows += [(s, 0, 0, 60, 60, 90), (s, 1, 0, 90, 90, 120), (s, 2, 30, 120, 120, n)]
    return spark.createDataFrame(rows, "symbol string, fold int, train_lo long, train_hi long, val_lo long, val_hi long"), rows


@pytest.mark.parametrize("block", [64, 4096])
def test_moments_of_every_range(spark, block):
    panel, pdf = panel_of(spark)
    folds, ranges = folds_of(spark, pdf)
    sums = LG.lag_sums(panel, folds, ["symbol"], SHAPE, block=block).toPandas()
    for s, _, lo, hi, vlo, vhi in ranges:
        seg = LG.Segments(sums[sums.symbol == s], SHAPE)
        w, y = windows(pdf, s)
        for a, b in ((lo, hi), (vlo, vhi)):
            n, sx, sy, sxx, sxy, syy = seg.moments(a, b)
            c = w[a:b] - np.tile(seg.centre, SHAPE.lookback)
            assert n == b - a
            for got, want in ((sx, c.sum(0)), (sy, y[a:b].sum(0)), (sxx, c.T @ c), (sxy, c.T @ y[a:b]), (syy, (y[a:b] ** 2).sum(0))):
                assert np.allclose(got, want, rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("lags", [6, 1, 4])
def test_fold_fits_and_scores(spark, lags):
    panel, pdf = panel_of(spark)
    folds, ranges = folds_of(spark, pdf)
    sums = LG.lag_sums(panel, folds, ["symbol"], SHAPE, block=64)
    coefs = LG.fit_folds(sums, folds, ["symbol"], SHAPE, alpha=0.7, lags=lags).cache()
    got = {(r.symbol, r.fold, r.h): r for r in coefs.collect()}
    scored = LG.score(panel, coefs, ["symbol"], SHAPE, block=64).toPandas()
    assert len(got) == 2 * len(ranges)
    for s, fold, lo, hi, vlo, vhi in ranges:
        w, y = windows(pdf, s)
        a, b = direct_ridge(w[lo:hi], y[lo:hi], 0.7, lags)
        pred = a + w[vlo:vhi] @ b
        for h in range(2):
            r = got[s, fold, h]
            assert np.allclose(r.b, b[:, h], rtol=1e-6, atol=1e-9) and r.val_n == vhi - vlo
            assert r.val_mse == pytest.approx(np.mean((y[vlo:vhi, h] - pred[:, h]) ** 2), rel=1e-7)
            rows = scored[(scored.symbol == s) & (scored.fold == fold) & (scored.h == h)].sort_values("j")
            assert rows["j"].tolist() == list(range(vlo, vhi))
            assert np.allclose(rows["y_pred"], pred[:, h], atol=1e-7) and np.allclose(rows["y_true"], y[vlo:vhi, h])
            days = pdf[pdf.symbol == s]["day"].dt.date.tolist()
            assert [d for d in rows["day"]] == days[vlo + SHAPE.lookback:vhi + SHAPE.lookback]


def test_trial_losses(spark):
    panel, pdf = panel_of(spark)
    folds, ranges = folds_of(spark, pdf)
    trials = pd.DataFrame({"trial": [0, 1, 2], "alpha": [0.01, 1.0, 100.0], "n_lags": [6, 1, 3], "w_t1": [0.6, 0.3, 0.5], "w_t5": [0.4, 0.7, 0.5]})
    sums = LG.lag_sums(panel, folds, ["symbol"], SHAPE, block=64)
    got = {(r.symbol, r.fold, r.trial): r.loss for r in LG.trial_losses(sums, folds, ["symbol"], trials, SHAPE).collect()}
    assert len(got) == 3 * len(ranges)
    for s, fold, lo, hi, vlo, vhi in ranges:
        w, y = windows(pdf, s)
        for t in trials.itertuples():
            a, b = direct_ridge(w[lo:hi], y[lo:hi], t.alpha, t.n_lags)
            mse = ((y[vlo:vhi] - a - w[vlo:vhi] @ b) ** 2).mean(0)
            assert got[s, fold, t.trial] == pytest.approx(t.w_t1 * mse[0] + t.w_t5 * mse[1] / 5, rel=1e-7)


def test_counts_and_empty_panels(spark):
    panel, pdf = panel_of(spark)
    got = {r.symbol: r.n for r in LG.sample_counts(panel, ["symbol"], SHAPE).collect()}
    assert got == {"A": 229, "B": 159, "C": 9}
    folds, _ = folds_of(spark, pdf)
    empty = panel.filter("false")
    sums = LG.lag_sums(empty, folds, ["symbol"], SHAPE)
    assert sums.count() == 0 and LG.fit_folds(sums, folds, ["symbol"], SHAPE).count() == 0


# ------------------------------------------------------------------------------------------------ convex fits

def newton(w, y, kind, head, alpha=1.0):
    """The same objective by plain Newton steps with halving on one key's windows."""
    from tessera.operators import convex as CV

    f = len(SHAPE.features)
    cells = w.reshape(-1, f)
    z = (w - np.tile(cells.mean(0), SHAPE.lookback)) / np.tile(cells.std(0), SHAPE.lookback)
    z1 = np.column_stack([np.ones(len(z)), z])
    share = (y > 0).mean()
    penalty = np.diag([0.0] + [alpha] * z.shape[1])

    def value(t):
        s = z1 @ t
        if kind == "huber":
            e = np.abs(y - s) / np.sqrt([1, 5][head])
            return np.where(e <= 1, e * e / 2, e - 0.5).sum() + t @ penalty @ t / 2
        c = np.where(y > 0, (1 - share) / share, 1.0)
        return (c * np.log1p(np.exp(-np.where(y > 0, s, -s)))).sum() + t @ penalty @ t / 2

    t = np.zeros(z1.shape[1])
    for _ in range(200):
        _, g, h = CV.losses(kind, z1 @ t, y, head, (1 - share) / share)
        step = -np.linalg.solve((z1 * h[:, None]).T @ z1 + penalty + 1e-9 * np.eye(len(t)), z1.T @ g + penalty @ t)
        k = 1.0
        while value(t + k * step) > value(t) + 1e-12 and k > 1e-12:
            k /= 2
        t = t + k * step
    assert np.abs(z1.T @ CV.losses(kind, z1 @ t, y, head, (1 - share) / share)[1] + penalty @ t).max() < 1e-5
    b = t[1:] / np.tile(cells.std(0), SHAPE.lookback)
    return t[0] - b @ np.tile(cells.mean(0), SHAPE.lookback), b, value(t) / len(y)


@pytest.mark.parametrize("kind,block", [("huber", 64), ("logistic", 4096)])
def test_convex_fits_equal_numpy(spark, kind, block):
    from tessera.operators import convex as CV

    panel, pdf = panel_of(spark)
    panel = panel.withColumn("r", F.col("r") * 1.5 + 0.2)
    pdf = pdf.assign(r=pdf["r"] * 1.5 + 0.2)
    ranges = spark.createDataFrame([("A", 10, 200), ("B", 0, 150), ("D", 0, 0)], "symbol string, lo long, hi long")
    got = {(r.symbol, r.h): r for r in CV.fit(panel, ranges, ["symbol"], SHAPE, kind, block=block).collect()}
    assert set(got) == {(s, h) for s in "AB" for h in range(2 if kind == "huber" else 1)}
    for (s, h), r in got.items():
        lo, hi = (10, 200) if s == "A" else (0, 150)
        w, y = windows(pdf, s)
        a, b, loss = newton(w[lo:hi], y[lo:hi, h], kind, h)
        assert r.done and r.loss == pytest.approx(loss, rel=1e-8)
        assert np.allclose(w @ np.array(r.b) + r.a, w @ b + a, atol=1e-6)
