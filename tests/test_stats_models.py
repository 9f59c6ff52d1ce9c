"""Statistics and ridge-from-sums against direct numpy computations."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.operators import stats as ST


def _series(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    r = np.round(rng.standard_t(4, n), 2)
    return spark.createDataFrame(pd.DataFrame({"g": "A", "i": np.arange(n), "r": r})), r


def test_acf_pacf(spark):
    df, r = _series(spark)
    acf = ST.acf(df, ["g"], "r", nlags=10, block=64)
    got = acf.toPandas().sort_values("lag")["acf"].to_numpy()
    x = r - r.mean()
    ref = np.array([np.sum(x[k:] * x[:len(x) - k]) / np.sum(x * x) for k in range(11)])
    assert np.allclose(got, ref, atol=1e-12)
    pac = ST.pacf(acf, ["g"]).toPandas().sort_values("lag")["pacf"].to_numpy()
    for k in range(1, 11):   # last Yule-Walker coefficient of order k
        R = np.array([[ref[abs(a - b)] for b in range(k)] for a in range(k)])
        phi = np.linalg.solve(R, ref[1:k + 1])
        assert pac[k] == pytest.approx(phi[-1], abs=1e-10)


def test_spearman_average_ranks(spark):
    df, r = _series(spark)
    pairs = ST.lag_pairs(df, ["g"], F.abs(F.col("r")), F.abs(F.col("r")), 1, block=32)
    got = ST.spearman(pairs, ["g"], "a", "b").collect()[0].spearman
    a, b = pd.Series(np.abs(r[:-1])), pd.Series(np.abs(r[1:]))
    assert got == pytest.approx(a.rank().corr(b.rank()), abs=1e-12)


def test_wasserstein(spark):
    rng = np.random.default_rng(2)
    u, v = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.3, 1.5, 200), 2)
    du = spark.createDataFrame([("A", float(x)) for x in u], "g string, x double")
    dv = spark.createDataFrame([("A", float(x)) for x in v], "g string, x double")
    got = ST.wasserstein_1d(du, dv, ["g"], "x").collect()[0].wasserstein
    allv = np.sort(np.concatenate([u, v]))
    deltas = np.diff(allv)
    cu = np.searchsorted(np.sort(u), allv[:-1], side="right") / len(u)
    cv = np.searchsorted(np.sort(v), allv[:-1], side="right") / len(v)
    assert got == pytest.approx(np.sum(np.abs(cu - cv) * deltas), abs=1e-12)


def test_normality_matches_formula(spark):
    df, r = _series(spark)
    got = ST.normality(df, ["g"], "r").collect()[0]
    assert got.k2 == pytest.approx(got.z_skew ** 2 + got.z_kurt ** 2)
    assert 0 <= got.p_value <= 1


def test_ridge_from_sums_equals_direct(spark):
    rng = np.random.default_rng(4)
    n, p = 300, 4
    X = rng.normal(size=(n, p)) * [1, 10, 0.1, 100] + [0, 50, 0, 1000]
    y = X @ [0.5, -0.02, 3, 0.001] + rng.normal(size=n)
    pdf = pd.DataFrame(X, columns=[f"x{k}" for k in range(p)]).assign(g="A", j=np.arange(n), y=y, y5=2 * y)
    df = spark.createDataFrame(pdf)
    folds = spark.createDataFrame([("A", 0, 0, 200, 200, 300)], "g string, fold int, train_lo long, train_hi long, val_lo long, val_hi long")
    sums = MD.segment_sums(df, folds, ["g"], [f"x{k}" for k in range(p)], ["y", "y5"])
    c = MD.fit_folds(sums, folds, ["g"], p, 2, alpha=1.0).filter("h = 0").collect()[0]
    Xt, yt = X[:200], y[:200]
    mu, sd = Xt.mean(0), Xt.std(0)
    Z = (Xt - mu) / sd
    bz = np.linalg.solve(Z.T @ Z + np.eye(p), Z.T @ (yt - yt.mean()))
    b = bz / sd
    a = yt.mean() - mu @ b
    assert np.allclose(c.b, b, rtol=1e-8) and c.a == pytest.approx(a, rel=1e-8)
    pred = a + X[200:] @ b
    assert c.val_mse == pytest.approx(np.mean((y[200:] - pred) ** 2), rel=1e-8)


def _adf_direct(x):
    """Direct ADF with constant and AIC lag choice (explicit design matrices)."""
    import math
    from tessera.operators.adf import default_maxlag, mackinnon_p
    n = len(x)
    m = default_maxlag(n)
    dx = np.diff(x)

    def design(lag, start):
        rows = range(start, n)        # positions t with y = dx[t-1]
        Z = np.array([[1.0, x[t - 1]] + [dx[t - 1 - j] for j in range(1, lag + 1)] for t in rows])
        y = np.array([dx[t - 1] for t in rows])
        return Z, y

    best = None
    for lag in range(m + 1):
        Z, y = design(lag, m + 1)
        beta, *_ = np.linalg.lstsq(Z, y, rcond=None)
        ssr = float(np.sum((y - Z @ beta) ** 2))
        nobs = len(y)
        aic = -2 * (-nobs / 2 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)) + 2 * (lag + 2)
        if best is None or (aic, lag) < best:
            best = (aic, lag)
    lag = best[1]
    Z, y = design(lag, lag + 1)
    beta, *_ = np.linalg.lstsq(Z, y, rcond=None)
    res = y - Z @ beta
    s2 = res @ res / (len(y) - Z.shape[1])
    se = math.sqrt(s2 * np.linalg.inv(Z.T @ Z)[1, 1])
    stat = beta[1] / se
    return stat, lag, len(y), mackinnon_p(stat)


@pytest.mark.parametrize("kind", ["stationary", "random_walk"])
def test_adf_matches_direct(spark, kind):
    from tessera.operators.adf import adf
    rng = np.random.default_rng(11)
    e = rng.normal(size=600)
    x = e if kind == "stationary" else np.cumsum(e) + 50
    df = spark.createDataFrame(pd.DataFrame({"g": "A", "i": np.arange(600), "x": x}))
    got = adf(df, ["g"], "x", block=128).collect()[0]
    stat, lag, nobs, p = _adf_direct(x)
    assert got.used_lag == lag and got.nobs == nobs
    assert got.stat == pytest.approx(stat, rel=1e-7)
    assert got.p_value == pytest.approx(p, rel=1e-6)
    assert (got.p_value < 0.05) == (kind == "stationary")


def test_window_ridge_equals_direct(spark):
    """Flattened-window ridge from Summarizer-merged Gram partials equals the explicit fit."""
    rng = np.random.default_rng(9)
    n, L, f = 240, 4, 3
    wins = rng.normal(size=(n, L, f)) * [1.0, 10.0, 0.2] + [0.0, 100.0, 1.0]
    y1 = wins[:, -1, 0] * 0.7 + rng.normal(size=n)
    y5 = wins[:, :, 2].sum(1) + rng.normal(size=n)
    rows = [("A", "train", [[float(v) for v in r] for r in w], float(a), float(b)) for w, a, b in zip(wins, y1, y5)]
    df = spark.createDataFrame(rows, "symbol string, seg string, window array<array<double>>, y_t1 double, y_t5 double")
    gram = MD.window_gram(df.repartition(3), ["symbol"], "seg")
    c = {r.h: r for r in MD.fit_window_ridge(gram, ["symbol"], f, L * f).collect()}
    X = wins.reshape(n, -1)
    flat = wins.reshape(-1, f)
    mu, sd = flat.mean(0), flat.std(0)
    Z = ((wins - mu) / sd).reshape(n, -1)
    for h, y in enumerate((y1, y5)):
        Zc = Z - Z.mean(0)
        bz = np.linalg.solve(Zc.T @ Zc + np.eye(L * f), Zc.T @ (y - y.mean()))
        pred = y.mean() + (Z - Z.mean(0)) @ bz
        got = c[h].a + X @ np.asarray(c[h].b)
        assert np.allclose(got, pred, atol=1e-8)


def test_exact_quantiles_two_level(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 2, 501), 2)
    df = spark.createDataFrame([("A", float(v)) for v in x] + [("B", 1.0)], "g string, x double")
    got = {r.g: r for r in ST.exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.75, 0.9]).collect()}
    for k, p in enumerate([0.25, 0.5, 0.75, 0.9]):
        assert got["A"][f"q{k}"] == pytest.approx(np.percentile(x, p * 100), abs=1e-12)
        assert got["B"][f"q{k}"] == 1.0


def test_stylized_facts_paths_cross_and_within(spark):
    rng = np.random.default_rng(21)
    P, L = 12, 20
    paths = np.round(rng.standard_t(5, (P, L)), 2)
    df = spark.createDataFrame([("A", k, [float(v) for v in paths[k]]) for k in range(P)], "g string, i long, path array<double>")
    cross = ST.stylized_facts_paths(df, ["g"], cross_paths=True, block=64).collect()[0]
    flat = paths.ravel()
    a, b = pd.Series(np.abs(flat[:-1])), pd.Series(np.abs(flat[1:]))
    assert cross.volatility_clustering == pytest.approx(a.rank().corr(b.rank()), abs=1e-12)
    within = ST.stylized_facts_paths(df, ["g"], cross_paths=False, block=64).collect()[0]
    a = pd.Series(np.abs(paths[:, :-1]).ravel()); b = pd.Series(np.abs(paths[:, 1:]).ravel())
    assert within.volatility_clustering == pytest.approx(a.rank().corr(b.rank()), abs=1e-12)


def test_walk_forward_embargo(spark):
    from tessera.operators import splits as SP
    d = spark.createDataFrame([("A", 2068)], "symbol string, n long")
    f = SP.walk_forward(d, ["symbol"], embargo=5).orderBy("fold").collect()
    assert [r.train_hi for r in f] == [1235, 1373, 1511, 1649, 1787] and f[0].val_lo == 1240


def test_ranks_of_values_in_one_bucket_and_of_huge_values(spark):
    """Ranges follow the data: values closer than any fixed bucket width, and values over a million, are dealt alike."""
    rng = np.random.default_rng(12)
    for scale, shift in ((1e-9, 0.5), (1e9, -3e6)):
        a = np.round(rng.normal(size=3000), 2) * scale + shift
        b = a + rng.normal(size=3000) * scale
        df = spark.createDataFrame(pd.DataFrame({"g": "A", "a": a, "b": b}))
        got = ST.spearman(df, ["g"], "a", "b").collect()[0]
        assert got.n == 3000 and got.spearman == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()), abs=1e-12)
        parts = ST.ranged(df.repartition(4).groupBy("g", "a").count().repartition(7, "a"), ["g"], "a")
        sizes = [r["count"] for r in parts.groupBy(ST.PART).count().collect()]
        assert max(sizes) <= 0.6 * sum(sizes) or len(sizes) == 1
        q = ST.exact_quantiles(df, ["g"], "b", [0.1, 0.5]).collect()[0]
        assert (q.q0, q.q1) == tuple(pytest.approx(np.quantile(b, p), rel=1e-12) for p in (0.1, 0.5))
        w = ST.wasserstein_1d(df.select("g", F.col("a").alias("x")), df.select("g", F.col("b").alias("x")), ["g"], "x").collect()[0].wasserstein
        assert w == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean(), rel=1e-9)


def test_auc_of_scores_outside_the_unit_interval(spark):
    from tessera.operators import metrics as M
    rng = np.random.default_rng(13)
    y = rng.integers(0, 2, 500)
    s = np.round(y + rng.normal(size=500), 1) * 1e5 - 3e6
    got = M.auc_roc(spark.createDataFrame(pd.DataFrame({"g": "A", "y": y, "s": s})), ["g"], "y", "s").collect()[0]
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert got.auc == pytest.approx(want, abs=1e-12) and (got.n_pos, got.n_neg) == (len(pos), len(neg))


def test_drawdowns_from_block_summaries(spark):
    """Months of returns, several columns at once; a curve that is wiped out takes the row-wise scan."""
    from tessera.operators import metrics as M
    rng = np.random.default_rng(14)
    r = rng.normal(0, 3, (400, 3))
    r[200, 2] = -130.0
    days = pd.date_range("2020-01-01", periods=400)
    df = spark.createDataFrame(pd.DataFrame({"g": "A", "day": days, "a": r[:, 0], "b": r[:, 1], "c": r[:, 2]})).withColumn("day", F.to_date("day"))
    for cols in ("ab", "abc"):
        got = M.drawdowns(df, ["g"], {c: F.col(c) for c in cols}).collect()[0]
        for k, c in enumerate(cols):
            curve = np.cumprod(1 + r[:, k] / 100)
            assert got[c] == pytest.approx(((curve / np.maximum.accumulate(curve)) - 1).min() * 100, rel=1e-9)


def test_threshold_sweep_has_no_join_with_the_grid(spark):
    from tessera.operators import metrics as M
    df = spark.createDataFrame([("A", "2020-01-01", 1.0, 0.2)], "g string, day string, y_true double, y_pred double").withColumn("day", F.to_date("day"))
    plan = M.threshold_sweep(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_acf_of_several_series_from_one_pass(spark):
    df, r = _series(spark)
    both = ST.acf_many(df.withColumn("z", F.abs("r") + 90), ["g"], ["r", "z"], nlags=7, block=50).toPandas()
    for c, x in (("r", r), ("z", np.abs(r) + 90)):
        got = both[both.series == c].sort_values("lag")["acf"].to_numpy()
        x = x - x.mean()
        assert np.allclose(got, [np.sum(x[k:] * x[:len(x) - k]) / np.sum(x * x) for k in range(8)], atol=1e-10)
    plan = [len(ST.acf_many(df, ["g"], ["r"], nlags=n)._jdf.queryExecution().analyzed().toString()) for n in (5, 40)]
    assert plan[1] < 1.1 * plan[0]


def test_compare_paths(spark):
    rng = np.random.default_rng(15)
    sets = [np.round(rng.standard_t(5, (9, 20)), 2), np.round(rng.normal(size=(11, 20)), 2)]
    dfs = [spark.createDataFrame([("A", k, [float(v) for v in p]) for k, p in enumerate(s)], "g string, i long, path array<double>") for s in sets]
    got = ST.compare_paths(*dfs, ["g"]).collect()[0]
    flat = [s.ravel() for s in sets]
    x = np.sort(np.concatenate(flat))
    cdf = [np.searchsorted(np.sort(f), x[:-1], side="right") / len(f) for f in flat]
    assert got.wasserstein == pytest.approx(np.sum(np.abs(cdf[0] - cdf[1]) * np.diff(x)), rel=1e-9)
    for name, f in zip(("real", "other"), flat):
        rank = lambda a, b: pd.Series(a).rank().corr(pd.Series(b).rank())
        assert got[f"{name}_vol_clustering"] == pytest.approx(rank(np.abs(f[:-1]), np.abs(f[1:])), abs=1e-10)
        assert got[f"{name}_leverage"] == pytest.approx(rank(f[:-5], np.abs(f[5:])), abs=1e-10)
        c = f - f.mean()
        assert got[f"{name}_excess_kurtosis"] == pytest.approx((c ** 4).mean() / (c ** 2).mean() ** 2 - 3, rel=1e-9)
        assert got[f"{name}_skewness"] == pytest.approx((c ** 3).mean() / (c ** 2).mean() ** 1.5, rel=1e-9)


def test_adf_twin_p_value():
    """The p-value surface of the SQL twin equals the operator's on both sides of the break and in the tails."""
    import duckdb
    from tessera.operators.adf import TAU_MAX, TAU_MIN, TAU_SMALLP, TAU_LARGEP, TAU_STAR, mackinnon_p
    from tessera.plans.q_stats import _NORMAL, _poly
    stats = [-18.5, -6.0, -3.2, -2.0, TAU_STAR, -1.6, -0.4, 0.0, 1.7, 2.7]
    rows = duckdb.sql(f"""SELECT stat, {_NORMAL} AS p FROM (SELECT stat, CASE WHEN stat <= {TAU_STAR} THEN {_poly("stat", TAU_SMALLP)}
      ELSE {_poly("stat", TAU_LARGEP)} END AS q FROM (SELECT CAST(unnest({stats}) AS DOUBLE) AS stat))""").fetchall()
    assert len(rows) == len(stats)
    assert all(TAU_MIN <= t <= TAU_MAX and abs(p - mackinnon_p(t)) < 1e-10 for t, p in rows)
