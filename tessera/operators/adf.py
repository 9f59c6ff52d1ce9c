"""Augmented Dickey-Fuller test (constant, AIC lag choice) from Gram sums.

Per key the regressions y = dx_t on [1, x_{t-1}, dx_{t-1..t-p}] share one
sample (t > maxlag) for the lag search, so one sum of all cross products,
added up block by block, gives every candidate fit; the final regression with
the chosen lag adds the few early rows, from the first values of a key (at
most ``maxlag`` + 1).  p-values use MacKinnon's (1994)
response surface, critical values MacKinnon (2010).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series as S

# MacKinnon coefficients for the constant-only case, one variable.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALLP = [2.1659, 1.4412, 0.038269]
TAU_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
CRIT_2010 = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
             "5%": [-2.86154, -2.8903, -4.234, -40.040],
             "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def mackinnon_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    c = TAU_SMALLP if stat <= TAU_STAR else TAU_LARGEP
    z = sum(cj * stat ** j for j, cj in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def mackinnon_crit(nobs: int) -> dict:
    return {k: sum(cj / nobs ** j for j, cj in enumerate(c)) for k, c in CRIT_2010.items()}


def default_maxlag(n: int) -> int:
    m = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    return min(n // 2 - 2, m)


def _ols(xtx, xty, yty, nobs):
    beta = np.linalg.solve(xtx, xty)
    ssr = float(yty - beta @ xty)
    return beta, ssr


def adf(panel: DataFrame, keys: Sequence[str], x: str, i: str = "i", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """ADF statistic, p-value, lag used, nobs and critical values per key (positions ``i`` contiguous)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = list(keys)
    n = panel.groupBy(*keys).agg(F.count(x).alias("_n"), F.min(i).alias("_i0"), F.avg(x).alias("_mean"))
    kmax = default_maxlag(int(n.agg(F.max("_n")).first()[0] or 0))   # never falls with the size
    # The level is centred: with a constant in the regression its statistic does not change, and products stay small.
    d = panel.select(*keys, i, x).join(n, keys).select(*keys, (F.col(i) - F.col("_i0")).alias("_t"), (F.col(x) - F.col("_mean")).alias("_x"), "_n")
    z = kmax + 3                                                       # 1, x_{t-1}, kmax lagged differences, the difference
    upper = np.triu_indices(z)
    part = T.StructType([f for f in d.schema.fields if f.name in keys]
                        + [T.StructField("n_all", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """Products of one block over the rows that every candidate lag can use."""
        pdf = pdf.sort_values("_t")
        t, level, total = pdf["_t"].to_numpy(), pdf["_x"].to_numpy(dtype=float), int(pdf["_n"].iloc[0])
        use = np.flatnonzero((pdf[S.BLK] == pdf[S.OWN_BLK]).to_numpy() & (t >= default_maxlag(total) + 1))
        if not len(use):
            return pd.DataFrame([], columns=part.names)
        dx = np.concatenate([[0.0], np.diff(level)])
        # A lag beyond the key's own maximum may reach before its first row; those columns are never fitted.
        lagged = [np.where(use >= k, dx[np.maximum(use - k, 0)], 0.0) for k in range(1, kmax + 1)]
        rows = np.column_stack([np.ones(len(use)), level[use - 1], *lagged, dx[use]])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n_all": total, "v": (rows.T @ rows)[upper].tolist()}], columns=part.names)

    halo = S.halo(d, before=kmax + 1, after=0, i="_t", block=block)
    parts = halo.groupBy(*keys, S.BLK).applyInPandas(sums, part)
    total = (parts.groupBy(*keys).agg(F.first("n_all").alias("n_all"), Summarizer.sum(array_to_vector("v")).alias("_s"))
             .select(*keys, "n_all", vector_to_array("_s").alias("v")))
    # The first rows, which shorter lags use as well: at most kmax + 1 values a key.
    first = d.filter(F.col("_t") <= kmax).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_t", "_x"))), lambda r: r["_x"]).alias("head"))
    schema = part.fields[:-2] + [T.StructField(c, T.LongType() if c == "nobs" else T.IntegerType() if c == "used_lag" else T.DoubleType())
                                 for c in ("stat", "p_value", "used_lag", "nobs", "crit_1", "crit_5", "crit_10")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = default_maxlag(int(r["n_all"]))
        gram = np.zeros((z, z))
        gram[upper] = np.asarray(r["v"], dtype=float)
        gram = gram + np.triu(gram, 1).T
        nobs = gram[0, 0]

        def information(lag: int) -> float:
            k = lag + 2
            _, ssr = _ols(gram[:k, :k], gram[:k, -1], gram[-1, -1], nobs)
            return nobs * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1) + 2 * k

        lag = min(range(m + 1), key=lambda k: (information(k), k))
        k = lag + 2
        level = np.asarray(r["head"], dtype=float)[:m + 1]
        dx = np.diff(level)
        early = [(np.array([1.0, level[t - 1], *dx[t - 2 - np.arange(lag)]]), dx[t - 1]) for t in range(lag + 1, len(level))]
        g, cross, square = gram[:k, :k].copy(), gram[:k, -1].copy(), gram[-1, -1]
        for row, y in early:
            g, cross, square = g + np.outer(row, row), cross + row * y, square + y * y
        n_used = int(nobs) + len(early)
        beta, ssr = _ols(g, cross, square, n_used)
        stat = float(beta[1] / math.sqrt(ssr / (n_used - k) * np.linalg.inv(g)[1, 1]))
        crit = mackinnon_crit(n_used)
        return pd.DataFrame([{**{c: r[c] for c in keys}, "stat": stat, "p_value": mackinnon_p(stat), "used_lag": lag, "nobs": n_used,
                              "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"]}])

    return total.join(first, keys).groupBy(*keys).applyInPandas(solve, T.StructType(schema))
