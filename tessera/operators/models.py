"""Baseline models fitted as Spark jobs from sufficient statistics.

Ridge (sklearn semantics: intercept not penalised, features standardised
with the training rows' population moments per fold) is solved from Gram
sums.  Samples are cut into *fold segments* at every fold boundary, each
sample lies in exactly one segment, so one aggregation gives the sums of
every (symbol, segment); a fold's training sums are a cumulative sum of
segments.  The per-fold solves and the validation losses run on those sums
(a few hundred numbers per group) in ``applyInPandas``; scoring is a
broadcastable coefficient table joined to the rows plus a dot product.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ------------------------------------------------------------------ sums

def gram_aggs(xcols: Sequence[str], ycols: Sequence[str]) -> list[Column]:
    """n, sums of x, y, all x*x (upper triangle), x*y and y*y."""
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.sum(c).alias(f"sx_{j}") for j, c in enumerate(xcols)]
    out += [F.sum(c).alias(f"sy_{h}") for h, c in enumerate(ycols)]
    p = len(xcols)
    for a in range(p):
        for b in range(a, p):
            out.append(F.sum(F.col(xcols[a]) * F.col(xcols[b])).alias(f"sxx_{a}_{b}"))
    for h, yc in enumerate(ycols):
        out += [F.sum(F.col(xc) * F.col(yc)).alias(f"sxy_{j}_{h}") for j, xc in enumerate(xcols)]
        out.append(F.sum(F.col(yc) * F.col(yc)).alias(f"syy_{h}"))
    return out


def segment_sums(samples: DataFrame, folds: DataFrame, keys: Sequence[str], xcols, ycols,
                 j: str = "j") -> DataFrame:
    """Gram sums per (keys, segment) where segments are cut at every fold boundary.

    ``folds`` has (keys, fold, train_lo, train_hi, val_lo, val_hi).  Every
    sample falls in exactly one segment [seg_lo, seg_hi), so expanding folds
    never copy rows; a fold's sums are the sum of its segments.
    """
    folds = folds.select(*[F.col(c).alias(c) for c in folds.columns])
    b = (folds.select(*keys, F.explode(F.array("train_lo", "train_hi", "val_lo", "val_hi")).alias("b"))
              .distinct())
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("b")       # over the boundary table (a few rows per key)
    segs = b.select(*keys, F.col("b").alias("seg_lo"), F.lead("b").over(w).alias("seg_hi")).filter(
        F.col("seg_hi").isNotNull())
    segs = segs.select(*[F.col(k).alias(f"_sk_{k}") for k in keys], "seg_lo", "seg_hi")
    cond = [F.col(k) == F.col(f"_sk_{k}") for k in keys] + [F.col(j) >= F.col("seg_lo"), F.col(j) < F.col("seg_hi")]
    d = samples.select(*keys, j, *xcols, *ycols).join(segs, cond, "inner")
    return d.groupBy(*keys, "seg_lo", "seg_hi").agg(*gram_aggs(xcols, ycols))


def _range(stats: dict, lo: int, hi: int):
    acc = None
    for (a, b), v in stats.items():
        if a >= lo and b <= hi:
            acc = v if acc is None else _add(acc, v)
    return acc


# ------------------------------------------------------------------ algebra on one group

def _unpack(row: pd.Series, p: int, q: int):
    n = float(row["n"])
    sx = np.array([row[f"sx_{j}"] for j in range(p)], dtype=float)
    sy = np.array([row[f"sy_{h}"] for h in range(q)], dtype=float)
    sxx = np.zeros((p, p))
    for a in range(p):
        for b in range(a, p):
            sxx[a, b] = sxx[b, a] = row[f"sxx_{a}_{b}"]
    sxy = np.array([[row[f"sxy_{j}_{h}"] for h in range(q)] for j in range(p)], dtype=float)
    syy = np.array([row[f"syy_{h}"] for h in range(q)], dtype=float)
    return n, sx, sy, sxx, sxy, syy


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def ridge_from_sums(train, alpha: float):
    """sklearn-style ridge on standardised features; returns (a, b) per target: y = a + x.b."""
    n, sx, sy, sxx, sxy, _ = train
    mu = sx / n
    cov = sxx / n - np.outer(mu, mu)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    sd[sd == 0] = 1.0
    zz = n * cov / np.outer(sd, sd)
    ybar = sy / n
    zy = (sxy - n * np.outer(mu, ybar)) / sd[:, None]
    beta_z = np.linalg.solve(zz + alpha * np.eye(len(mu)), zy)
    b = beta_z / sd[:, None]
    a = ybar - mu @ b
    return a, b


def sse_from_sums(val, a, b):
    """Sum of squared errors of y = a + x.b on rows summarised by ``val``."""
    n, sx, sy, sxx, sxy, syy = val
    out = []
    for h in range(len(a)):
        bh = b[:, h]
        out.append(syy[h] - 2 * a[h] * sy[h] - 2 * bh @ sxy[:, h] + n * a[h] ** 2 + 2 * a[h] * (bh @ sx)
                   + bh @ sxx @ bh)
    return np.array(out)


# ------------------------------------------------------------------ fold fits

def fit_folds(seg_sums: DataFrame, folds: DataFrame, keys: Sequence[str], p: int, q: int,
              alpha: float = 1.0) -> DataFrame:
    """Ridge coefficients of every fold (training range) and its validation MSE.

    Cogrouped per key: the segment sums and the fold table of a key meet in
    one small pandas call.  Output (keys, fold, h, a, b array, val_n, val_mse).
    """
    key_schema = ", ".join(f"{k} {t}" for k, t in seg_sums.select(*keys).dtypes)
    fold_t = dict(folds.dtypes)["fold"]
    schema = key_schema + f", fold {fold_t}, h int, a double, b array<double>, val_n long, val_mse double"
    cols = [*keys, "fold", "h", "a", "b", "val_n", "val_mse"]

    def fit(sums: pd.DataFrame, fl: pd.DataFrame) -> pd.DataFrame:
        if sums.empty or fl.empty:
            return pd.DataFrame([], columns=cols)
        stats = {(int(r["seg_lo"]), int(r["seg_hi"])): _unpack(r, p, q) for _, r in sums.iterrows()}
        base = {c: sums[c].iloc[0] for c in keys}
        rows = []
        for _, f in fl.iterrows():
            tr = _range(stats, int(f["train_lo"]), int(f["train_hi"]))
            va = _range(stats, int(f["val_lo"]), int(f["val_hi"]))
            if tr is None:
                continue
            a, b = ridge_from_sums(tr, alpha)
            mse = sse_from_sums(va, a, b) / va[0] if va is not None and va[0] > 0 else [None] * q
            for h in range(q):
                rows.append({**base, "fold": f["fold"], "h": h, "a": float(a[h]), "b": [float(x) for x in b[:, h]],
                             "val_n": int(va[0]) if va is not None else 0,
                             "val_mse": None if mse[h] is None else float(mse[h])})
        return pd.DataFrame(rows, columns=cols)

    fl = folds.select(*[F.col(c).alias(c) for c in folds.columns])   # fresh attribute ids for the cogroup
    return seg_sums.groupBy(*keys).cogroup(fl.groupBy(*keys)).applyInPandas(fit, schema)


def score(rows: DataFrame, coefs: DataFrame, on: Sequence[str], xcols: Sequence[str], out: str = "y_pred") -> DataFrame:
    """y = a + sum_j b[j] * x_j with the coefficients of the matching (keys, fold, h)."""
    j = rows.join(coefs, list(on), "inner")
    dot = F.col("a")
    for k, c in enumerate(xcols):
        dot = dot + F.col("b")[k] * F.col(c)
    return j.withColumn(out, dot)


# ------------------------------------------------------------------ losses

def huber_loss(e: Column, delta: float = 1.0) -> Column:
    a = F.abs(e)
    return F.when(a <= delta, 0.5 * e * e).otherwise(delta * (a - 0.5 * delta))


def two_horizon_loss(e1: Column, e5: Column, w1: float = 0.6, w5: float = 0.4, delta: float = 1.0) -> Column:
    """w1 * Huber(e1) + w5 * Huber(e5 / sqrt(5)) as a per-row expression (average it per group)."""
    return w1 * huber_loss(e1, delta) + w5 * huber_loss(e5 / F.lit(5 ** 0.5), delta)


# ------------------------------------------------------------------ flattened windows

def window_gram(samples: DataFrame, keys: Sequence[str], seg: str, window: str = "window",
                ycols: Sequence[str] = ("y_t1", "y_t5")) -> DataFrame:
    """Gram sums of the flattened windows (p = L x f columns) per (keys, seg).

    Each Arrow batch folds its rows into one partial vector per group
    (sums of w, y, the upper triangle of w w', w y and y^2); the partials are
    added element-wise by ``Summarizer.sum`` (a partial aggregate), so no row
    and no per-row matrix ever leaves its task.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from pyspark.sql import types as T
    keys = list(keys)
    ys = list(ycols)
    out_fields = [f for f in samples.schema.fields if f.name in keys + [seg]]
    schema = T.StructType(out_fields + [T.StructField("n", T.LongType()),
                                        T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for gk, g in pdf.groupby(keys + [seg], sort=False):
                W = np.stack([np.concatenate([np.asarray(r, dtype=float) for r in w]) for w in g[window]])
                Y = g[ys].to_numpy(dtype=float)
                iu = np.triu_indices(W.shape[1])
                v = np.concatenate([W.sum(0), Y.sum(0), (W.T @ W)[iu], (W.T @ Y).ravel(), (Y * Y).sum(0)])
                row = dict(zip(keys + [seg], gk if isinstance(gk, tuple) else (gk,)))
                row.update(n=len(g), v=v.tolist())
                yield pd.DataFrame([row])

    part = samples.select(*keys, seg, window, *ys).mapInPandas(run, schema)
    return (part.groupBy(*keys, seg)
                .agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("v")).alias("_s"))
                .select(*keys, seg, "n", vector_to_array("_s").alias("v")))


def unpack_window_gram(n: float, v: np.ndarray, p: int, q: int):
    k = 0
    sx = v[k:k + p]; k += p
    sy = v[k:k + q]; k += q
    m = p * (p + 1) // 2
    S = np.zeros((p, p))
    S[np.triu_indices(p)] = v[k:k + m]; k += m
    S = S + S.T - np.diag(np.diag(S))
    sxy = v[k:k + p * q].reshape(p, q); k += p * q
    syy = v[k:k + q]
    return n, sx, sy, S, sxy, syy


def window_ridge_from_sums(stats, n_feat: int, alpha: float = 1.0):
    """Ridge on windows standardised per feature (population moments of the flattened
    training windows), intercept fitted: y = a + w.b on raw flattened windows.

    The scaler's mean cancels under the intercept's centring, so only the
    per-feature std enters (through the penalty)."""
    n, sx, sy, S, sxy, _ = stats
    p = len(sx)
    L = p // n_feat
    f_of = np.arange(p) % n_feat
    cnt = n * L
    mu = np.array([sx[f_of == f].sum() / cnt for f in range(n_feat)])
    ex2 = np.array([np.diag(S)[f_of == f].sum() / cnt for f in range(n_feat)])
    sd = np.sqrt(np.clip(ex2 - mu * mu, 0.0, None))
    sd[sd == 0] = 1.0
    d = sd[f_of]
    czz = (S - np.outer(sx, sx) / n) / np.outer(d, d)
    ybar = sy / n
    czy = (sxy - np.outer(sx, ybar)) / d[:, None]
    bz = np.linalg.solve(czz + alpha * np.eye(p), czy)
    b = bz / d[:, None]
    a = ybar - (sx / n) @ b
    return a, b


def fit_window_ridge(gram: DataFrame, keys: Sequence[str], n_feat: int, p: int, q: int = 2, alpha: float = 1.0,
                     train_seg: str = "train") -> DataFrame:
    """Per key: coefficients (a, b array) for each target from the ``train_seg`` Gram row."""
    key_schema = ", ".join(f"{k} {t}" for k, t in gram.select(*keys).dtypes)
    schema = key_schema + ", h int, a double, b array<double>"
    cols = [*keys, "h", "a", "b"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        v = np.asarray(r["v"], dtype=float)
        a, b = window_ridge_from_sums(unpack_window_gram(float(r["n"]), v, p, q), n_feat, alpha)
        return pd.DataFrame([{**{k: r[k] for k in keys}, "h": h, "a": float(a[h]), "b": b[:, h].tolist()}
                             for h in range(q)], columns=cols)

    return gram.filter(F.col("seg") == train_seg).groupBy(*keys).applyInPandas(fit, schema)


def score_windows(rows: DataFrame, coefs: DataFrame, on: Sequence[str], window: str = "window",
                  out: str = "y_pred") -> DataFrame:
    """a + flatten(window) . b, JVM-side (zip_with + aggregate)."""
    j = rows.join(coefs, list(on), "inner")
    prod = F.zip_with(F.flatten(F.col(window)), F.col("b"), lambda x, y: x * y)
    return j.withColumn(out, F.col("a") + F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x))
