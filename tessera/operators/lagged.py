"""Linear models on flattened windows, from lag sums: no window is ever built for a fit.

Sample j of a key has as inputs the ``lookback`` panel rows [j, j + lookback), flattened (oldest row first), and as targets
the next return and the sum of the next five after the window.  The Gram matrix of a range [s, t) of samples is
block-banded: its block (a, b) with lag d = a - b >= 0 is

    sum over u in [s + b, t + b) of x[u + d] x[u]' = P_d(s, t) - (rows [s, s + b)) + (rows [t, t + b)),

so the ``lookback`` lag sums P_d of a range and the ``lookback`` - 1 rows after both its ends give all of it.  Ranges are cut at
every fold boundary into segments; one pass over the panel sums the segments, and any fold, number of lags, penalty and
horizon is solved from these sums.  Inputs are centred by their key's mean before they are multiplied, which leaves the
solution unchanged (there is an intercept) and keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from . import series as S
from .models import sse_from_sums


@dataclass(frozen=True)
class Shape:
    """Inputs of a sample: ``features`` of ``lookback`` rows; targets reach ``ahead`` rows beyond the row after the window."""

    features: tuple[str, ...]
    lookback: int = 30
    ahead: int = 5
    ret: str = "r"

    @property
    def reach(self) -> int:
        return self.lookback + self.ahead

    @property
    def inputs(self) -> int:
        return self.lookback * len(self.features)

    def targets(self, r: np.ndarray) -> np.ndarray:
        """(next return, sum of the next ``ahead``) of the samples that begin at each row but the last ``reach``."""
        c = np.concatenate([[0.0], np.cumsum(r)])
        m = len(r) - self.reach
        first = np.arange(max(m, 0)) + self.lookback + 1
        return np.stack([r[first], c[first + self.ahead] - c[first]], axis=1)

    def flat(self, x: np.ndarray, n: int) -> np.ndarray:
        """Flattened windows of the first ``n`` samples."""
        view = np.lib.stride_tricks.sliding_window_view(x, self.lookback, axis=0)[:n]
        return view.transpose(0, 2, 1).reshape(n, -1)


def sample_counts(panel: DataFrame, keys: Sequence[str], shape: Shape) -> DataFrame:
    """(keys, n): how many samples each key has; keys without any are left out."""
    return panel.groupBy(*keys).agg((F.count(F.lit(1)) - shape.reach).alias("n")).filter("n > 0")


def blocks(panel: DataFrame, keys: Sequence[str], shape: Shape, block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Panel rows per block, each block with the rows its last samples still need."""
    return S.halo(panel, before=0, after=shape.reach, block=block)


def centres(panel: DataFrame, keys: Sequence[str], shape: Shape) -> DataFrame:
    return panel.groupBy(*keys).agg(F.array(*[F.avg(c) for c in shape.features]).alias("centre"))


# ------------------------------------------------------------------ lag sums

def _pack(x: np.ndarray, y: np.ndarray, p: int, q: int, lags: int) -> np.ndarray:
    """Lag sums of samples [p, q) of a block: P_0 .. P_(lags-1), x'y per lag, sums of x, y, y'y."""
    own, ys = x[p:q], y[p:q]
    return np.concatenate([*[(x[p + d:q + d].T @ own).ravel() for d in range(lags)], *[(x[p + d:q + d].T @ ys).ravel() for d in range(lags)],
                           own.sum(0), ys.sum(0), (ys * ys).sum(0)])


def lag_sums(panel: DataFrame, folds: DataFrame, keys: Sequence[str], shape: Shape, block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """(keys, bound, n, v, edge, centre): sums of the segment that begins at each fold boundary, and the rows after it.

    ``folds`` has (keys, fold, train_lo, train_hi, val_lo, val_hi).  ``v`` and ``n`` are null at a key's last boundary.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys, lags, names = list(keys), shape.lookback, list(shape.features)
    ends = folds.select(*keys, F.explode(F.array("train_lo", "train_hi", "val_lo", "val_hi")).alias("bound")).distinct()
    listed = ends.groupBy(*keys).agg(F.array_sort(F.collect_list("bound")).alias("_bounds"))  # a few numbers per key
    centre = centres(panel, keys, shape)
    d = panel.select(*keys, "i", shape.ret, *names).join(listed, keys).join(centre, keys)
    d = d.select(*keys, "i", shape.ret, *[(F.col(c) - F.col("centre")[k]).alias(c) for k, c in enumerate(names)],
                 F.when(F.col("i") < F.element_at("_bounds", -1), F.array_max(F.filter("_bounds", lambda b: b <= F.col("i")))).alias("_seg"))
    schema = T.StructType([f for f in d.schema.fields if f.name in keys]
                          + [T.StructField("bound", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf[names].to_numpy(dtype=float), shape.targets(pdf[shape.ret].to_numpy(dtype=float))
        seg = pdf["_seg"].to_numpy(dtype=float)[(pdf[S.BLK] == pdf[S.OWN_BLK]).to_numpy()][:len(y)]
        rows = []
        for s in np.unique(seg[~np.isnan(seg)]):
            at = np.flatnonzero(seg == s)
            p, q = int(at[0]), int(at[-1]) + 1
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "bound": int(s), "n": q - p, "v": _pack(x, y, p, q, lags).tolist()})
        return pd.DataFrame(rows, columns=schema.names)

    parts = blocks(d, keys, shape, block).groupBy(*keys, S.BLK).applyInPandas(partial, schema)
    sums = (parts.groupBy(*keys, "bound").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("v")).alias("_s"))
            .select(*keys, "bound", "n", vector_to_array("_s").alias("v")))
    # The rows after each boundary: lookback - 1 of them.
    near = d.join(ends, keys).filter((F.col("i") >= F.col("bound")) & (F.col("i") < F.col("bound") + lags - 1))
    edge = near.groupBy(*keys, "bound").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*names).alias("x")))), lambda r: r["x"]).alias("edge"))
    return ends.join(sums, [*keys, "bound"], "left").join(edge, [*keys, "bound"], "left").join(centre, keys)


class Segments:
    """Lag sums of one key; ``moments(lo, hi)`` are the sums of any range between two boundaries."""

    def __init__(self, rows: pd.DataFrame, shape: Shape):
        self.shape, self.centre = shape, np.asarray(rows["centre"].iloc[0], dtype=float)
        rows = rows.sort_values("bound")
        self.bounds = rows["bound"].astype(int).tolist()
        self.n = [0 if v is None or n != n else int(n) for n, v in zip(rows["n"], rows["v"])]
        self.v = [None if v is None else np.asarray(v, dtype=float) for v in rows["v"]]
        self.edge = {b: np.array([list(r) for r in e], dtype=float).reshape(-1, len(shape.features)) if e is not None else np.zeros((0, len(shape.features)))
                     for b, e in zip(self.bounds, rows["edge"])}
        self._kept: dict = {}

    def moments(self, lo: int, hi: int):
        """(n, sum x, sum y, x x', x y', sum y y) over the flattened windows of samples [lo, hi), or None without samples."""
        if (lo, hi) not in self._kept:
            self._kept[lo, hi] = self._moments(lo, hi)
        return self._kept[lo, hi]

    def _moments(self, lo: int, hi: int):
        lags, f = self.shape.lookback, len(self.shape.features)
        inside = [k for k, b in enumerate(self.bounds) if lo <= b < hi and self.v[k] is not None]
        if not inside or hi not in self.edge or lo not in self.edge:
            return None
        n, v = float(sum(self.n[k] for k in inside)), sum(self.v[k] for k in inside)
        cut = np.cumsum([lags * f * f, lags * f * 2, f, 2])
        lag, xy, sx, sy, syy = np.split(v, cut)
        lag, xy = lag.reshape(lags, f, f), xy.reshape(lags, f, 2)
        first, last = self.edge[lo], self.edge[hi]
        gram = np.empty((lags, f, lags, f))
        for d in range(lags):
            # Row b: what the first b products after a boundary add up to.
            steps = [np.concatenate([np.zeros((1, f, f)), np.cumsum(e[d:lags - 1, :, None] * e[:lags - 1 - d, None, :], axis=0)]) for e in (first, last)]
            band = lag[d] - steps[0] + steps[1]
            b = np.arange(lags - d)
            gram[b + d, :, b, :] = band
            gram[b, :, b + d, :] = band.transpose(0, 2, 1)
        edges = [np.concatenate([np.zeros((1, f)), np.cumsum(e[:lags - 1], axis=0)]) for e in (first, last)]
        p = self.shape.inputs
        return n, (sx - edges[0] + edges[1]).ravel(), sy, gram.reshape(p, p), xy.reshape(p, 2), syy


# ------------------------------------------------------------------ ridge

class Ridge:
    """Ridge on windows standardised per feature, for every penalty and number of lags of one training range.

    The scaler is that of the flattened training windows (population deviation of each feature over all their cells); the
    intercept is not penalised.  ``lags`` keeps the latest rows of the window.
    """

    def __init__(self, moments, shape: Shape):
        self.shape, (self.n, self.sx, self.sy, gram, sxy, _) = shape, moments
        f, lags = len(shape.features), shape.lookback
        cells = self.n * lags
        mean = self.sx.reshape(lags, f).sum(0) / cells
        sd = np.sqrt(np.clip(np.diag(gram).reshape(lags, f).sum(0) / cells - mean * mean, 0.0, None))
        self.scale = np.tile(np.where(sd > 0, sd, 1.0), lags)
        self.gram = (gram - np.outer(self.sx, self.sx) / self.n) / np.outer(self.scale, self.scale)
        self.cross = (sxy - np.outer(self.sx, self.sy) / self.n) / self.scale[:, None]
        self._kept: dict = {}

    def fit(self, alpha: float, lags: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(intercepts, coefficients) on centred inputs, all ``lookback`` rows long (zero before the lags)."""
        k = self.shape.inputs - len(self.shape.features) * (lags or self.shape.lookback)
        if k not in self._kept:
            value, vector = np.linalg.eigh(self.gram[k:, k:])
            self._kept[k] = np.clip(value, 0.0, None), vector, vector.T @ self.cross[k:]
        value, vector, seen = self._kept[k]
        b = np.zeros((self.shape.inputs, 2))
        b[k:] = (vector @ (seen / (value + alpha)[:, None])) / self.scale[k:, None]
        return (self.sy - self.sx @ b) / self.n, b


def _per_key(segments: DataFrame, folds: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn(Segments, fold rows)`` per key; both tables are a few rows per key."""
    raise_on = segments.groupBy(*keys).cogroup(folds.select(*[F.col(c).alias(c) for c in folds.columns]).groupBy(*keys))
    return raise_on.applyInPandas(fn, schema)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)


def fit_folds(segments: DataFrame, folds: DataFrame, keys: Sequence[str], shape: Shape, alpha: float = 1.0, lags: int | None = None) -> DataFrame:
    """(keys, fold, h, a, b, lo, hi, val_n, val_mse): ridge of every fold's training range for raw inputs; [lo, hi) is its
    validation range and ``val_mse`` the error there (null without samples)."""
    keys = list(keys)
    schema = f"{_key_schema(segments, keys)}, fold {dict(folds.dtypes)['fold']}, h int, a double, b array<double>, lo long, hi long, val_n long, val_mse double"
    columns = [*keys, "fold", "h", "a", "b", "lo", "hi", "val_n", "val_mse"]

    def fit(sums: pd.DataFrame, fl: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(sums) and len(fl):
            seg, base = Segments(sums, shape), {k: sums[k].iloc[0] for k in keys}
            for r in fl.sort_values("train_hi").itertuples():
                train, val = (seg.moments(int(lo), int(hi)) for lo, hi in ((r.train_lo, r.train_hi), (r.val_lo, r.val_hi)))
                if train is None:
                    continue
                a, b = Ridge(train, shape).fit(alpha, lags)
                mse = [None, None] if val is None else sse_from_sums(val, a, b) / val[0]
                raw = a - np.tile(seg.centre, shape.lookback) @ b
                rows += [{**base, "fold": r.fold, "h": h, "a": float(raw[h]), "b": b[:, h].tolist(), "lo": int(r.val_lo), "hi": int(r.val_hi),
                          "val_n": 0 if val is None else int(val[0]), "val_mse": None if val is None else float(mse[h])} for h in range(2)]
        return pd.DataFrame(rows, columns=columns)

    return _per_key(segments, folds, keys, fit, schema)


def trial_losses(segments: DataFrame, folds: DataFrame, keys: Sequence[str], trials: pd.DataFrame, shape: Shape) -> DataFrame:
    """(keys, fold, trial, loss) of every trial (trial, alpha, n_lags, w_t1, w_t5: a small table) on every fold.

    Loss = w_t1 * MSE(next) + w_t5 * MSE(next five) / 5 on the validation range; null where a range has no samples.
    """
    keys = list(keys)
    schema = f"{_key_schema(segments, keys)}, fold {dict(folds.dtypes)['fold']}, trial long, loss double"
    asked = trials[["trial", "alpha", "n_lags", "w_t1", "w_t5"]].to_dict("records")

    def judge(sums: pd.DataFrame, fl: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(sums) and len(fl):
            seg, base = Segments(sums, shape), {k: sums[k].iloc[0] for k in keys}
            for r in fl.itertuples():
                train, val = (seg.moments(int(lo), int(hi)) for lo, hi in ((r.train_lo, r.train_hi), (r.val_lo, r.val_hi)))
                ridge = None if train is None or val is None else Ridge(train, shape)
                for t in asked:
                    loss = None
                    if ridge is not None:
                        mse = sse_from_sums(val, *ridge.fit(float(t["alpha"]), int(t["n_lags"]))) / val[0]
                        loss = float(t["w_t1"] * mse[0] + t["w_t5"] * mse[1] / 5.0)
                    rows.append({**base, "fold": r.fold, "trial": int(t["trial"]), "loss": loss})
        return pd.DataFrame(rows, columns=[*keys, "fold", "trial", "loss"])

    return _per_key(segments, folds, keys, judge, schema)


# ------------------------------------------------------------------ scoring

def score(panel: DataFrame, coefs: DataFrame, keys: Sequence[str], shape: Shape, ids: Sequence[str] = ("fold",), order: str = "day",
          block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """(keys, ids, h, j, day, y_true, y_pred) of the samples [lo, hi) of each row of ``coefs`` (keys, ids, h, a, b, lo, hi).

    ``day`` is that of the row after the window.  A block of the panel meets the coefficients whose range touches it; the
    windows' products are one matrix product per lag.
    """
    keys, ids, names, lags = list(keys), list(ids), list(shape.features), shape.lookback
    rows = blocks(panel.select(*keys, order, "i", shape.ret, *names), keys, shape, block)
    touched = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    met = coefs.filter("hi > lo").select(*keys, *ids, "h", "a", "b", "lo", "hi", F.explode(touched).alias(S.BLK))
    schema = T.StructType([f for f in met.schema.fields if f.name in [*keys, *ids]] + [
        T.StructField("h", T.IntegerType()), T.StructField("j", T.LongType()), panel.schema[order],
        T.StructField("y_true", T.DoubleType()), T.StructField("y_pred", T.DoubleType())])

    def run(pdf: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(models):
            pdf = pdf.sort_values("i")
            x, y = pdf[names].to_numpy(dtype=float), shape.targets(pdf[shape.ret].to_numpy(dtype=float))
            m = min(len(y), int((pdf[S.BLK] == pdf[S.OWN_BLK]).sum()))
            j, day = pdf["i"].to_numpy()[:m], pdf[order].to_numpy()[lags:lags + m]
            for r in models.to_dict("records"):
                w = np.asarray(r["b"], dtype=float).reshape(lags, -1)
                at = np.flatnonzero((j >= r["lo"]) & (j < r["hi"]))
                if not len(at):
                    continue
                p, q = int(at[0]), int(at[-1]) + 1
                pred = r["a"] + sum(x[p + k:q + k] @ w[k] for k in range(lags))
                part = pd.DataFrame({"j": j[p:q], order: day[p:q], "y_true": y[p:q, int(r["h"])], "y_pred": pred})
                out.append(part.assign(**{c: r[c] for c in [*keys, *ids, "h"]}))
        return pd.concat(out)[schema.names] if out else pd.DataFrame([], columns=schema.names)

    return rows.groupBy(*keys, S.BLK).cogroup(met.groupBy(*keys, S.BLK)).applyInPandas(run, schema)


def edge_free_sums(segments: DataFrame, keys: Sequence[str], shape: Shape) -> DataFrame:
    """The lag sums P_d in long form: (keys, bound, lag, f, g, mean) with mean = P_d[f, g] / n, f of the later row."""
    f, names = len(shape.features), F.array(*[F.lit(c) for c in shape.features])
    k = F.col("k")
    return (segments.filter("n is not null").select(*keys, "bound", "n", F.posexplode(F.slice("v", 1, shape.lookback * f * f)).alias("k", "s"))
            .select(*keys, "bound", F.floor(k / (f * f)).cast("int").alias("lag"), F.element_at(names, (F.floor(k / f) % f + 1).cast("int")).alias("f"),
                    F.element_at(names, (k % f + 1).cast("int")).alias("g"), (F.col("s") / F.col("n")).alias("mean")))
