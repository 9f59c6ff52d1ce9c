"""Convex fits on flattened windows for all keys at once: damped Newton steps whose sums come from one pass a step.

A head is one fit of one key: a loss, a range of training samples and a target.  Each step scores the blocks of the panel with
the heads that touch them, adds up losses, gradients and curvatures per head (sums merged by a partial aggregate) and moves
every head by its own Newton step, halved as long as the loss does not fall.  Heads that have converged leave the pass.

The objective of a head is ``mean loss + alpha / (2 n) * |b|^2`` over inputs standardised per feature, with a free intercept:

* ``huber``: Huber loss (delta 1) of the residual divided by the square root of the target's horizon;
* ``logistic``: cross entropy of "the next return is positive", positives weighted (1 - p) / p by their training share p.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage
from . import lagged as LG, series as S

# Horizons of the two targets in days, weights of their losses.
HORIZONS, WEIGHTS = (1.0, 5.0), (0.6, 0.4)
TOLERANCE, MAX_STEPS = 1e-9, 60


def losses(kind: str, t: np.ndarray, y: np.ndarray, head: int, weight: float):
    """(loss, derivative, curvature) of every sample by its score t."""
    if kind == "huber":
        s = np.sqrt(HORIZONS[head])
        e = (t - y) / s
        inner = np.abs(e) <= 1
        return np.where(inner, 0.5 * e * e, np.abs(e) - 0.5), np.clip(e, -1, 1) / s, inner / (s * s)
    p = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    up = y > 0
    c = np.where(up, weight, 1.0)
    return c * np.logaddexp(0, np.where(up, -t, t)), c * (p - up), c * p * (1 - p)


def _sums(kind: str, z: np.ndarray, y: np.ndarray, theta: np.ndarray, head: int, weight: float) -> np.ndarray:
    loss, g, h = losses(kind, theta[0] + z @ theta[1:], y, head, weight)
    z = np.column_stack([np.ones(len(z)), z])
    return np.concatenate([[len(z), loss.sum()], z.T @ g, ((z * h[:, None]).T @ z)[np.triu_indices(z.shape[1])]])


def moved(state: dict, v: np.ndarray, alpha: float) -> dict:
    """The head after a step: ``theta`` is the point to look at next, ``best`` the best one so far."""
    theta, best, step = (np.asarray(state[k], dtype=float) for k in ("theta", "best", "step"))
    p, n = len(theta), v[0]
    pull = np.concatenate([[0.0], theta[1:]])
    loss = v[1] / n + alpha / (2 * n) * float(pull @ pull)
    if loss > state["loss"] * (1 + 1e-14) and np.abs(step).max() > 1e-14:
        return {**state, "theta": best + step / 2, "step": step / 2}
    g = v[2:2 + p] / n + alpha / n * pull
    h = np.zeros((p, p))
    h[np.triu_indices(p)] = v[2 + p:] / n
    h = h + np.triu(h, 1).T + np.diag([1e-10] + [alpha / n] * (p - 1))
    step = -np.linalg.solve(h, g)
    return {**state, "theta": theta + step, "best": theta, "step": step, "loss": loss, "done": bool(np.abs(g).max() < TOLERANCE)}


_STATE = [T.StructField("head", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("weight", T.DoubleType()),
          T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("scale", T.ArrayType(T.DoubleType())),
          *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("theta", "best", "step")], T.StructField("loss", T.DoubleType()), T.StructField("done", T.BooleanType())]


def _start(panel: DataFrame, ranges: DataFrame, keys: list[str], shape: LG.Shape, heads: int) -> DataFrame:
    """Heads at zero with the scaler of their flattened training windows and the positives' weight."""
    names = list(shape.features)
    # A panel row stands in as many windows of [lo, hi) as begin at most lookback - 1 rows before it.
    j = panel.join(ranges, keys)
    times = F.greatest(F.lit(0), F.least(F.col("hi") - 1, F.col("i")) - F.greatest(F.col("lo"), F.col("i") - (shape.lookback - 1)) + 1)
    target = F.when((F.col("i") >= F.col("lo") + shape.lookback + 1) & (F.col("i") < F.col("hi") + shape.lookback + 1), (F.col(shape.ret) > 0).cast("double"))
    w = j.withColumn("_w", times.cast("double"))
    n = F.sum("_w")
    agg = w.groupBy(*keys, "lo", "hi").agg(F.avg(target).alias("_p"), *[(F.sum(F.col("_w") * F.col(c)) / n).alias(f"_m{k}") for k, c in enumerate(names)])
    back = w.join(agg, [*keys, "lo", "hi"])
    spread = back.groupBy(*keys, "lo", "hi").agg(
        F.first("_p").alias("_p"), F.array(*[F.first(f"_m{k}") for k in range(len(names))]).alias("centre"),
        F.array(*[F.sqrt(F.sum(F.col("_w") * F.pow(F.col(c) - F.col(f"_m{k}"), 2)) / n) for k, c in enumerate(names)]).alias("scale"))
    zeros = F.array_repeat(F.lit(0.0), shape.inputs + 1)
    return spread.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"), "lo", "hi",
                         F.coalesce(F.try_divide(1 - F.col("_p"), F.col("_p")), F.lit(1.0)).alias("weight"), "centre",
                         F.transform("scale", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0))).alias("scale"),
                         zeros.alias("theta"), zeros.alias("best"), zeros.alias("step"), F.lit(float("inf")).alias("loss"), F.lit(False).alias("done"))


def fit(panel: DataFrame, ranges: DataFrame, keys: Sequence[str], shape: LG.Shape, kind: str, alpha: float = 1.0,
        block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """(keys, h, a, b, loss, done) for raw inputs: the head of every key of ``ranges`` (keys, lo, hi: training samples).

    ``huber`` fits both targets (h 0 and 1), ``logistic`` the direction of the first.  A head that has not converged after
    MAX_STEPS passes keeps its best point and says so in ``done``.  Keys without samples have no row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys, names, lags = list(keys), list(shape.features), shape.lookback
    ranges = ranges.filter("hi > lo").select(*keys, "lo", "hi")
    rows = stage(LG.blocks(panel.select(*keys, "i", shape.ret, *names), keys, shape, block), "convex-blocks")
    heads = stage(_start(panel, ranges, keys, shape, 2 if kind == "huber" else 1), "heads")
    key_fields = [f for f in heads.schema.fields if f.name in keys]
    part = T.StructType([*key_fields, T.StructField("head", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    state = T.StructType([*key_fields, *_STATE])

    def sums(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(asked):
            pdf = pdf.sort_values("i")
            x, y = pdf[names].to_numpy(dtype=float), shape.targets(pdf[shape.ret].to_numpy(dtype=float))
            m = min(len(y), int((pdf[S.BLK] == pdf[S.OWN_BLK]).sum()))
            j = pdf["i"].to_numpy()[:m]
            for r in asked.to_dict("records"):
                at = np.flatnonzero((j >= r["lo"]) & (j < r["hi"]))
                if len(at):
                    z = shape.flat((x - np.asarray(r["centre"])) / np.asarray(r["scale"]), m)[at]
                    v = _sums(kind, z, y[at, int(r["head"])], np.asarray(r["theta"], dtype=float), int(r["head"]), r["weight"])
                    out.append({**{k: r[k] for k in keys}, "head": int(r["head"]), "v": v.tolist()})
        return pd.DataFrame(out, columns=part.names)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0].to_dict()
        v = r.pop("v")
        new = moved(r, np.asarray(v, dtype=float), alpha)
        return pd.DataFrame([{c: list(new[c]) if isinstance(new[c], np.ndarray) else new[c] for c in state.names}])

    for _ in range(MAX_STEPS):
        going = heads.filter("not done")
        if going.isEmpty():
            break
        touched = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
        met = going.select(*keys, "head", "lo", "hi", "weight", "centre", "scale", "theta", F.explode(touched).alias(S.BLK))
        parts = rows.groupBy(*keys, S.BLK).cogroup(met.groupBy(*keys, S.BLK)).applyInPandas(sums, part)
        total = parts.groupBy(*keys, "head").agg(Summarizer.sum(array_to_vector("v")).alias("_s")).select(*keys, "head", vector_to_array("_s").alias("v"))
        new = going.join(total, [*keys, "head"]).groupBy(*keys, "head").applyInPandas(step, state)
        heads = stage(heads.filter("done").unionByName(new), "heads")
    tiled = lambda c: F.flatten(F.array_repeat(c, lags))
    b = F.zip_with(F.slice("best", 2, shape.inputs), tiled("scale"), lambda t, s: t / s)
    out = heads.withColumn("b", b)
    dot = F.aggregate(F.zip_with("b", tiled("centre"), lambda u, c: u * c), F.lit(0.0), lambda acc, u: acc + u)
    return out.select(*keys, F.col("head").alias("h"), (F.element_at("best", 1) - dot).alias("a"), "b", "loss", "done")
