"""Tail probabilities for test statistics (Arrow-batched UDFs on aggregated rows).

Spark SQL has no ``erf`` / incomplete beta, and these run on one row per
group, so a vectorised pandas UDF is the right tool: the statistics
themselves are computed by built-in aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_sf_scalar(x: float) -> float:
    """P(Z > x) for a standard normal."""
    return 0.5 * math.erfc(x / math.sqrt(2.0))


# Gauss-Legendre nodes of one panel; a tail integral takes PANELS of them.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)
PANELS = 24


def t_cdf_scalar(t: float, df: float) -> float:
    """Student t CDF with ``df`` degrees of freedom.

    With t = sqrt(df) tan(u) the density becomes cos(u)^(df - 1) / B(1/2, df/2), a smooth integrand over a bounded range; the
    tail beyond |t| is integrated by panels, as far as it is above e^-70 of its start.
    """
    theta = math.atan(abs(t) / math.sqrt(df))
    edges = np.linspace(theta, min(math.pi / 2, theta + 12.0 / math.sqrt(df)), PANELS + 1)
    half = np.diff(edges)[:, None] / 2
    u = (edges[:-1, None] + edges[1:, None]) / 2 + half * _NODES
    log_beta = 0.5 * math.log(math.pi) + math.lgamma(df / 2) - math.lgamma((df + 1) / 2)
    log_f = (df - 1) * np.log(np.maximum(np.cos(u), 1e-300))
    tail = float((half * _WEIGHTS * np.exp(log_f - log_beta)).sum())
    return 1.0 - tail if t > 0 else tail


def _nan_safe(fn, *cols):
    out = []
    for vals in zip(*cols):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals):
            out.append(np.nan)
        else:
            out.append(fn(*vals))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_sf(x: pd.Series) -> pd.Series:
    return _nan_safe(norm_sf_scalar, x)


@F.pandas_udf(T.DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nan_safe(t_cdf_scalar, t, df.astype("float64"))
