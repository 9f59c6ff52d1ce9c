"""Registry of named queries: a Spark plan and (optionally) its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(key: str, sql: str | None = None):
    """Decorator: ``@register("key", sql)`` for a ``(spark, sf_dir) -> DataFrame``."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def round_half_away(c, digits: int = DIGITS):
    """round(x * 10^d) / 10^d on doubles, half away from zero.

    This is DuckDB's definition of round(DOUBLE, d); Spark's ``round`` rounds
    the exact binary value instead, which differs on products that land on a
    tie.  Using one definition keeps both engines bit-identical.
    """
    m = F.lit(float(10 ** digits))
    return F.round(c.cast("double") * m, 0) / m + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0


def round_sig(c, sig: int = 10):
    """Round to ``sig`` significant digits, scaling only by exact powers of ten
    (divide for large values, multiply for small) so both engines agree."""
    x = c.cast("double")
    e = F.floor(F.log10(F.abs(x)))
    big = F.round(x / F.pow(F.lit(10.0), e), sig - 1) * F.pow(F.lit(10.0), e)
    small = F.round(x * F.pow(F.lit(10.0), -e), sig - 1) / F.pow(F.lit(10.0), -e)
    return F.when(x == 0, F.lit(0.0)).when(e >= 0, big).otherwise(small) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column (both engines round the same columns)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def R(body: str, *cols: str, digits: int = DIGITS, sig: tuple[str, ...] = (), sig_digits: int = 10) -> str:
    """DuckDB: round the named double columns of ``body`` (``sig``: to 10 significant digits)."""
    if not cols and not sig:
        return body
    rep = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in cols]
    for c in sig:
        x = f"CAST({c} AS DOUBLE)"
        e = f"floor(log10(abs({x})))"
        rep.append(f"""CASE WHEN {x} = 0 THEN 0.0 WHEN {e} >= 0
  THEN round({x} / pow(10.0, {e}), {sig_digits - 1}) * pow(10.0, {e})
  ELSE round({x} * pow(10.0, -{e}), {sig_digits - 1}) / pow(10.0, -{e}) END + 0.0 AS {c}""")
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({body}) _r"


def rounded_sig(df: DataFrame, cols, sig: int = 10) -> DataFrame:
    return df.select(*[round_sig(F.col(c), sig).alias(c) if c in cols else F.col(c) for c in df.columns])
