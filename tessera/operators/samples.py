"""Sliding windows, targets and return paths over a numbered panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series as S


def sliding_samples(panel: DataFrame, lookback: int = 30, h1: int = 1, h5: int = 5,
                    key: str = "symbol", block: int = S.DEFAULT_BLOCK,
                    features: Sequence[str] = (), ret: str = "r") -> DataFrame:
    """Samples ``(symbol, day, i, window, y_t1, y_t5)``.

    Sample i uses feature rows [i-L, i) (ordered arrays, oldest first); y_t1 =
    r[i+h1]; y_t5 = sum r[i+1..i+h5] (cumulative, not the point return).
    Valid i: L <= i < n - max(h1, h5).
    """
    hmax = max(h1, h5)
    d = S.halo(panel, before=lookback, after=hmax, block=block)
    w = S.block_window(key)
    back = w.rowsBetween(-lookback, -1)
    fwd = w.rowsBetween(1, h5)
    tail = w.rowsBetween(1, hmax)
    d = (d.withColumn("window", F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(back))
          .withColumn("y_t1", F.lead(ret, h1).over(w))
          .withColumn("y_t5", F.sum(ret).over(fwd))
          .withColumn("_n_after", F.count(F.lit(1)).over(tail)))
    d = S.own_rows(d).drop(S.BLK)
    return (d.filter((F.col("i") >= lookback) & (F.col("_n_after") == hmax))
             .select(key, "day", "i", "window", "y_t1", "y_t5"))


def targets(panel: DataFrame, h1: int = 1, h5: int = 5, key: str = "symbol",
            block: int = S.DEFAULT_BLOCK, ret: str = "r") -> DataFrame:
    """Targets only: next return and the cumulative return over the next ``h5`` rows."""
    d = S.halo(panel, before=0, after=max(h1, h5), block=block)
    w = S.block_window(key)
    fwd = w.rowsBetween(1, h5)
    d = (d.withColumn("y_t1", F.lead(ret, h1).over(w))
          .withColumn("y_t5", F.when(F.count(ret).over(fwd) == h5, F.sum(ret).over(fwd))))
    return S.own_rows(d).drop(S.BLK)


def return_paths(panel: DataFrame, length: int = 20, key: str = "symbol",
                 block: int = S.DEFAULT_BLOCK, ret: str = "r", drop_last: bool = True) -> DataFrame:
    """Rolling paths ``r[i..i+length)``; with ``drop_last`` the last start
    (i = n-length) is excluded, as in ``range(n - length)``."""
    need = length if drop_last else length - 1
    d = S.halo(panel, before=0, after=need, block=block)
    w = S.block_window(key)
    d = (d.withColumn("path", F.collect_list(ret).over(w.rowsBetween(0, length - 1)))
          .withColumn("_n_after", F.count(F.lit(1)).over(w.rowsBetween(1, need))))
    d = S.own_rows(d).drop(S.BLK)
    return d.filter(F.col("_n_after") == need).select(key, F.col("day").alias("start_day"), "i", "path")
