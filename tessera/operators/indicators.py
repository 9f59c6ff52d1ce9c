"""Technical indicators over a panel of daily bars.

Formulas follow the ``ta`` package (0.10.2) conventions used by the
reference pipeline: RSI with Wilder smoothing (first difference counts as 0,
100 when there are no losses), MACD 12/26/9 with the signal starting at the
first MACD value, Bollinger %B with population std, ATR seeded with the mean
of the first 14 true ranges, simple moving averages null before full.

All bounded windows run per (symbol, block) on a halo copy; the recursive
ones use the block scan of ``series.ewm``.  Input must carry the position
column ``i`` (``series.with_position``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series as S

# Fixed parameters of the reference feature set.
RSI_WINDOW = 14
MACD_FAST, MACD_SLOW, MACD_SIGN = 12, 26, 9
BB_WINDOW, BB_DEV = 20, 2
ATR_WINDOW = 14
SMA_SHORT, SMA_LONG = 20, 50

# Feature order of the reference sample tensors (all columns but the return and OHLCV).
FEATURES = ["vix_close", "rsi_14", "macd", "macd_signal", "macd_diff", "bb_pct",
            "atr_14", "sma_20", "sma_50", "vol_change"]


def _rows(key, lo: int, hi: int):
    return S.block_window(key).rowsBetween(lo, hi)


def log_return(df: DataFrame, key="symbol", price: str = "close", out: str = "r",
               block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """``100 * ln(P_t / P_{t-1})``; null on the first row of each series."""
    d = S.halo(df, before=1, after=0, block=block)
    prev = F.lag(price, 1).over(S.block_window(key))
    return S.own_rows(d.withColumn(out, F.lit(100.0) * F.log(F.try_divide(F.col(price), prev)))).drop(S.BLK)


def sma_expr(key, col: str, n: int):
    w = _rows(key, -(n - 1), 0)
    return F.when(F.count(col).over(w) == n, F.avg(col).over(w))


def _moving(key, cs: str, n: int):
    """Sum of the last ``n`` rows as a difference of running sums (O(1) per row).

    Spark re-aggregates a sliding frame for every row; a running frame is
    incremental and ``lag`` is an offset frame, so this stays linear in the
    window length.  Needs ``n`` halo rows before each block.
    """
    w = S.block_window(key)
    return F.col(cs) - F.coalesce(F.lag(cs, n).over(w), F.lit(0.0))


def bounded_indicators(df: DataFrame, key="symbol", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """One halo window stage: lags, SMA 20/50, Bollinger %B, true range, volume change.

    Moving sums are differences of running sums of values centred on the
    block's first close (keeps the cancellation error near 1e-12).  Leaves
    ``_blk`` in place so the recursive stage reuses the partitioning.
    """
    d = S.halo(df, before=SMA_LONG, after=0, block=block)
    w = S.block_window(key)
    run = w.rowsBetween(S.Window.unboundedPreceding, 0)
    prev_close = F.lag("close", 1).over(w)
    diff = F.col("close") - prev_close
    d = d.withColumn("_c0", F.first("close").over(w.rowsBetween(S.Window.unboundedPreceding, S.Window.unboundedFollowing)))
    d = (d.withColumn("_xc", F.col("close") - F.col("_c0"))
          .withColumn("_tr", F.greatest(F.col("high") - F.col("low"),
                                        F.abs(F.col("high") - prev_close),
                                        F.abs(F.col("low") - prev_close)))
          .withColumn("_up", F.when(diff > 0, diff).otherwise(F.lit(0.0)))
          .withColumn("_dn", F.when(diff < 0, -diff).otherwise(F.lit(0.0)))
          .withColumn("vol_change", F.lit(100.0) * (F.try_divide(F.col("volume"), F.lag("volume", 1).over(w)) - 1))
          .withColumn("_k", F.row_number().over(w)))
    d = (d.withColumn("_s1", F.sum("_xc").over(run))
          .withColumn("_s2", F.sum(F.col("_xc") * F.col("_xc")).over(run))
          .withColumn("_st", F.sum(F.coalesce(F.col("_tr"), F.lit(0.0))).over(run)))
    s20, s50 = _moving(key, "_s1", BB_WINDOW), _moving(key, "_s1", SMA_LONG)
    q20 = _moving(key, "_s2", BB_WINDOW)
    # rows with a full frame: position i >= n - 1 (the halo supplies the rows before)
    full20, full50 = F.col("i") >= BB_WINDOW - 1, F.col("i") >= SMA_LONG - 1
    mean20 = s20 / BB_WINDOW
    var20 = F.greatest(q20 / BB_WINDOW - mean20 * mean20, F.lit(0.0))
    std20 = F.sqrt(var20)
    width = 2 * BB_DEV * std20
    # Differences of running sums never cancel to zero exactly: a flat frame is one without a change in its last 19 steps.
    d = d.withColumn("_sc", F.sum((F.coalesce(diff, F.lit(0.0)) != 0).cast("long")).over(run))
    flat20 = _moving(key, "_sc", BB_WINDOW - 1) == 0
    d = (d.withColumn("sma_20", F.when(full20, F.col("_c0") + mean20))
          .withColumn("sma_50", F.when(full50, F.col("_c0") + s50 / SMA_LONG))
          .withColumn("bb_pct", F.when(full20 & ~flat20 & (width != 0),
                                       F.try_divide(F.col("_xc") - (mean20 - BB_DEV * std20), width)))
          .withColumn("_tr_seed", _moving(key, "_st", ATR_WINDOW) / ATR_WINDOW))
    return S.own_rows(d).drop("_c0", "_xc", "_k", "_s1", "_s2", "_st", "_sc")


def all_present(extra=("vix_close",)) -> Column:
    """True where every feature has a value, told from ``bounded_indicators`` alone.

    The recursive features have values from fixed positions on, the last of them (the signal) before the long moving
    average is full; so only position, %B, volume change and the extra columns decide.
    """
    out = F.col("i") >= SMA_LONG - 1
    for c in ("bb_pct", "vol_change", *extra):
        out = out & F.col(c).isNotNull()
    return out


def recursive_indicators(df: DataFrame, key="symbol", block: int = S.DEFAULT_BLOCK,
                         between=None) -> DataFrame:
    """RSI, MACD (+ signal, diff) and ATR via two block-scan rounds.

    ``between`` (optional) is applied to the intermediate table between the
    rounds, e.g. to materialise it.
    """
    a_rsi = 1.0 / RSI_WINDOW
    d = df.withColumn("_atr_x", F.when(F.col("i") == ATR_WINDOW - 1, F.col("_tr_seed"))
                      .otherwise(F.col("_tr")))
    d = S.ewm(d, key, [
        S.EwmSpec("_up", a_rsi, "_eup", 0, RSI_WINDOW),
        S.EwmSpec("_dn", a_rsi, "_edn", 0, RSI_WINDOW),
        S.EwmSpec("close", 2.0 / (MACD_FAST + 1), "_efast", 0, MACD_FAST),
        S.EwmSpec("close", 2.0 / (MACD_SLOW + 1), "_eslow", 0, MACD_SLOW),
        S.EwmSpec("_atr_x", 1.0 / ATR_WINDOW, "_atr", ATR_WINDOW - 1, 1),
    ], block=block)
    d = (d.withColumn("rsi_14", F.when(F.col("_edn") == 0, F.lit(100.0))
                      .otherwise(F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + F.try_divide(F.col("_eup"), F.col("_edn")))))
          .withColumn("macd", F.col("_efast") - F.col("_eslow"))
          .withColumn("atr_14", F.coalesce(F.col("_atr"), F.lit(0.0))))
    d = d.withColumn("rsi_14", F.when(F.col("_edn").isNotNull() & F.col("_eup").isNotNull(), F.col("rsi_14")))
    if between is not None:
        d = between(d)
    d = S.ewm(d, key, [S.EwmSpec("macd", 2.0 / (MACD_SIGN + 1), "macd_signal", MACD_SLOW - 1, MACD_SIGN)],
              block=block)
    d = d.withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    return d.drop("_up", "_dn", "_tr", "_tr_seed", "_atr_x", "_eup", "_edn", "_efast", "_eslow", "_atr")


def all_indicators(df: DataFrame, key="symbol", block: int = S.DEFAULT_BLOCK,
                   drop_warmup: bool = True, features: Sequence[str] = FEATURES) -> DataFrame:
    """The nine indicators (+ whatever extra feature columns exist), warm-up dropped."""
    d = recursive_indicators(bounded_indicators(df, key, block), key, block).drop(S.BLK)
    if drop_warmup:
        d = d.dropna(subset=[c for c in features if c in d.columns])
    return d


def select_features(columns, exclude=("r", "open", "high", "low", "close", "volume")) -> list[str]:
    """Schema-driven feature list: every indicator column except the return and OHLCV."""
    keys = {"symbol", "day", "i"}
    cols = [c for c in columns if c not in exclude and c not in keys and not c.startswith("_")]
    known = [c for c in FEATURES if c in cols]
    return known + [c for c in cols if c not in known]
