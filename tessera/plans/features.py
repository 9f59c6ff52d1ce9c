"""Feature chain: bars -> returns -> second series -> indicators -> samples.

Each step keeps the panel keyed by ``symbol`` and numbered by ``i``; windows
run per (symbol, block) (see ``operators.series``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indicators as IND
from ..operators import series as S
from ..operators import samples as SMP
from ..session import stage


def returns_panel(bars: DataFrame, key: str = "symbol", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Bars with ``r`` (log return in %) and position ``i``; first row of each series dropped.

    Positions stay contiguous (1..n-1) because only position 0 is removed.
    """
    d = S.with_position(bars.dropna("any"), key, "day")
    return IND.log_return(d, key, block=block).filter(F.col("r").isNotNull())


def joined_panel(bars: DataFrame, vol: DataFrame, key: str = "symbol",
                 block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Returns inner-joined with the second market series on day, renumbered 0..n-1.

    ``vol`` has one row per day.  It is left-joined (AQE broadcasts it at run
    time when its measured size is under the threshold, else sort-merge) and
    rows without a return or a value are dropped by ``series.renumber``,
    which keeps the positions contiguous without a second numbering pass.
    """
    d = S.with_position(bars.dropna("any"), key, "day")
    d = IND.log_return(d, key, block=block)
    d = d.join(vol.dropna("any"), "day", "left")
    d = S.renumber(d, key, F.col("r").isNotNull() & F.col("vix_close").isNotNull(), block=block)
    return stage(d, "joined-panel")


def indicator_panel(bars: DataFrame, vol: DataFrame, key: str = "symbol",
                    block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """All indicators on the joined panel, warm-up rows kept (nulls)."""
    d = IND.bounded_indicators(joined_panel(bars, vol, key, block), key, block)
    return IND.recursive_indicators(d, key, block, between=lambda x: stage(x, "ewm-round"))


def feature_panel(bars: DataFrame, vol: DataFrame, key: str = "symbol",
                  block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Indicators with the warm-up dropped (any null feature), renumbered 0..n-1 per symbol."""
    d = indicator_panel(bars, vol, key, block)
    keep = F.lit(True)
    for c in IND.FEATURES:
        keep = keep & F.col(c).isNotNull()
    return stage(S.renumber(d, key, keep, block=block), "feature-panel")


def feature_counts(bars: DataFrame, vol: DataFrame, key: str = "symbol", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """``(key, n)``: rows of the feature panel per key, from the bounded windows alone (no recursion, no numbering)."""
    d = IND.bounded_indicators(joined_panel(bars, vol, key, block), key, block)
    return d.filter(IND.all_present()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def feature_positions(bars: DataFrame, vol: DataFrame, key: str = "symbol", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """``(key, day, i)``: the feature panel's rows and positions, without the indicators' values."""
    d = IND.bounded_indicators(joined_panel(bars, vol, key, block), key, block)
    d = stage(d.select(key, "day", "i", S.BLK, IND.all_present().alias("_all")), "present")
    return S.renumber(d, key, F.col("_all"), block=block).drop("_all")


def preds(bars: DataFrame, key: str = "symbol", block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Prediction table ``(model, horizon, symbol, day, y_true, y_pred)``.

    ``momentum`` = mean of the last five returns, ``reversal`` = minus the last
    return, ``zero`` = 0; y_true is r[t+1] (h=1) or sum r[t+1..t+5] (h=5).
    """
    r = returns_panel(bars, key, block)
    d = S.halo(r, before=4, after=5, block=block)
    w = S.block_window(key)
    back = w.rowsBetween(-4, 0)
    fwd = w.rowsBetween(1, 5)
    d = (d.withColumn("_mom", F.when(F.count("r").over(back) == 5, F.avg("r").over(back)))
          .withColumn("_y1", F.lead("r", 1).over(w))
          .withColumn("_y5", F.when(F.count("r").over(fwd) == 5, F.sum("r").over(fwd))))
    d = S.own_rows(d).filter(F.col("_mom").isNotNull())
    models = F.array(
        F.struct(F.lit("momentum").alias("model"), F.col("_mom").alias("y_pred")),
        F.struct(F.lit("reversal").alias("model"), (-F.col("r")).alias("y_pred")),
        F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("y_pred")))
    horizons = F.array(
        F.struct(F.lit(1).alias("horizon"), F.col("_y1").alias("y_true")),
        F.struct(F.lit(5).alias("horizon"), F.col("_y5").alias("y_true")))
    out = (d.select(key, "day", F.explode(models).alias("m"), horizons.alias("hs"))
              .select("m.model", F.explode("hs").alias("h"), key, "day", "m.y_pred")
              .select("model", "h.horizon", key, "day", "h.y_true", "y_pred")
              .filter(F.col("y_true").isNotNull()))
    return stage(out, "preds")


def samples(bars: DataFrame, vol: DataFrame, lookback: int = 30, key: str = "symbol",
            block: int = S.DEFAULT_BLOCK, features=IND.FEATURES) -> DataFrame:
    """Sliding-window samples of the feature panel (see ``operators.samples``)."""
    return SMP.sliding_samples(feature_panel(bars, vol, key, block), lookback, key=key,
                               block=block, features=features)
