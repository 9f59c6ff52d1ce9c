"""Registered queries: sources of the price panel and the window operators (2.1, 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as IND
from ..operators import samples as SMP
from ..operators import series as S
from ..oracle.views import sql
from ..sources import fixtures as FX
from ..sources import readers as RD
from . import features as FT
from .registry import R, register, rounded

FEAT_COLS = ("vix_close", "rsi_14", "macd", "macd_signal", "macd_diff", "bb_pct", "atr_14",
             "sma_20", "sma_50", "vol_change")


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


# Symbol granularity of the bar fixture: "flag" (3 symbols) for correctness
# runs, "flag_supp" (60) for benches.  bench.py switches it.
FX_SYMBOLS = ["flag"]


@register("load_bars", R(sql("""SELECT symbol, day, open, high, low, close, volume FROM bars
WHERE symbol IN ('A', 'N') AND day >= DATE '1996-01-01' AND day < DATE '2000-01-01'
  AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL""",
                             "bars"), "open", "high", "low", "close", "volume"))
def q_load_bars(spark, sf):
    return rounded(RD.load_bars(_bars(spark, sf), ["A", "N"], "1996-01-01", "2000-01-01"))


@register("market_days", sql("SELECT DISTINCT day FROM bars", "bars"))
def q_market_days(spark, sf):
    return RD.market_days(_bars(spark, sf))


@register("row_position", sql("""SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i
FROM bars""", "bars"))
def q_row_position(spark, sf):
    return S.with_position(_bars(spark, sf), "symbol", "day").select("symbol", "day", "i")


@register("log_return", R(sql("""SELECT symbol, day,
  100 * ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM bars""", "bars"), "r"))
def q_log_return(spark, sf):
    d = S.with_position(_bars(spark, sf))
    return rounded(IND.log_return(d).select("symbol", "day", "r"))


@register("volume_change", R(sql("""SELECT symbol, day,
  100 * (volume / lag(volume) OVER (PARTITION BY symbol ORDER BY day) - 1) AS vol_change FROM bars""", "bars"),
                             "vol_change"))
def q_volume_change(spark, sf):
    d = S.halo(S.with_position(_bars(spark, sf)), 1, 0)
    prev = F.lag("volume", 1).over(S.block_window("symbol"))
    d = d.withColumn("vol_change", F.lit(100.0) * (F.try_divide(F.col("volume"), prev) - 1))
    return rounded(S.own_rows(d).select("symbol", "day", "vol_change"))


@register("sma", R(sql("""SELECT symbol, day,
  CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20,
  CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50
FROM bars WINDOW w20 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                 w50 AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""", "bars"),
                   "sma_20", "sma_50"))
def q_sma(spark, sf):
    d = S.halo(S.with_position(_bars(spark, sf)), 49, 0)
    d = d.withColumn("sma_20", IND.sma_expr("symbol", "close", 20)).withColumn(
        "sma_50", IND.sma_expr("symbol", "close", 50))
    return rounded(S.own_rows(d).select("symbol", "day", "sma_20", "sma_50"))


@register("bollinger_pct", R(sql("""SELECT symbol, day,
  CASE WHEN n = 20 AND sd <> 0 THEN (close - (m - 2 * sd)) / (4 * sd) END AS bb_pct
FROM (SELECT symbol, day, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
                                 "bars"), "bb_pct"))
def q_bollinger(spark, sf):
    d = IND.bounded_indicators(S.with_position(_bars(spark, sf)))
    return rounded(d.select("symbol", "day", "bb_pct"))


@register("ewm", R(sql("""SELECT bpos.symbol, bpos.day, CASE WHEN bpos.i >= 11 THEN ewm12.v END AS ewm_12
FROM bpos JOIN ewm12 USING (symbol, i)""", "ewm12"), "ewm_12"))
def q_ewm(spark, sf):
    d = S.ewm(S.with_position(_bars(spark, sf)), "symbol", [S.EwmSpec("close", 2.0 / 13, "ewm_12", 0, 12)])
    return rounded(d.select("symbol", "day", "ewm_12"))


def _joined_indicators(spark, sf):
    return FT.indicator_panel(_bars(spark, sf), FX.vol_index(spark, sf)).drop("_blk")


@register("rsi", R(sql("SELECT symbol, day, rsi_14 FROM ind", "ind"), "rsi_14"))
def q_rsi(spark, sf):
    return rounded(_joined_indicators(spark, sf).select("symbol", "day", "rsi_14"))


@register("macd", R(sql("SELECT symbol, day, macd, macd_signal, macd_diff FROM ind", "ind"),
                    "macd", "macd_signal", "macd_diff"))
def q_macd(spark, sf):
    return rounded(_joined_indicators(spark, sf).select("symbol", "day", "macd", "macd_signal", "macd_diff"))


@register("atr", R(sql("SELECT symbol, day, atr_14 FROM ind", "ind"), "atr_14"))
def q_atr(spark, sf):
    return rounded(_joined_indicators(spark, sf).select("symbol", "day", "atr_14"))


@register("join_market_series", R(sql("SELECT symbol, day, close, r, vix_close FROM jn", "jn"),
                                  "close", "r", "vix_close"))
def q_join_market_series(spark, sf):
    d = FT.joined_panel(_bars(spark, sf), FX.vol_index(spark, sf))
    return rounded(d.select("symbol", "day", "close", "r", "vix_close"))


@register("all_indicators", R(sql("SELECT symbol, day, i, " + ", ".join(FEAT_COLS) + " FROM feat", "feat"),
                              *FEAT_COLS))
def q_all_indicators(spark, sf):
    d = FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf))
    return rounded(d.select("symbol", "day", "i", *FEAT_COLS))


@register("select_features", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_values, count(*) - count({c}) AS n_missing FROM feat" for c in IND.FEATURES), "feat"))
def q_select_features(spark, sf):
    """The selected features of the panel with their counts of values, one row per feature."""
    d = FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf))
    cols = IND.select_features(d.columns)
    one = d.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values"), (F.col("_n") - F.col(c)).alias("n_missing"))
                     for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@register("drop_warmup", sql("SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, min(day) AS first_day FROM feat GROUP BY symbol",
                             "feat"))
def q_drop_warmup(spark, sf):
    d = FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"))


_SAMPLES_SQL = sql("""SELECT symbol, day, i, w_len, w_sum, w_first_rsi, y_t1, y_t5 FROM (
  SELECT symbol, day, i,
    count(*) OVER wb AS w_len,
    sum(vix_close + rsi_14 + macd + macd_signal + macd_diff + bb_pct + atr_14 + sma_20 + sma_50 + vol_change) OVER wb AS w_sum,
    first_value(rsi_14) OVER wb AS w_first_rsi,
    lead(r, 1) OVER w AS y_t1,
    sum(r) OVER wf AS y_t5,
    count(*) OVER wf AS n_after
  FROM feat
  WINDOW w AS (PARTITION BY symbol ORDER BY i),
         wb AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
         wf AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
WHERE i >= 30 AND n_after = 5""", "feat")


@register("sliding_windows", R(_SAMPLES_SQL, "w_sum", "w_first_rsi", "y_t1", "y_t5", digits=4))
def q_sliding_windows(spark, sf):
    s = FT.samples(_bars(spark, sf), FX.vol_index(spark, sf), lookback=30)
    flat = F.flatten("window")
    return rounded(s.select(
        "symbol", "day", "i",
        F.size("window").cast("long").alias("w_len"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("w_sum"),
        F.col("window")[0][1].alias("w_first_rsi"),
        "y_t1", "y_t5"), 4)


@register("target_next", R(sql("""SELECT symbol, day, lead(r, 1) OVER (PARTITION BY symbol ORDER BY day) AS y_t1
FROM rets""", "rets"), "y_t1"))
def q_target_next(spark, sf):
    p = FT.returns_panel(_bars(spark, sf))
    return rounded(SMP.targets(p).select("symbol", "day", "y_t1"))


@register("target_cumulative", R(sql("""SELECT symbol, day,
  CASE WHEN count(r) OVER w = 5 THEN sum(r) OVER w END AS y_t5
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""", "rets"),
                                 "y_t5"))
def q_target_cumulative(spark, sf):
    p = FT.returns_panel(_bars(spark, sf))
    return rounded(SMP.targets(p).select("symbol", "day", "y_t5"))


@register("return_paths", R(sql("""SELECT symbol, start_day, CAST(20 AS BIGINT) AS path_len, path_sum, path_first, path_last
FROM (SELECT symbol, day AS start_day, sum(r) OVER w AS path_sum, r AS path_first,
             last_value(r) OVER w AS path_last, count(*) OVER wa AS n_after
      FROM rets
      WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING),
             wa AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
WHERE n_after = 20""", "rets"), "path_sum", "path_first", "path_last"))
def q_return_paths(spark, sf):
    p = SMP.return_paths(FT.returns_panel(_bars(spark, sf)), 20)
    return rounded(p.select("symbol", "start_day", F.size("path").cast("long").alias("path_len"),
                            F.aggregate("path", F.lit(0.0), lambda a, x: a + x).alias("path_sum"),
                            F.col("path")[0].alias("path_first"), F.col("path")[19].alias("path_last")))


@register("compound_curve", R(sql("""SELECT symbol, day,
  exp(sum(ln(1 + r / 100)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS curve
FROM rets""", "rets"), "curve"))
def q_compound_curve(spark, sf):
    p = FT.returns_panel(_bars(spark, sf)).withColumn("_f", F.lit(1.0) + F.col("r") / 100)
    d = S.running_product(p, "symbol", "_f", "curve", i="i")
    return rounded(d.select("symbol", "day", "curve"))


@register("running_drawdown", R(sql("""SELECT symbol, day, curve / max(curve) OVER w - 1 AS drawdown FROM (
  SELECT symbol, day,
    exp(sum(ln(1 + r / 100)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS curve
  FROM rets) WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                                    "rets"), "drawdown"))
def q_running_drawdown(spark, sf):
    p = FT.returns_panel(_bars(spark, sf)).withColumn("_f", F.lit(1.0) + F.col("r") / 100)
    d = S.running_product(p, "symbol", "_f", "curve", i="i")
    d = S.running(d, "symbol", "curve", "max", "peak", i="i")
    return rounded(d.select("symbol", "day", (F.col("curve") / F.col("peak") - 1).alias("drawdown")))


@register("score_fn", R(sql("""SELECT symbol, day, y_t1, (w_rsi - 50.0) / 50.0 AS y_pred FROM (
  SELECT symbol, day, i, avg(rsi_14) OVER wb AS w_rsi, lead(r, 1) OVER w AS y_t1, count(*) OVER wf AS n_after
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY i),
                   wb AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
                   wf AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
WHERE i >= 30 AND n_after = 5""", "feat"), "y_t1", "y_pred"))
def q_score_fn(spark, sf):
    """A numpy scorer over stacked 30-day windows, run per Arrow batch in mapInPandas."""
    from ..functions.udf import score_windows
    s = FT.samples(_bars(spark, sf), FX.vol_index(spark, sf), lookback=30)

    def rsi_tilt(x):   # (b, L, f): mean RSI of the window, centred and scaled
        return (x[:, :, 1].mean(axis=1) - 50.0) / 50.0

    return rounded(score_windows(s, rsi_tilt).select("symbol", "day", "y_t1", "y_pred"))
