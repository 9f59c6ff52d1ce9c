"""Registered queries: metrics, backtests and significance on the preds table (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..oracle.views import sql
from ..sources import fixtures as FX
from . import features as FT
from .q_features import FX_SYMBOLS
from .registry import R, register, rounded, rounded_sig

G = ["model", "horizon", "symbol"]
GS = "model, horizon, symbol"


def preds(spark, sf):
    return FT.preds(FX.bars(spark, sf, symbols=FX_SYMBOLS[0]))


SHARPE = """CASE WHEN stddev_pop({x}) < 1e-9 THEN 0.0 ELSE avg({x}) / stddev_pop({x}) * sqrt(252) END"""
SORTINO = """CASE WHEN coalesce(stddev_pop({x}) FILTER (WHERE {x} < 0), 1e-9) = 0 THEN NULL
  ELSE avg({x}) / coalesce(stddev_pop({x}) FILTER (WHERE {x} < 0), 1e-9) * sqrt(252) END"""
DA = "avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END)"


def _dd_sql(ret: str, src: str, keys: str = GS) -> str:
    return f"""SELECT {keys}, min((curve / peak - 1) * 100) AS max_drawdown FROM (
  SELECT {keys}, curve, max(curve) OVER (PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
  FROM (SELECT {keys}, day, exp(sum(ln(1 + {ret} / 100)) OVER (PARTITION BY {keys} ORDER BY day
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS curve FROM {src}))
GROUP BY {keys}"""


@register("rmse", R(sql(f"SELECT {GS}, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM preds GROUP BY {GS}", "preds"),
                    "rmse"))
def q_rmse(spark, sf):
    return rounded(preds(spark, sf).groupBy(*G).agg(M.rmse().alias("rmse")))


@register("mae", R(sql(f"SELECT {GS}, avg(abs(y_true - y_pred)) AS mae FROM preds GROUP BY {GS}", "preds"), "mae"))
def q_mae(spark, sf):
    return rounded(preds(spark, sf).groupBy(*G).agg(M.mae().alias("mae")))


@register("directional_accuracy", R(sql(f"SELECT {GS}, {DA} AS directional_accuracy FROM preds GROUP BY {GS}",
                                        "preds"), "directional_accuracy"))
def q_da(spark, sf):
    return rounded(preds(spark, sf).groupBy(*G).agg(M.directional_accuracy().alias("directional_accuracy")))


@register("predictive_metrics", R(sql(f"""SELECT {GS}, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
  avg(abs(y_true - y_pred)) AS mae, {DA} AS directional_accuracy, count(*) AS n FROM preds GROUP BY {GS}""", "preds"),
                                  "rmse", "mae", "directional_accuracy"))
def q_predictive(spark, sf):
    return rounded(M.predictive_metrics(preds(spark, sf), G))


_EX = "(y_true / 100 - 0.02 / 252)"


@register("sharpe_ratio", R(sql(f"SELECT {GS}, {SHARPE.format(x=_EX)} AS sharpe FROM preds GROUP BY {GS}", "preds"),
                            "sharpe"))
def q_sharpe(spark, sf):
    return rounded(preds(spark, sf).groupBy(*G).agg(M.sharpe("y_true").alias("sharpe")))


@register("sortino_ratio", R(sql(f"SELECT {GS}, {SORTINO.format(x=_EX)} AS sortino FROM preds GROUP BY {GS}", "preds"),
                             "sortino"))
def q_sortino(spark, sf):
    return rounded(preds(spark, sf).groupBy(*G).agg(M.sortino("y_true").alias("sortino")))


@register("max_drawdown", R(sql(_dd_sql("y_true", "preds"), "preds"), "max_drawdown"))
def q_max_drawdown(spark, sf):
    return rounded(M.max_drawdown(preds(spark, sf), G, "y_true"))


def _bt_sql(thr: str = "0") -> str:
    s = f"""(SELECT *, CASE WHEN y_pred > {thr} THEN 1.0 WHEN y_pred < -{thr} THEN -1.0 ELSE 0.0 END AS sig,
  (CASE WHEN y_pred > {thr} THEN 1.0 WHEN y_pred < -{thr} THEN -1.0 ELSE 0.0 END) * y_true AS sr FROM preds)"""
    return f"""SELECT a.*, d.max_drawdown AS strategy_max_drawdown FROM (
  SELECT {GS}, {SHARPE.format(x='(sr / 100 - 0.02 / 252)')} AS strategy_sharpe,
    {SORTINO.format(x='(sr / 100 - 0.02 / 252)')} AS strategy_sortino,
    sum(sr) AS strategy_total_return, {DA} AS strategy_directional,
    {SHARPE.format(x=_EX)} AS bh_sharpe, sum(y_true) AS bh_total_return,
    count(*) FILTER (WHERE sig <> 0) AS num_trades
  FROM {s} GROUP BY {GS}) a
JOIN ({_dd_sql('sr', s)}) d USING ({GS})"""


BT_COLS = ("strategy_sharpe", "strategy_sortino", "strategy_total_return", "strategy_directional", "bh_sharpe",
           "bh_total_return", "strategy_max_drawdown")


@register("long_short_backtest", R(sql(_bt_sql(), "preds"), *BT_COLS, digits=5))
def q_long_short(spark, sf):
    return rounded(M.long_short_backtest(preds(spark, sf), G), 5)


# ------------------------------------------------------------------ signals (2.2)

def with_proba(df):
    return df.withColumn("proba", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("y_pred"))))


PROBA = "1 / (1 + exp(-y_pred))"


@register("signal_from_prediction", sql(f"""SELECT {GS}, day,
  CAST(CASE WHEN y_pred > 0.1 THEN 1.0 WHEN y_pred < -0.1 THEN -1.0 ELSE 0.0 END AS DOUBLE) AS signal FROM preds""", "preds"))
def q_signal_pred(spark, sf):
    return preds(spark, sf).select(*G, "day", M.signal("y_pred", 0.1).alias("signal"))


@register("signal_from_probability", R(sql(f"""SELECT {GS}, day,
  CASE WHEN {PROBA} > 0.5 THEN 1.0 ELSE -1.0 END AS sig_proba, CAST(sign(y_pred) AS DOUBLE) AS sig_continuous
FROM preds""", "preds"), "sig_proba", "sig_continuous"))
def q_signal_proba(spark, sf):
    d = with_proba(preds(spark, sf))
    return rounded(d.select(*G, "day", M.proba_signal("proba", 0.5, "proba").alias("sig_proba"),
                    M.proba_signal("y_pred", mode="continuous").alias("sig_continuous")))


@register("direction_label", R(sql("""SELECT horizon, symbol, count(*) AS n,
  avg(CASE WHEN y_true > 0 THEN 1 ELSE 0 END) AS pos_ratio FROM preds WHERE model = 'zero' GROUP BY horizon, symbol""",
                                   "preds"), "pos_ratio"))
def q_direction_label(spark, sf):
    d = preds(spark, sf).filter(F.col("model") == "zero")
    return rounded(d.groupBy("horizon", "symbol").agg(F.count(F.lit(1)).alias("n"),
                                                      F.avg(M.direction_label()).alias("pos_ratio")))


# ------------------------------------------------------------------ backtests (2.8)

@register("proba_backtest", R(sql(f"""SELECT a.*, d.max_drawdown FROM (
  SELECT {GS}, avg(sr) / (stddev_pop(sr) + 1e-8) * sqrt(252) AS sharpe,
    (exp(sum(ln(1 + sr / 100))) - 1) * 100 AS total_return, (exp(sum(ln(1 + y_true / 100))) - 1) * 100 AS bh_return
  FROM (SELECT *, CASE WHEN {PROBA} > 0.5 THEN 1.0 ELSE -1.0 END * y_true AS sr FROM preds) GROUP BY {GS}) a
JOIN ({_dd_sql('sr', f"(SELECT *, CASE WHEN {PROBA} > 0.5 THEN 1.0 ELSE -1.0 END * y_true AS sr FROM preds)")}) d
USING ({GS})""", "preds"), "sharpe", "max_drawdown", digits=5, sig=("total_return", "bh_return")))
def q_proba_backtest(spark, sf):
    d = rounded_sig(M.proba_backtest(with_proba(preds(spark, sf)), G, "proba"), ("total_return", "bh_return"))
    return rounded(d.select(*[c for c in d.columns if c not in ("total_return", "bh_return")]), 5).join(
        d.select(*G, "total_return", "bh_return"), G)


_SW = """(SELECT p.*, t.threshold,
  CASE WHEN y_pred > t.threshold THEN 1.0 WHEN y_pred < -t.threshold THEN -1.0 ELSE 0.0 END AS sig,
  (CASE WHEN y_pred > t.threshold THEN 1.0 WHEN y_pred < -t.threshold THEN -1.0 ELSE 0.0 END) * y_true AS sr
 FROM preds p, (VALUES (0.0), (0.05), (0.1), (0.15), (0.2), (0.3), (0.5)) t(threshold))"""

_SWEEP_SQL = f"""SELECT a.*, d.max_drawdown FROM (
  SELECT {GS}, threshold, avg(CASE WHEN sig <> 0 THEN 1.0 ELSE 0.0 END) AS exposure,
    {SHARPE.format(x='(sr / 100 - 0.02 / 252)')} AS sharpe, {SORTINO.format(x='(sr / 100 - 0.02 / 252)')} AS sortino,
    sum(sr) AS total_return, avg(CASE WHEN sr > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE sig <> 0) AS win_rate
  FROM {_SW} GROUP BY {GS}, threshold) a
JOIN ({_dd_sql('sr', _SW, GS + ', threshold')}) d USING ({GS}, threshold)"""

SWEEP_COLS = ("exposure", "sharpe", "sortino", "total_return", "win_rate", "max_drawdown")


@register("threshold_sweep", R(sql(_SWEEP_SQL, "preds"), "threshold", *SWEEP_COLS, digits=5))
def q_sweep(spark, sf):
    return rounded(M.threshold_sweep(preds(spark, sf), G), 5)


@register("recommend_threshold", R(sql(f"""SELECT k.{GS.replace(', ', ', k.')}, coalesce(b.t, 0.0) AS threshold,
  s.sharpe, s.max_drawdown, s.exposure
FROM (SELECT DISTINCT {GS} FROM sw) k
LEFT JOIN (SELECT {GS}, arg_max(threshold, row(sharpe, -threshold)) AS t FROM sw WHERE exposure >= 0.3 GROUP BY {GS}) b
  USING ({GS})
LEFT JOIN sw s ON s.model = k.model AND s.horizon = k.horizon AND s.symbol = k.symbol AND s.threshold = coalesce(b.t, 0.0)""",
                                       "preds", extra=f"sw AS ({_SWEEP_SQL})"),
                                   "threshold", "sharpe", "max_drawdown", "exposure", digits=5))
def q_recommend(spark, sf):
    return rounded(M.recommend_threshold(M.threshold_sweep(preds(spark, sf), G), G), 5)


_CONF = f"""(SELECT p.*, CASE WHEN {PROBA} > 0.5 + m.margin THEN 1.0 WHEN {PROBA} < 0.5 - m.margin THEN -1.0 ELSE 0.0 END
  AS signal FROM preds p JOIN (SELECT {GS}, quantile_cont(abs({PROBA} - 0.5), 0.5) AS margin FROM preds GROUP BY {GS}) m
  USING ({GS}))"""


@register("confidence_margin", R(sql(f"""SELECT {GS}, quantile_cont(abs({PROBA} - 0.5), 0.5) AS margin,
  count(*) AS n FROM preds GROUP BY {GS}""", "preds"), "margin", digits=6))
def q_confidence(spark, sf):
    d = M.confidence_signals(with_proba(preds(spark, sf)), G, "proba")
    return rounded(d.groupBy(*G).agg(F.first("margin").alias("margin"), F.count(F.lit(1)).alias("n")))


EXPO_COLS = ("exposure", "win_rate", "win_rate_bh", "sharpe", "sharpe_bh", "max_drawdown", "max_drawdown_bh")


@register("exposure_report", R(sql(f"""SELECT a.*, d.max_drawdown, b.max_drawdown AS max_drawdown_bh FROM (
  SELECT {GS}, count(*) AS n_days, count(*) FILTER (WHERE signal = 1) AS days_long,
    count(*) FILTER (WHERE signal = -1) AS days_short, count(*) FILTER (WHERE signal = 0) AS days_cash,
    avg(CASE WHEN signal <> 0 THEN 1.0 ELSE 0.0 END) AS exposure,
    coalesce(avg(CASE WHEN signal * y_true > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE signal <> 0), 0.0) AS win_rate,
    avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS win_rate_bh,
    avg(signal * y_true) / (stddev_pop(signal * y_true) + 1e-8) * sqrt(252) AS sharpe,
    avg(y_true) / (stddev_pop(y_true) + 1e-8) * sqrt(252) AS sharpe_bh,
    (exp(sum(ln(1 + signal * y_true / 100))) - 1) * 100 AS total_return,
    (exp(sum(ln(1 + y_true / 100))) - 1) * 100 AS bh_return
  FROM {_CONF} GROUP BY {GS}) a
JOIN ({_dd_sql('sr', f'(SELECT *, signal * y_true AS sr FROM {_CONF})')}) d USING ({GS})
JOIN ({_dd_sql('y_true', 'preds')}) b USING ({GS})""", "preds"), *EXPO_COLS, digits=5,
                               sig=("total_return", "bh_return")))
def q_exposure(spark, sf):
    d = M.confidence_signals(with_proba(preds(spark, sf)), G, "proba")
    r = rounded_sig(M.exposure_report(d, G, "signal"), ("total_return", "bh_return"))
    return rounded(r.select(*[c for c in r.columns if c not in ("total_return", "bh_return")]), 5).join(
        r.select(*G, "total_return", "bh_return"), G)


@register("prediction_diagnostics", R(sql(f"""SELECT {GS}, min(y_pred) AS pred_min, max(y_pred) AS pred_max,
  avg(y_pred) AS pred_mean, stddev_pop(y_pred) AS pred_std, avg(CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END) AS share_positive,
  CASE WHEN stddev_pop(y_true) = 0 THEN NULL ELSE stddev_pop(y_pred) / stddev_pop(y_true) END AS std_ratio
FROM preds GROUP BY {GS}""", "preds"), "pred_min", "pred_max", "pred_mean", "pred_std", "share_positive", "std_ratio"))
def q_diagnostics(spark, sf):
    return rounded(M.prediction_diagnostics(preds(spark, sf), G))


@register("model_comparison", R(sql(f"""SELECT m.*, b.strategy_sharpe, b.strategy_max_drawdown FROM (
  SELECT {GS}, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae, {DA} AS directional_accuracy,
    count(*) AS n FROM preds GROUP BY {GS}) m JOIN ({_bt_sql()}) b USING ({GS})""", "preds"),
                                "rmse", "mae", "directional_accuracy", "strategy_sharpe", "strategy_max_drawdown", digits=5))
def q_comparison(spark, sf):
    return rounded(M.model_comparison(preds(spark, sf), G), 5)


@register("improvement_pct", R(sql(f"""SELECT m.model, m.horizon, m.symbol, m.rmse,
  (1 - m.rmse / z.rmse) * 100 AS vs_zero, (1 - m.rmse / r.rmse) * 100 AS vs_reversal
FROM mm m LEFT JOIN mm z ON z.model = 'zero' AND z.horizon = m.horizon AND z.symbol = m.symbol
LEFT JOIN mm r ON r.model = 'reversal' AND r.horizon = m.horizon AND r.symbol = m.symbol""", "preds",
                                   extra=f"mm AS (SELECT {GS}, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse FROM preds GROUP BY {GS})"),
                               "rmse", "vs_zero", "vs_reversal"))
def q_improvement(spark, sf):
    m = preds(spark, sf).groupBy(*G).agg(M.rmse().alias("rmse"))
    return rounded(M.improvement_pct(m, ["horizon", "symbol"], ["zero", "reversal"]))


@register("daily_equivalent", R(sql("""SELECT model, symbol, sqrt(avg(pow(y_true - y_pred, 2))) / sqrt(5) AS rmse_daily_eq
FROM preds WHERE horizon = 5 GROUP BY model, symbol""", "preds"), "rmse_daily_eq"))
def q_daily_eq(spark, sf):
    d = preds(spark, sf).filter(F.col("horizon") == 5)
    return rounded(d.groupBy("model", "symbol").agg((M.rmse() / F.lit(5 ** 0.5)).alias("rmse_daily_eq")))


@register("naive_zero", R(sql("""SELECT horizon, symbol, sqrt(avg(pow(y_true, 2))) AS rmse_zero, avg(abs(y_true)) AS mae_zero,
  avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS acc_naive_up FROM preds WHERE model = 'zero' GROUP BY horizon, symbol""",
                                "preds"), "rmse_zero", "mae_zero", "acc_naive_up"))
def q_naive(spark, sf):
    """Constant baselines: predict 0 (regression) and always-up (classification)."""
    d = preds(spark, sf).filter(F.col("model") == "zero").withColumn("_zero", F.lit(0.0)).withColumn("_up", F.lit(1))
    return rounded(d.groupBy("horizon", "symbol").agg(
        M.rmse("y_true", "_zero").alias("rmse_zero"), M.mae("y_true", "_zero").alias("mae_zero"),
        F.avg((M.direction_label() == F.col("_up")).cast("double")).alias("acc_naive_up")))


_CLS = f"""(SELECT {GS}, CASE WHEN y_true > 0 THEN 1 ELSE 0 END AS label, CASE WHEN {PROBA} > 0.5 THEN 1 ELSE 0 END AS pred
  FROM preds WHERE model <> 'zero')"""


@register("classification_report", R(sql(f"""SELECT {GS}, n, sup0, sup1, precision_0, recall_0,
  CASE WHEN precision_0 + recall_0 = 0 THEN 0.0 ELSE 2 * precision_0 * recall_0 / (precision_0 + recall_0) END AS f1_0,
  precision_1, recall_1,
  CASE WHEN precision_1 + recall_1 = 0 THEN 0.0 ELSE 2 * precision_1 * recall_1 / (precision_1 + recall_1) END AS f1_1,
  accuracy, macro_f1, weighted_f1 FROM (
  SELECT *, (f1a + f1b) / 2 AS macro_f1, (f1a * sup0 + f1b * sup1) / n AS weighted_f1 FROM (
    SELECT *, CASE WHEN precision_0 + recall_0 = 0 THEN 0.0 ELSE 2 * precision_0 * recall_0 / (precision_0 + recall_0) END AS f1a,
              CASE WHEN precision_1 + recall_1 = 0 THEN 0.0 ELSE 2 * precision_1 * recall_1 / (precision_1 + recall_1) END AS f1b
    FROM (SELECT {GS}, count(*) AS n, count(*) FILTER (WHERE label = 0) AS sup0, count(*) FILTER (WHERE label = 1) AS sup1,
            coalesce(count(*) FILTER (WHERE label = 0 AND pred = 0) / nullif(count(*) FILTER (WHERE pred = 0), 0), 0.0) AS precision_0,
            coalesce(count(*) FILTER (WHERE label = 0 AND pred = 0) / nullif(count(*) FILTER (WHERE label = 0), 0), 0.0) AS recall_0,
            coalesce(count(*) FILTER (WHERE label = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE pred = 1), 0), 0.0) AS precision_1,
            coalesce(count(*) FILTER (WHERE label = 1 AND pred = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 0.0) AS recall_1,
            avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy
          FROM {_CLS} GROUP BY {GS})))""", "preds"),
                                     "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "accuracy",
                                     "macro_f1", "weighted_f1"))
def q_classification(spark, sf):
    d = with_proba(preds(spark, sf).filter(F.col("model") != "zero"))
    d = d.withColumn("label", M.direction_label()).withColumn("pred", (F.col("proba") > 0.5).cast("int"))
    r = M.classification_report(d, G, "label", "pred")
    return rounded(r.select(*G, "n", F.col("sup0").cast("long").alias("sup0"), F.col("sup1").cast("long").alias("sup1"),
                            "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "accuracy",
                            "macro_f1", "weighted_f1"))


@register("accuracy", R(sql(f"SELECT {GS}, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM {_CLS} GROUP BY {GS}",
                            "preds"), "accuracy"))
def q_accuracy(spark, sf):
    d = with_proba(preds(spark, sf).filter(F.col("model") != "zero"))
    return rounded(d.groupBy(*G).agg(F.avg((M.direction_label() == (F.col("proba") > 0.5).cast("int")).cast("double"))
                                     .alias("accuracy")))


@register("auc_roc", R(sql(f"""SELECT {GS}, sum(pos * (neg_le - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (
  SELECT *, sum(neg) OVER (PARTITION BY {GS} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM (
    SELECT {GS}, round({PROBA}, 9) AS score, sum(CASE WHEN y_true > 0 THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN y_true > 0 THEN 0 ELSE 1 END) AS neg FROM preds WHERE model <> 'zero' GROUP BY {GS}, score))
GROUP BY {GS}""", "preds"), "auc"))
def q_auc(spark, sf):
    d = with_proba(preds(spark, sf).filter(F.col("model") != "zero")).withColumn("label", M.direction_label())
    from .registry import round_half_away
    d = d.withColumn("proba", round_half_away(F.col("proba"), 9))
    return rounded(M.auc_roc(d, G, "label", "proba"))


_PT_SQL = f"""SELECT {GS}, da, pstar AS da_indep,
  CASE WHEN vh - vs > 0 THEN (da - pstar) / sqrt(vh - vs) END AS stat, n FROM (
  SELECT *, pstar * (1 - pstar) / n AS vh,
    (pow(2 * py - 1, 2) * px * (1 - px) / n + pow(2 * px - 1, 2) * py * (1 - py) / n
     + 4 * py * px * (1 - py) * (1 - px) / (n * n)) AS vs FROM (
    SELECT *, py * px + (1 - py) * (1 - px) AS pstar FROM (
      SELECT {GS}, {DA} AS da, avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS py,
             avg(CASE WHEN y_pred > 0 THEN 1.0 ELSE 0.0 END) AS px, count(*) AS n
      FROM preds WHERE model <> 'zero' GROUP BY {GS})))"""


@register("pesaran_timmermann", R(sql(_PT_SQL, "preds"), "da", "da_indep", "stat"))
def q_pt(spark, sf):
    return rounded(M.pesaran_timmermann(preds(spark, sf).filter(F.col("model") != "zero"), G))


def simpson(f: str, end: str, steps: int = 1000) -> str:
    """DuckDB: integral of ``f`` (an expression in {x}) from 0 to ``end`` by Simpson's rule."""
    x = f"(k * {end} / {steps}.0)"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {f.format(x=x)})) * {end} / {3 * steps}.0)"


NORM_SF_SQL = "0.5 - " + simpson("exp(-pow({x}, 2) / 2)", "stat") + " / sqrt(2 * pi())"


@register("pesaran_timmermann_pvalue", R(f"SELECT *, CASE WHEN stat IS NOT NULL THEN {NORM_SF_SQL} END AS p_value FROM ({sql(_PT_SQL, 'preds')})",
                                         "da", "da_indep", "stat", "p_value"))
def q_pt_p(spark, sf):
    from ..functions.probability import norm_sf
    pt = M.pesaran_timmermann(preds(spark, sf).filter(F.col("model") != "zero"), G)
    return rounded(pt.withColumn("p_value", norm_sf(F.col("stat"))))


def dm_pairs(spark, sf):
    p = preds(spark, sf)
    base = p.filter(F.col("model") == "zero").select("horizon", "symbol", "day", F.col("y_pred").alias("pred_b"))
    a = p.filter(F.col("model") != "zero").select(F.col("model").alias("model_a"), "horizon", "symbol", "day", "y_true",
                                                  F.col("y_pred").alias("pred_a"))
    return a.join(base, ["horizon", "symbol", "day"], "inner")


def dm_table(spark, sf):
    pairs = dm_pairs(spark, sf)
    out = None
    for h in (1, 5):
        r = M.diebold_mariano(pairs.filter(F.col("horizon") == h), ["model_a", "horizon", "symbol"], h)
        out = r if out is None else out.unionByName(r)
    return out


_DM_SQL = """SELECT model_a, horizon, symbol,
  CASE WHEN lr > 0 THEN sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) * mean_d / sqrt(lr / n) END AS stat,
  mean_d, n FROM (
  SELECT *, CASE WHEN lr0 <= 0 THEN g0 ELSE lr0 END AS lr FROM (
    SELECT model_a, horizon, symbol, count(*) AS n, avg(d) AS mean_d, avg(dc * dc) AS g0,
      avg(dc * dc) + 2 * CASE WHEN horizon = 5 THEN
        sum(dc * l1) / (count(*) - 1) + sum(dc * l2) / (count(*) - 2) + sum(dc * l3) / (count(*) - 3) + sum(dc * l4) / (count(*) - 4)
        ELSE 0 END AS lr0
    FROM (
      SELECT *, lag(dc, 1) OVER w AS l1, lag(dc, 2) OVER w AS l2, lag(dc, 3) OVER w AS l3, lag(dc, 4) OVER w AS l4
      FROM (SELECT *, d - avg(d) OVER (PARTITION BY model_a, horizon, symbol) AS dc FROM (
              SELECT a.model AS model_a, a.horizon, a.symbol, a.day,
                     pow(a.y_true - a.y_pred, 2) - pow(a.y_true - b.y_pred, 2) AS d
              FROM preds a JOIN preds b ON b.model = 'zero' AND b.horizon = a.horizon AND b.symbol = a.symbol AND b.day = a.day
              WHERE a.model <> 'zero'))
      WINDOW w AS (PARTITION BY model_a, horizon, symbol ORDER BY day))
    GROUP BY model_a, horizon, symbol))"""


@register("diebold_mariano", R(sql(_DM_SQL, "preds"), "stat", "mean_d"))
def q_dm(spark, sf):
    return rounded(dm_table(spark, sf))


_T_ANGLE = "atan(stat / sqrt(n - 1))"
T_CDF_SQL = "0.5 + " + simpson("pow(cos({x}), n - 2)", _T_ANGLE) + " * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt(pi())"


@register("diebold_mariano_pvalue", R(f"SELECT *, CASE WHEN stat IS NOT NULL THEN {T_CDF_SQL} END AS p_value FROM ({sql(_DM_SQL, 'preds')})",
                                      "stat", "mean_d", "p_value"))
def q_dm_p(spark, sf):
    from ..functions.probability import t_cdf
    d = dm_table(spark, sf)
    return rounded(d.withColumn("p_value", t_cdf(F.col("stat"), (F.col("n") - 1).cast("double"))))


@register("naive_up", R(sql(f"""SELECT a.*, d.max_drawdown FROM (
  SELECT horizon, symbol, avg(y_true) / (stddev_pop(y_true) + 1e-8) * sqrt(252) AS sharpe,
    avg(CASE WHEN y_true > 0 THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
  FROM preds WHERE model = 'zero' GROUP BY horizon, symbol) a
JOIN ({_dd_sql('y_true', "(SELECT * FROM preds WHERE model = 'zero')", 'horizon, symbol')}) d USING (horizon, symbol)""",
                            "preds"), "sharpe", "accuracy", "max_drawdown", digits=5))
def q_naive_up(spark, sf):
    """Always-up baseline: continuous signal of a constant 1 (= buy & hold) and its hit rate."""
    d = preds(spark, sf).filter(F.col("model") == "zero").withColumn("_one", F.lit(1.0))
    bt = M.proba_backtest(d, ["horizon", "symbol"], "_one", mode="continuous").select("horizon", "symbol", "sharpe",
                                                                                      "max_drawdown")
    acc = d.groupBy("horizon", "symbol").agg(F.avg(M.direction_label().cast("double")).alias("accuracy"),
                                            F.count(F.lit(1)).alias("n"))
    return rounded(bt.join(acc, ["horizon", "symbol"]), 5)
