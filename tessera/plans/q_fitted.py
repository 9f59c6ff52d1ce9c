"""Registered queries: the fitted models in the evaluation (2.7 into 2.8), one prediction table for all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as CAL
from ..functions.probability import norm_sf, t_cdf
from ..operators import lagged as LG
from ..operators import metrics as M
from ..session import stage
from . import q_models as QM
from .registry import register, rounded

SERIES = ["model", "horizon", "symbol"]


def fitted_preds(spark, sf):
    """(model, horizon, symbol, day, y_true, y_pred) on the test rows: ridge on all rows before them, the best fold, the
    mean of all folds, and the naive zero; every model predicts the same days."""
    p, geo, coefs = QM.fold_coefs(spark, sf)
    best = coefs.groupBy("symbol", "h").agg(F.min_by(F.struct("a", "b"), F.struct("val_mse", "fold")).alias("_c")).select("symbol", "h", "_c.*")
    parts = {
        "ridge": stage(QM.ridge_predictions(p, geo), "ridge"),
        "best_fold": LG.score(p, QM.on_test(best.withColumns({"lo": F.lit(0), "hi": F.lit(0)}), geo), ["symbol"], QM.SHAPE, ids=()),
        "ensemble": QM.ensemble(p, geo, coefs),
    }
    parts["zero"] = parts["ridge"].withColumn("y_pred", F.lit(0.0))
    out = None
    for name, d in parts.items():
        d = d.select(F.lit(name).alias("model"), QM.horizon(), "symbol", "day", "y_true", "y_pred")
        out = d if out is None else out.unionByName(d)
    return stage(out, "fitted-preds")


@register("model_comparison_fitted")
def q_comparison(spark, sf):
    """RMSE, MAE, DA, Sharpe and MaxDD of the fitted models and the naive zero on the test rows."""
    return rounded(M.model_comparison(fitted_preds(spark, sf), SERIES), 5)


@register("improvement_pct_fitted")
def q_improvement(spark, sf):
    """Gain in RMSE of every fitted model over the naive zero and over the ridge."""
    m = M.predictive_metrics(fitted_preds(spark, sf), SERIES)
    return rounded(M.improvement_pct(m, ["horizon", "symbol"], ["zero", "ridge"]))


def against_zero(preds):
    base = preds.filter("model = 'zero'").select("horizon", "symbol", "day", F.col("y_pred").alias("pred_b"))
    a = preds.filter("model <> 'zero'").withColumnRenamed("y_pred", "pred_a")
    return a.join(base, ["horizon", "symbol", "day"])


@register("diebold_mariano_fitted")
def q_dm(spark, sf):
    """Every fitted model against the naive zero: HLN statistic and its p-value (small: the model is better), h steps ahead."""
    pairs = against_zero(fitted_preds(spark, sf))
    out = None
    for h in (1, 5):
        d = M.diebold_mariano(pairs.filter(F.col("horizon") == h), SERIES, h)
        out = d if out is None else out.unionByName(d)
    return rounded(out.withColumn("p_value", t_cdf(F.col("stat"), (F.col("n") - 1).cast("double"))))


@register("pesaran_timmermann_fitted")
def q_pt(spark, sf):
    """Directional skill of the fitted models."""
    pt = M.pesaran_timmermann(fitted_preds(spark, sf).filter("model <> 'zero'"), SERIES)
    return rounded(pt.withColumn("p_value", norm_sf(F.col("stat"))))


@register("threshold_sweep_fitted")
def q_sweep(spark, sf):
    return rounded(M.threshold_sweep(fitted_preds(spark, sf), SERIES), 5)


@register("auc_roc_fitted")
def q_auc(spark, sf):
    """AUC of the direction classifier's scores on the test rows, per symbol."""
    p = QM.panel(spark, sf)
    s = QM.classifier_scores(p, QM.geometry(p)).withColumn("label", M.direction_label())
    return rounded(M.auc_roc(s, ["symbol"], "label", "score"))


@register("fold_regime_table_fitted")
def q_fold_regime(spark, sf):
    """Per fold of the ridge: first and last validation day, deviation and sum of returns, error, hits and regime."""
    p, _, coefs = QM.fold_coefs(spark, sf)
    s = LG.score(p, coefs, ["symbol"], QM.SHAPE).withColumn("horizon", QM.horizon())
    f = s.groupBy("symbol", "horizon", "fold").agg(
        F.min("day").alias("val_first"), F.max("day").alias("val_last"), F.stddev_pop("y_true").alias("sigma"),
        F.sum("y_true").alias("ret_sum"), M.rmse().alias("rmse"), M.directional_accuracy().alias("da"), F.count(F.lit(1)).alias("n"))
    return rounded(f.withColumn("regime", CAL.regime_label(F.col("val_first"), F.col("val_last"))))
