"""Registered queries: ridge folds, ensembles, trial search and selection (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convex as CV
from ..operators import indicators as IND
from ..operators import lagged as LG
from ..operators import models as MD
from ..operators import search as SR
from ..operators import series as S
from ..operators import splits as SP
from ..oracle.views import sql
from ..session import scratch_path, stage
from ..sources import fixtures as FX
from . import features as FT
from .q_features import FX_SYMBOLS
from .registry import R, register, rounded, rounded_sig

LOOKBACK = 30
FEATS = IND.FEATURES
XCOLS = [f"x_{f}" for f in FEATS]
YCOLS = ["y_t1", "y_t5"]


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


def design(spark, sf):
    """Samples with the features of the last window row (x_*) and both targets; j = i - L."""
    p = FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf)).drop(S.BLK)
    d = S.halo(p, before=1, after=5)
    w = S.block_window("symbol")
    for f in FEATS:
        d = d.withColumn(f"x_{f}", F.lag(f, 1).over(w))
    fwd = w.rowsBetween(1, 5)
    d = (d.withColumn("y_t1", F.lead("r", 1).over(w)).withColumn("y_t5", F.sum("r").over(fwd))
          .withColumn("_na", F.count(F.lit(1)).over(fwd)))
    d = S.own_rows(d).drop(S.BLK).filter((F.col("i") >= LOOKBACK) & (F.col("_na") == 5))
    d = d.select("symbol", "day", (F.col("i") - LOOKBACK).alias("j"), *XCOLS, *YCOLS)
    return stage(d, "design")


def wf_folds(des):
    """Five walk-forward folds on [0, test_start): no fold reads a test row."""
    n = test_geometry(des).select("symbol", F.col("test_start").alias("n"))
    return SP.walk_forward(n, ["symbol"]).withColumn("fold", F.col("fold").cast("int"))


def test_geometry(des):
    n = SP.counts(des, ["symbol"])
    return n.withColumn("test_start", SP.final_test_start(F.col("n")))


SHAPE = LG.Shape(tuple(FEATS), LOOKBACK, 5)


def panel(spark, sf):
    """The feature panel: the flattened windows of its rows are the models' inputs."""
    return FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf)).drop(S.BLK)


def geometry(p):
    """(symbol, n, test_start): samples of a symbol and the first one of its final test rows."""
    return stage(LG.sample_counts(p, ["symbol"], SHAPE).withColumn("test_start", SP.final_test_start(F.col("n"))), "geometry")


def pre_test_folds(geo, n_splits=5):
    """Walk-forward folds on [0, test_start): no fold reads a test row."""
    n = geo.select("symbol", F.col("test_start").alias("n"))
    return SP.walk_forward(n, ["symbol"], n_splits=n_splits).withColumn("fold", F.col("fold").cast("int"))


def final_fit(geo):
    """One fold per symbol: fitted on [0, test_start), scored on the test rows."""
    return geo.select("symbol", F.lit(0).alias("fold"), F.lit(0).cast("long").alias("train_lo"), F.col("test_start").alias("train_hi"),
                      F.col("test_start").alias("val_lo"), F.col("n").alias("val_hi"))


def fold_coefs(spark, sf):
    """(panel, geometry, coefficients): ridge of every walk-forward fold on all inputs of the window."""
    p = panel(spark, sf)
    geo = geometry(p)
    folds = pre_test_folds(geo)
    return p, geo, stage(LG.fit_folds(LG.lag_sums(p, folds, ["symbol"], SHAPE), folds, ["symbol"], SHAPE), "fold-coefs")


def on_test(coefs, geo):
    """The same coefficients for the test rows."""
    return coefs.drop("lo", "hi").join(geo.select("symbol", F.col("test_start").alias("lo"), F.col("n").alias("hi")), "symbol")


def horizon():
    return F.when(F.col("h") == 0, 1).otherwise(5).alias("horizon")


_SUM_EXPRS = (["count(*) AS n"] + [f"sum({c}) AS sx_{j}" for j, c in enumerate(XCOLS)]
              + [f"sum({c}) AS sy_{h}" for h, c in enumerate(YCOLS)]
              + [f"sum({XCOLS[a]} * {XCOLS[b]}) AS sxx_{a}_{b}" for a in range(len(XCOLS)) for b in range(a, len(XCOLS))]
              + [f"sum({x} * {y}) AS sxy_{j}_{h}" for h, y in enumerate(YCOLS) for j, x in enumerate(XCOLS)]
              + [f"sum({y} * {y}) AS syy_{h}" for h, y in enumerate(YCOLS)])
_SUM_COLS = [e.split(" AS ")[1] for e in _SUM_EXPRS[1:]]

_DESIGN_SQL = ("SELECT symbol, day, j, " + ", ".join(f"x_{f}" for f in FEATS) + ", y_t1, y_t5 FROM ("
               "SELECT symbol, day, i - 30 AS j, " + ", ".join(f"lag({f}) OVER w AS x_{f}" for f in FEATS)
               + ", lead(r, 1) OVER w AS y_t1, sum(r) OVER wf AS y_t5, count(*) OVER wf AS na FROM feat "
               "WINDOW w AS (PARTITION BY symbol ORDER BY i), "
               "wf AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) "
               "WHERE j >= 0 AND na = 5")

_GRAM_SQL = f"""SELECT symbol, seg_lo, seg_hi, {', '.join(_SUM_EXPRS)} FROM (
  SELECT d.*, CASE WHEN j < mt THEN 0 ELSE mt + CAST(floor((j - mt) / vs) AS BIGINT) * vs END AS seg_lo,
         CASE WHEN j < mt THEN mt ELSE mt + (CAST(floor((j - mt) / vs) AS BIGINT) + 1) * vs END AS seg_hi,
         mt + 5 * vs AS last_hi
  FROM dz d JOIN (SELECT symbol, mt, (n - mt) // 6 AS vs FROM (
      SELECT symbol, n, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt FROM (
        SELECT symbol, CAST(floor(count(*) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS n FROM dz GROUP BY symbol))) g USING (symbol))
WHERE j < last_hi GROUP BY symbol, seg_lo, seg_hi"""


@register("ridge_gram_sums", R(sql(_GRAM_SQL, "feat", extra=f"dz AS ({_DESIGN_SQL})"), sig=tuple(_SUM_COLS),
                               sig_digits=8))
def q_gram(spark, sf):
    des = design(spark, sf)
    sums = MD.segment_sums(des, wf_folds(des), ["symbol"], XCOLS, YCOLS)
    return rounded_sig(sums, _SUM_COLS, 8)


_LAG_SQL = f"""SELECT symbol, seg AS bound, lag, f, g, sum(v) / max(m) AS mean FROM (
  SELECT a.symbol, s.seg, s.m, CAST(b.i - a.i AS INTEGER) AS lag, fl.f, gl.g, list_extract(b.x, fl.k) * list_extract(a.x, gl.k) AS v
  FROM cx a JOIN cx b ON b.symbol = a.symbol AND b.i BETWEEN a.i AND a.i + {LOOKBACK - 1}
  JOIN sg s ON s.symbol = a.symbol AND a.i >= s.seg AND a.i < s.seg_hi
  CROSS JOIN fn fl CROSS JOIN (SELECT f AS g, k FROM fn) gl)
GROUP BY symbol, seg, lag, f, g"""
_LAG_CTES = f"""cx AS (SELECT symbol, i, [{', '.join(f'{f} - avg({f}) OVER (PARTITION BY symbol)' for f in FEATS)}] AS x FROM feat),
fn AS (SELECT unnest([{', '.join(f"'{f}'" for f in FEATS)}]) AS f, unnest(range(1, {len(FEATS) + 1})) AS k),
sg AS (SELECT symbol, CASE k WHEN 0 THEN 0 ELSE mt + (k - 1) * vs END AS seg, mt + k * vs AS seg_hi, CASE k WHEN 0 THEN mt ELSE vs END AS m
       FROM (SELECT symbol, mt, (n - mt) // 6 AS vs, unnest(range(0, 6)) AS k FROM (
         SELECT symbol, n, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt FROM (
           SELECT symbol, CAST(floor((count(*) - {LOOKBACK + 5}) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS n FROM feat GROUP BY symbol HAVING count(*) > {LOOKBACK + 5}))))"""


@register("lagged_gram_sums", R(sql(_LAG_SQL, "feat", extra=_LAG_CTES), "mean", digits=4))
def q_lag_sums(spark, sf):
    """Mean lag products of the centred inputs per fold segment: all that the Gram matrices of the windows are made of."""
    p = panel(spark, sf)
    sums = LG.lag_sums(p, pre_test_folds(geometry(p)), ["symbol"], SHAPE)
    return rounded(LG.edge_free_sums(sums, ["symbol"], SHAPE), 4)


@register("fold_predictions")
def q_fold_predictions(spark, sf):
    """Every walk-forward fold: own scaler and ridge on its flattened training windows, scored on its validation rows."""
    p, _, coefs = fold_coefs(spark, sf)
    s = LG.score(p, coefs, ["symbol"], SHAPE)
    return rounded(s.select("symbol", "fold", "day", horizon(), "y_true", "y_pred"))


@register("best_fold")
def q_best_fold(spark, sf):
    """Fold with the lowest validation loss per symbol and horizon (min_by; ties to the lower fold)."""
    _, _, coefs = fold_coefs(spark, sf)
    return rounded(coefs.groupBy("symbol", "h").agg(
        F.min_by("fold", F.struct("val_mse", "fold")).alias("best_fold"), F.min("val_mse").alias("val_mse")))


def ensemble(p, geo, coefs):
    """Mean prediction of all folds on the test rows."""
    s = LG.score(p, on_test(coefs, geo), ["symbol"], SHAPE)
    return s.groupBy("symbol", "h", "j", "day").agg(F.avg("y_pred").alias("y_pred"), F.first("y_true").alias("y_true"), F.count(F.lit(1)).alias("n_folds"))


@register("fold_ensemble")
def q_fold_ensemble(spark, sf):
    """Average of all fold models on the final test rows, each fold with its own scaler."""
    s = ensemble(*fold_coefs(spark, sf))
    return rounded(s.select("symbol", "day", "y_pred", "y_true", "n_folds", horizon()))


def ridge_predictions(p, geo):
    """(symbol, h, j, day, y_true, y_pred) of the ridge fitted on all rows before the test rows."""
    folds = final_fit(geo)
    coefs = LG.fit_folds(LG.lag_sums(p, folds, ["symbol"], SHAPE), folds, ["symbol"], SHAPE)
    return LG.score(p, coefs, ["symbol"], SHAPE).drop("fold")


@register("ridge_baseline")
def q_ridge(spark, sf):
    """Ridge (alpha 1) per horizon on the flattened 30 x 10 windows, standardised with the scaler of the
    flattened train + val windows (first 85 % of samples); predictions on the test rows."""
    p = panel(spark, sf)
    return rounded(ridge_predictions(p, geometry(p)).select("symbol", "day", horizon(), "y_true", "y_pred"))


@register("batch_score")
def q_batch_score(spark, sf):
    """Test rows scored with a stored coefficient table, both horizons: that of each symbol's best fold."""
    p, geo, coefs = fold_coefs(spark, sf)
    path = scratch_path(spark, "coefs")
    coefs.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    best = stored.groupBy("symbol", "h").agg(F.min_by(F.struct("fold", "a", "b"), F.struct("val_mse", "fold")).alias("_c")).select("symbol", "h", "_c.*")
    s = LG.score(p, best.join(geo.select("symbol", F.col("test_start").alias("lo"), F.col("n").alias("hi")), "symbol"), ["symbol"], SHAPE)
    return rounded(s.select("symbol", "day", horizon(), "fold", "y_true", "y_pred"))


# ------------------------------------------------------------------ search

def _symbols(spark, sf):
    return _bars(spark, sf).select("symbol").distinct()


_U = "CAST('0x' || substr(md5('42:' || symbol || ':' || trial || ':{n}'), 1, 13) AS BIGINT) / 4503599627370496.0"


@register("sample_trials", R(sql(f"""SELECT symbol, trial,
  exp(ln(1e-4) + {_U.format(n='lr')} * (ln(5e-3) - ln(1e-4))) AS lr,
  exp(ln(1e-6) + {_U.format(n='weight_decay')} * (ln(1e-3) - ln(1e-6))) AS weight_decay,
  [64, 128, 256][CAST(floor({_U.format(n='hidden_size')} * 3) AS INTEGER) + 1] AS hidden_size,
  [32, 64, 128][CAST(floor({_U.format(n='d_model')} * 3) AS INTEGER) + 1] AS d_model,
  0.1 + {_U.format(n='dropout')} * 0.4 AS dropout,
  0.3 + {_U.format(n='w_t1')} * 0.5 AS w_t1,
  1 - (0.3 + {_U.format(n='w_t1')} * 0.5) AS w_t5
FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(0, 40)) AS trial)""", "bars"),
                                 "lr", "weight_decay", "dropout", "w_t1", "w_t5", digits=9))
def q_sample_trials(spark, sf):
    t = SR.sample_trials(spark, 40, SR.REFERENCE_SPACE, seed=42, keys=_symbols(spark, sf), key="symbol")
    return rounded(t, 9)


def ridge_trials(spark, n=40):
    """The trial table of the ridge space: a few rows, the same for every symbol."""
    return SR.sample_trials(spark, n, SR.RIDGE_SPACE, seed=42)


@register("sample_ridge_trials", R(sql(f"""SELECT symbol, trial, exp(ln(1e-3) + {_U.format(n='alpha')} * (ln(1e3) - ln(1e-3))) AS alpha,
  [1, 5, 10, 20, 30][CAST(floor({_U.format(n='n_lags')} * 5) AS INTEGER) + 1] AS n_lags,
  0.3 + {_U.format(n='w_t1')} * 0.5 AS w_t1, 1 - (0.3 + {_U.format(n='w_t1')} * 0.5) AS w_t5
FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(0, 40)) AS trial)""", "bars"), "alpha", "w_t1", "w_t5", digits=9))
def q_sample_ridge_trials(spark, sf):
    """The re-aimed space (penalty, lags, horizon weight), 40 trials per symbol."""
    return rounded(SR.sample_trials(spark, 40, SR.RIDGE_SPACE, seed=42, keys=_symbols(spark, sf), key="symbol"), 9)


def trial_losses(p, folds, trials):
    return LG.trial_losses(LG.lag_sums(p, folds, ["symbol"], SHAPE), folds, ["symbol"], trials.toPandas(), SHAPE)


@register("evaluate_trials")
def q_evaluate_trials(spark, sf):
    """40 ridge trials x 3 inner folds on [0, test_start) per symbol, all losses from lag sums."""
    p = panel(spark, sf)
    return rounded(trial_losses(p, pre_test_folds(geometry(p), 3), ridge_trials(spark)))


_REC_SQL = """SELECT trial, hidden, d_model, dropout, weight_decay,
  CASE WHEN count(loss) = count(*) THEN avg(loss) END AS mean_loss,
  CASE WHEN count(loss) = count(*) THEN CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_samp(loss) / sqrt(count(*)) END END AS se,
  count(*) AS k
FROM trials GROUP BY trial, hidden, d_model, dropout, weight_decay"""

PARAMS = ["hidden", "d_model", "dropout", "weight_decay"]


def records(spark, sf):
    return SR.trial_records(FX.trials(spark, sf), params=PARAMS)


@register("trial_records", R(sql(_REC_SQL, "trials"), "mean_loss", "se"))
def q_trial_records(spark, sf):
    return rounded(records(spark, sf))


@register("select_one_se", R(sql(f"""SELECT r.* FROM rec r WHERE r.trial = (
  SELECT arg_min(trial, row(hidden, d_model, -dropout, -weight_decay, trial)) FROM rec
  WHERE mean_loss IS NOT NULL AND mean_loss <= (SELECT arg_min(mean_loss + se, row(mean_loss, trial)) FROM rec
                                                WHERE mean_loss IS NOT NULL))""", "trials", extra=f"rec AS ({_REC_SQL})"),
                             "mean_loss", "se"))
def q_select_one_se(spark, sf):
    par = [F.col("hidden"), F.col("d_model"), -F.col("dropout"), -F.col("weight_decay")]
    return rounded(SR.select_one_se(records(spark, sf), par))


_SU = "CAST('0x' || substr(md5('42:' || trial || ':{n}'), 1, 13) AS BIGINT) / 4503599627370496.0"


@register("resume_trials", R(sql(f"""SELECT trial, CASE WHEN trial < n THEN 1 ELSE 2 END AS run, count(*) AS k, avg(loss) AS mean_loss FROM (
  SELECT trial, n, 1 + (0.1 + {_SU.format(n='dropout')} * 0.4) + [64, 128, 256][CAST(floor({_SU.format(n='hidden_size')} * 3) AS INTEGER) + 1] / 1000.0
    + 0.01 * (fold - 1) AS loss
  FROM (SELECT n, unnest(range(0, CAST(n + ceil(n * 0.1) AS BIGINT))) AS trial FROM (SELECT count(DISTINCT trial) AS n FROM trials)),
       (SELECT unnest(range(0, 3)) AS fold))
GROUP BY trial, n""", "trials"), "mean_loss"))
def q_resume(spark, sf):
    """A study of as many trials as the table holds, then asked for a tenth more, then asked for the same again: the second
    run evaluates the missing trials into the same table, the third adds nothing."""
    path = scratch_path(spark, "study")
    n = FX.trials(spark, sf).select("trial").distinct().count()   # a scalar
    folds = spark.range(3).select(F.col("id").cast("int").alias("fold"))
    asked = [SR.sample_trials(spark, k, SR.REFERENCE_SPACE, seed=42) for k in (n, n - (-n // 10))]
    runs, known = [], None
    for trials in (asked[0], asked[1], asked[1]):
        records = SR.resume_study(spark, path, trials, folds, synthetic_loss)
        new = records if known is None else records.join(known, "trial", "left_anti")
        runs.append(stage(new.select("trial", "fold", "loss", F.lit(len(runs) + 1).alias("run")), "study-new"))
        known = records.select("trial").distinct()
    return rounded(runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("trial", "run").agg(
        F.count(F.lit(1)).alias("k"), F.avg("loss").alias("mean_loss")))


@register("huber_two_horizon")
def q_huber(spark, sf):
    """Per symbol, Huber fits (delta 1) of both horizons on the flattened windows of the first 85 %; two-horizon loss
    (.6 and .4, t+5 over sqrt 5) of the test rows."""
    p = panel(spark, sf)
    geo = geometry(p)
    fit = CV.fit(p, geo.select("symbol", F.lit(0).cast("long").alias("lo"), F.col("test_start").alias("hi")), ["symbol"], SHAPE, "huber")
    s = LG.score(p, on_test(fit.select("symbol", "h", "a", "b", F.lit(0).alias("lo"), F.lit(0).alias("hi")), geo), ["symbol"], SHAPE, ids=())
    error = F.col("y_true") - F.col("y_pred")
    both = s.groupBy("symbol", "j").agg(*[F.max(F.when(F.col("h") == h, error)).alias(f"e{h}") for h in range(2)])
    return rounded(both.groupBy("symbol").agg(F.avg(MD.two_horizon_loss(F.col("e0"), F.col("e1"))).alias("loss"), F.count(F.lit(1)).alias("n")))


def classifier_scores(p, geo):
    """(symbol, day, y_true, score): log-odds of a rising next day on the test rows."""
    fit = CV.fit(p, geo.select("symbol", F.lit(0).cast("long").alias("lo"), F.col("test_start").alias("hi")), ["symbol"], SHAPE, "logistic")
    coefs = on_test(fit.select("symbol", "h", "a", "b", F.lit(0).alias("lo"), F.lit(0).alias("hi")), geo)
    return LG.score(p, coefs, ["symbol"], SHAPE, ids=()).withColumnRenamed("y_pred", "score")


@register("direction_classifier")
def q_classifier(spark, sf):
    """Per symbol, weighted logistic regression of the next-day direction on the flattened windows; accuracy on the test rows."""
    p = panel(spark, sf)
    s = classifier_scores(p, geometry(p))
    hit = (F.col("score") > 0) == (F.col("y_true") > 0)
    return rounded(s.groupBy("symbol").agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


def synthetic_loss(pdf):
    return 1 + pdf["dropout"] + pdf["hidden_size"] / 1000.0 + 0.01 * (pdf["fold"] - 1)


@register("evaluate_fn", R(sql(f"""SELECT symbol, trial, CAST(fold AS INTEGER) AS fold,
  1 + (0.1 + {_U.format(n='dropout')} * 0.4) + [64, 128, 256][CAST(floor({_U.format(n='hidden_size')} * 3) AS INTEGER) + 1] / 1000.0
    + 0.01 * (fold - 1) AS loss
FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(0, 40)) AS trial), (SELECT unnest(range(0, 3)) AS fold)""",
                                   "bars"), "loss"))
def q_evaluate_fn(spark, sf):
    """Any evaluator injected into the search: here the synthetic one of the reference tests
    (1 + dropout + hidden / 1000, +-0.01 by fold) over every symbol's 40 trials x 3 folds."""
    trials = SR.sample_trials(spark, 40, SR.REFERENCE_SPACE, seed=42, keys=_symbols(spark, sf), key="symbol")
    folds = spark.range(3).select(F.col("id").cast("int").alias("fold"))

    r = SR.evaluate_with(trials, folds, synthetic_loss)
    return rounded(r.select("symbol", "trial", "fold", "loss"))


def _nested_folds(geo):
    """Outer and inner walk-forward folds of [0, test_start) as one wide table with string fold ids."""
    nest = SP.nested(geo.select("symbol", F.col("test_start").alias("n")), ["symbol"])
    fid = F.concat(F.col("outer_fold").cast("string"), F.lit("."), F.coalesce(F.col("inner_fold").cast("string"), F.lit("-")))
    w = nest.withColumn("fold", fid)
    return (w.groupBy("symbol", "fold", "outer_fold", "inner_fold")
             .agg(F.max(F.when(F.col("role") == "train", F.col("lo"))).alias("train_lo"),
                  F.max(F.when(F.col("role") == "train", F.col("hi"))).alias("train_hi"),
                  F.max(F.when(F.col("role") == "val", F.col("lo"))).alias("val_lo"),
                  F.max(F.when(F.col("role") == "val", F.col("hi"))).alias("val_hi")))


def simpler():
    """Fewer lags first, then a larger penalty."""
    return [F.col("n_lags"), -F.col("alpha")]


@register("nested_search")
def q_nested_search(spark, sf):
    """Per symbol and outer fold: 40 ridge trials on the 3 inner folds, one-SE choice (fewer lags, then larger
    alpha = simpler), chosen trial scored on the outer validation block; all from lag sums."""
    p = panel(spark, sf)
    folds = stage(_nested_folds(geometry(p)), "nested-folds")
    trials = ridge_trials(spark)
    ranges = folds.select("symbol", "fold", "train_lo", "train_hi", "val_lo", "val_hi")
    l = stage(trial_losses(p, ranges, trials), "nested-losses").join(folds.select("symbol", "fold", "outer_fold", "inner_fold"), ["symbol", "fold"])
    recs = SR.trial_records(l.filter(F.col("inner_fold").isNotNull()), params=["symbol", "outer_fold"]).join(trials, "trial")
    chosen = SR.select_one_se(recs, simpler(), keys=["symbol", "outer_fold"])
    outer = l.filter(F.col("inner_fold").isNull()).select("symbol", "outer_fold", "trial", F.col("loss").alias("outer_loss"))
    res = chosen.join(outer, ["symbol", "outer_fold", "trial"], "inner")
    return rounded(res.select("symbol", "outer_fold", "trial", "alpha", "n_lags", "mean_loss", "se", "outer_loss"))


@register("final_search")
def q_final_search(spark, sf):
    """Search on [0, test_start) (3 inner folds), one-SE winner per symbol; all trials and the
    winners are written as reports, the winners returned."""
    from ..sources import sinks as SK
    p = panel(spark, sf)
    trials = ridge_trials(spark)
    losses = trial_losses(p, pre_test_folds(geometry(p), 3), trials)
    recs = stage(SR.trial_records(losses, params=["symbol"]).join(trials, "trial"), "final-search-trials")
    win = SR.select_one_se(recs, simpler(), keys=["symbol"])
    SK.sink_report(recs, scratch_path(spark, "search-trials"))
    SK.sink_report(win, scratch_path(spark, "search-winners"))
    return rounded(win.select("symbol", "trial", "alpha", "n_lags", "w_t1", "w_t5", "mean_loss", "se", "k"))
