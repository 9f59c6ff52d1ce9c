"""Registered queries: fold reports, describe, regimes, guards and sinks (2.1, 2.2, 2.4, 2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as CAL
from ..operators import guards as GD
from ..operators import metrics as M
from ..operators import news as N
from ..operators import samples as SMP
from ..operators import series as S
from ..operators import splits as SP
from ..oracle.views import CTES, sql
from ..session import scratch_path, stage
from ..sources import fixtures as FX
from ..sources import manifest as MF
from ..sources import sinks as SK
from . import features as FT
from .q_eval import preds
from .q_features import FX_SYMBOLS
from .q_news import news_dedup
from .registry import R, register, rounded

CTES.update({
    "mom": (("preds",), """mom AS (
  SELECT model, horizon, symbol, day, y_true, y_pred, row_number() OVER (PARTITION BY model, horizon, symbol ORDER BY day) - 1 AS k
  FROM preds)"""),
    "wf": (("mom",), """wf AS (
  SELECT model, horizon, symbol, CAST(fold AS INTEGER) AS fold, mt + fold * vs AS val_lo, mt + (fold + 1) * vs AS val_hi
  FROM (SELECT model, horizon, symbol, n, mt, (n - mt) // 6 AS vs FROM (
          SELECT model, horizon, symbol, n, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt
          FROM (SELECT model, horizon, symbol, CAST(floor(count(*) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS n FROM mom
                GROUP BY model, horizon, symbol))) a,
       (SELECT unnest(range(0, 5)) AS fold) f
  WHERE mt + (fold + 1) * vs <= n)"""),
    "fm": (("wf",), """fm AS (
  SELECT w.model, w.horizon, w.symbol, w.fold, min(m.day) AS val_first, max(m.day) AS val_last, stddev_pop(m.y_true) AS sigma,
         sum(m.y_true) AS ret_sum, sqrt(avg(pow(m.y_true - m.y_pred, 2))) AS rmse,
         avg(CASE WHEN sign(m.y_true) = sign(m.y_pred) THEN 1.0 ELSE 0.0 END) AS da
  FROM wf w JOIN mom m ON m.model = w.model AND m.horizon = w.horizon AND m.symbol = w.symbol AND m.k >= w.val_lo AND m.k < w.val_hi
  GROUP BY w.model, w.horizon, w.symbol, w.fold)"""),
})


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


SERIES = ["model", "horizon", "symbol"]


def fold_metrics(spark, sf):
    """Walk-forward validation blocks over every model's predictions of each horizon and symbol, cut on the rows before the test."""
    m = S.with_position(preds(spark, sf).select(*SERIES, "day", "y_true", "y_pred"), SERIES, "day", out="k")
    n = SP.counts(m, SERIES).withColumn("n", SP.final_test_start(F.col("n")))
    folds = SP.walk_forward(n, SERIES)
    val = folds.select(*SERIES, "fold", F.col("val_lo").alias("lo"), F.col("val_hi").alias("hi"))
    a = SP.assign(m, val, SERIES, i="k")
    return a.groupBy(*SERIES, "fold").agg(
        F.min("day").alias("val_first"), F.max("day").alias("val_last"), F.stddev_pop("y_true").alias("sigma"),
        F.sum("y_true").alias("ret_sum"), M.rmse().alias("rmse"), M.directional_accuracy().alias("da"))


@register("fold_summary", R(sql("""SELECT model, horizon, symbol, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std,
  avg(da) AS da_mean, stddev_samp(da) AS da_std, count(*) AS n_folds FROM fm GROUP BY model, horizon, symbol""", "fm"),
                            "rmse_mean", "rmse_std", "da_mean", "da_std"))
def q_fold_summary(spark, sf):
    f = fold_metrics(spark, sf)
    return rounded(f.groupBy(*SERIES).agg(F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"),
                                          F.avg("da").alias("da_mean"), F.stddev_samp("da").alias("da_std"),
                                          F.count(F.lit(1)).alias("n_folds")))


@register("regime_label", sql(f"""SELECT model, horizon, symbol, fold, val_first, val_last, {CAL.REGIME_SQL.format(d0='val_first', d1='val_last')}
  AS regime FROM fm""", "fm"))
def q_regime_label(spark, sf):
    f = fold_metrics(spark, sf)
    return f.select(*SERIES, "fold", "val_first", "val_last",
                    CAL.regime_label(F.col("val_first"), F.col("val_last")).alias("regime"))


@register("fold_regime_table", R(sql(f"""SELECT model, horizon, symbol, fold, val_first, val_last, sigma, ret_sum, rmse, da,
  {CAL.REGIME_SQL.format(d0='val_first', d1='val_last')} AS regime FROM fm""", "fm"), "sigma", "ret_sum", "rmse", "da"))
def q_fold_regime(spark, sf):
    f = fold_metrics(spark, sf)
    return rounded(f.withColumn("regime", CAL.regime_label(F.col("val_first"), F.col("val_last"))))


@register("describe_returns", R(sql("""SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min,
  quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.75) AS q75, max(r) AS max
FROM rets GROUP BY symbol""", "rets"), "mean", "std", "min", "q25", "q50", "q75", "max"))
def q_describe(spark, sf):
    from ..operators.stats import exact_quantiles
    r = FT.returns_panel(_bars(spark, sf))
    d = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
                                F.min("r").alias("min"), F.max("r").alias("max"))
    q = exact_quantiles(r, ["symbol"], "r", [0.25, 0.5, 0.75]).select(
        "symbol", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return rounded(d.join(q, "symbol").select("symbol", "n", "mean", "std", "min", "q25", "q50", "q75", "max"))


@register("period_extreme", R(sql("""SELECT symbol, min(r) AS min_return, arg_min(day, r) AS min_day FROM rets
WHERE day BETWEEN DATE '1998-03-01' AND DATE '1998-04-30' GROUP BY symbol""", "rets"), "min_return"))
def q_period_extreme(spark, sf):
    r = FT.returns_panel(_bars(spark, sf))
    d = r.filter(F.col("day").between(F.lit("1998-03-01").cast("date"), F.lit("1998-04-30").cast("date")))
    return rounded(d.groupBy("symbol").agg(F.min("r").alias("min_return"), F.min_by("day", "r").alias("min_day")))


# ------------------------------------------------------------------ guards (2.10)

@register("guard_coverage_end", R(sql("""SELECT max(day) AS max_day,
  datediff('day', max(day), DATE '1995-12-31') / 30.44 AS months_missing,
  datediff('day', max(day), DATE '1995-12-31') / 30.44 <= 3 AS ok FROM dedup""", "dedup"), "months_missing"))
def q_guard_coverage(spark, sf):
    return rounded(GD.coverage_end(news_dedup(spark, sf), "1995-12-31"))


@register("guard_target_scale", R(sql("""SELECT symbol, stddev_pop(y1) AS std_t1, stddev_pop(y5) AS std_t5,
  stddev_pop(y5) >= 1.5 * stddev_pop(y1) AS ok FROM (
  SELECT symbol, lead(r, 1) OVER w AS y1,
         CASE WHEN count(r) OVER wf = 5 THEN sum(r) OVER wf END AS y5
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY day),
                   wf AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
WHERE y1 IS NOT NULL AND y5 IS NOT NULL GROUP BY symbol""", "rets"), "std_t1", "std_t5"))
def q_guard_target(spark, sf):
    t = SMP.targets(FT.returns_panel(_bars(spark, sf))).dropna(subset=["y_t1", "y_t5"])
    return rounded(GD.target_scale(t, ["symbol"]))


@register("guard_sorted", sql("""SELECT source, count(*) FILTER (WHERE day < prev) AS n_violations FROM (
  SELECT source, day, lag(day) OVER (PARTITION BY source ORDER BY row_no) AS prev FROM news) GROUP BY source""", "news"))
def q_guard_sorted(spark, sf):
    raw = FX.news_raw(spark, sf)
    v = N.sorted_violations(raw).groupBy("source").agg(F.count(F.lit(1)).alias("n_violations"))
    return (raw.select("source").distinct().join(v, "source", "left")
               .select("source", F.coalesce("n_violations", F.lit(0)).cast("long").alias("n_violations")))


@register("guard_non_empty", sql("SELECT count(*) AS n_rows, count(*) > 0 AS ok FROM dedup", "dedup"))
def q_guard_non_empty(spark, sf):
    return news_dedup(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("ok", F.col("n_rows") > 0)


@register("guard_volume", sql("SELECT count(*) AS n_rows, count(*) > 3000000 AS warn FROM dedup", "dedup"))
def q_guard_volume(spark, sf):
    return GD.volume(news_dedup(spark, sf))


_HASH_SQL = """count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5(
  concat_ws(chr(31), CAST(day AS VARCHAR), {headline}, body)), 1, 15) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS hash_sum"""
CHANGED_MONTH, REMOVED_MONTH = "1995-03", "1995-05"


@register("corpus_fingerprint", sql(f"SELECT {_HASH_SQL.format(headline='headline')} FROM dedup", "dedup"))
def q_corpus_fingerprint(spark, sf):
    """Content fingerprint of the corpus (row count + sum of 60-bit md5 row hashes)."""
    return GD.fingerprint(news_dedup(spark, sf), ["day", "headline", "body"])


@register("guard_checkpoint_input", sql(f"""SELECT m.*, o.n_days, o.n_chars FROM (
  SELECT strftime(day, '%Y-%m') AS ym, {_HASH_SQL.format(headline=f"headline || CASE WHEN strftime(day, '%Y-%m') = '{CHANGED_MONTH}' THEN '!' ELSE '' END")},
         CASE WHEN strftime(day, '%Y-%m') = '{CHANGED_MONTH}' THEN 'recomputed' ELSE 'kept' END AS status
  FROM dedup WHERE strftime(day, '%Y-%m') <> '{REMOVED_MONTH}' GROUP BY 1, 4
  UNION ALL SELECT DISTINCT '{REMOVED_MONTH}', NULL, NULL, 'removed' FROM dedup WHERE strftime(day, '%Y-%m') = '{REMOVED_MONTH}') m
LEFT JOIN (SELECT strftime(day, '%Y-%m') AS ym, count(DISTINCT day) AS n_days,
                  CAST(sum(length(headline) + CASE WHEN strftime(day, '%Y-%m') = '{CHANGED_MONTH}' THEN 1 ELSE 0 END) AS BIGINT) AS n_chars
           FROM dedup WHERE strftime(day, '%Y-%m') <> '{REMOVED_MONTH}' GROUP BY 1) o USING (ym)""", "dedup"))
def q_guard_checkpoint(spark, sf):
    """A per-day output computed once, then refreshed after one month of the corpus changed and one vanished: only the
    changed month is computed again; per month the stored fingerprint, what happened to it and its output."""
    path = scratch_path(spark, "checkpointed")
    corpus = stage(news_dedup(spark, sf).withColumn("ym", F.date_format("day", "yyyy-MM")), "corpus")
    changed = corpus.filter(F.col("ym") != REMOVED_MONTH).withColumn(
        "headline", F.when(F.col("ym") == CHANGED_MONTH, F.concat("headline", F.lit("!"))).otherwise(F.col("headline")))

    def per_day(rows):
        return rows.groupBy("ym", "day").agg(F.sum(F.length("headline")).alias("n_chars"))

    MF.refresh(spark, corpus, path, "ym", per_day, ["day", "headline", "body"])
    report = MF.refresh(spark, changed, path, "ym", per_day, ["day", "headline", "body"])
    out = (MF.output(spark, path).groupBy(F.col("ym").cast("string").alias("ym"))
           .agg(F.count(F.lit(1)).alias("n_days"), F.sum("n_chars").cast("long").alias("n_chars")))
    return report.join(out, "ym", "left")


# ------------------------------------------------------------------ sinks (2.1)

@register("sink_news_by_month", sql("""SELECT strftime(day, '%Y-%m') AS ym, count(*) AS n_rows, min(day) AS first_day,
  max(day) AS last_day FROM dedup GROUP BY 1""", "dedup"))
def q_sink_news(spark, sf):
    path = scratch_path(spark, "news-by-month")
    SK.sink_news_by_month(news_dedup(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("ym").agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"),
                                  F.max("day").alias("last_day"))


@register("sink_samples", R(sql("SELECT symbol, count(*) AS n_rows, sum(rsi_14) AS rsi_sum FROM feat GROUP BY symbol", "feat"),
                            "rsi_sum", digits=4))
def q_sink_samples(spark, sf):
    path = scratch_path(spark, "feature-panel")
    SK.sink_samples(FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf)).drop("_blk"), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rsi_14").alias("rsi_sum")), 4)


@register("sink_reports", R(sql("""SELECT model, horizon, symbol, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse
FROM preds GROUP BY model, horizon, symbol""", "preds"), "rmse"))
def q_sink_reports(spark, sf):
    path = scratch_path(spark, "report")
    rep = preds(spark, sf).groupBy("model", "horizon", "symbol").agg(M.rmse().alias("rmse"))
    SK.sink_report(rep, path, "json")
    back = spark.read.schema("model string, horizon int, symbol string, rmse double").json(path)
    return rounded(back)


@register("publish_if_valid", sql("""SELECT 'published' AS status, count(*) AS n_rows, max(day) AS max_day FROM dedup""",
                                  "dedup"))
def q_publish(spark, sf):
    """Stage the corpus, validate coverage and non-emptiness on the staged copy, then publish."""
    path = scratch_path(spark, "corpus")

    def validate(df):
        GD.enforce(GD.coverage_end(df, "1995-10-31"), "coverage")
        if df.isEmpty():
            raise GD.GuardError("empty corpus")

    status = SK.publish_if_valid(spark, news_dedup(spark, sf), path, validate)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.max("day").alias("max_day")).select(
        F.lit(status).alias("status"), "n_rows", "max_day")
