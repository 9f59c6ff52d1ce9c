"""Registered queries: splits, nested folds, scalers, fold leakage guard (2.6, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as IND
from ..operators import samples as SMP
from ..operators import scaling as SC
from ..operators import splits as SP
from ..oracle.views import CTES, sql
from ..session import stage
from ..sources import fixtures as FX
from . import features as FT
from .q_features import FX_SYMBOLS
from .registry import R, register, rounded

LOOKBACK = 30
FEATS = IND.FEATURES

CTES.update({
    "samp": (("feat",), """samp AS (
  SELECT symbol, day, i, y_t1, y_t5, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS j FROM (
    SELECT symbol, day, i, lead(r, 1) OVER w AS y_t1, sum(r) OVER wf AS y_t5, count(*) OVER wf AS n_after
    FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY i),
                     wf AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
  WHERE i >= 30 AND n_after = 5)"""),
    "sn": (("samp",), "sn AS (SELECT symbol, count(*) AS n FROM samp GROUP BY symbol)"),
    "nest": (("sn",), """o1 AS (SELECT symbol, ts AS n, CAST(floor(ts * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt
  FROM (SELECT symbol, CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) AS BIGINT) AS ts FROM sn)),
o2 AS (SELECT symbol, n, mt, (n - mt) // 6 AS vs, o FROM o1, (SELECT unnest(range(0, 5)) AS o) r),
outer_f AS (SELECT symbol, CAST(o AS INTEGER) AS outer_fold, 0 AS tlo, mt + o * vs AS thi, mt + o * vs AS vlo,
                   mt + (o + 1) * vs AS vhi FROM o2 WHERE mt + (o + 1) * vs <= n),
i1 AS (SELECT symbol, outer_fold, thi AS m, CAST(floor(thi * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt FROM outer_f),
i2 AS (SELECT symbol, outer_fold, m, mt, (m - mt) // 4 AS vs, k FROM i1, (SELECT unnest(range(0, 3)) AS k) r),
inner_f AS (SELECT symbol, outer_fold, CAST(k AS INTEGER) AS inner_fold, 0 AS tlo, mt + k * vs AS thi,
                   mt + k * vs AS vlo, mt + (k + 1) * vs AS vhi FROM i2 WHERE mt + (k + 1) * vs <= m),
nest AS (
  SELECT symbol, outer_fold, CAST(NULL AS INTEGER) AS inner_fold, 'train' AS role, CAST(tlo AS BIGINT) AS lo, thi AS hi FROM outer_f
  UNION ALL SELECT symbol, outer_fold, NULL, 'val', vlo, vhi FROM outer_f
  UNION ALL SELECT symbol, outer_fold, inner_fold, 'train', tlo, thi FROM inner_f
  UNION ALL SELECT symbol, outer_fold, inner_fold, 'val', vlo, vhi FROM inner_f)"""),
})


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


def panel(spark, sf):
    return FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf))


def samples(spark, sf):
    """Valid samples ``(symbol, day, i, j)``; j = i - L.  Positions are contiguous, so a sample needs L rows before it
    and 5 after it; no value is looked at."""
    p = stage(FT.feature_positions(_bars(spark, sf), FX.vol_index(spark, sf)), "positions")
    d = p.join(SP.counts(p, ["symbol"]), "symbol")
    return (d.filter((F.col("i") >= LOOKBACK) & (F.col("i") < F.col("n") - 5))
             .select("symbol", "day", "i", (F.col("i") - LOOKBACK).alias("j")))


def sample_counts(spark, sf):
    """Samples per symbol: the panel's rows less the lookback and the longest horizon."""
    n = FT.feature_counts(_bars(spark, sf), FX.vol_index(spark, sf))
    return n.withColumn("n", F.col("n") - LOOKBACK - 5).filter("n > 0")


@register("walk_forward_splits", sql("""SELECT symbol, CAST(fold AS INTEGER) AS fold, CAST(0 AS BIGINT) AS train_lo,
  mt + fold * vs AS train_hi, mt + fold * vs AS val_lo, mt + (fold + 1) * vs AS val_hi
FROM (SELECT symbol, n, mt, (n - mt) // 6 AS vs FROM (
        SELECT symbol, n, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS mt FROM sn)) a,
     (SELECT unnest(range(0, 5)) AS fold) f
WHERE mt + (fold + 1) * vs <= n""", "sn"))
def q_walk_forward(spark, sf):
    return SP.walk_forward(sample_counts(spark, sf), ["symbol"])


@register("final_test_split", sql("""SELECT symbol, n, CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) AS BIGINT)
  AS test_start FROM sn""", "sn"))
def q_final_test(spark, sf):
    return sample_counts(spark, sf).withColumn("test_start", SP.final_test_start(F.col("n")))


@register("static_split", sql("""SELECT symbol, role, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT s.symbol, s.day, CASE WHEN s.i < floor(n.n * CAST(0.7 AS DOUBLE)) - 1 THEN 'train'
    WHEN s.i < floor(n.n * CAST(0.85 AS DOUBLE)) - 1 THEN 'val' ELSE 'test' END AS role
  FROM (SELECT symbol, day, i, lead(r, 1) OVER (PARTITION BY symbol ORDER BY i) AS y FROM feat) s
  JOIN (SELECT symbol, count(*) AS n FROM feat GROUP BY symbol) n USING (symbol)
  WHERE s.i >= 30 AND s.y IS NOT NULL) GROUP BY symbol, role""", "feat"))
def q_static(spark, sf):
    p = stage(FT.feature_positions(_bars(spark, sf), FX.vol_index(spark, sf)), "positions")
    # The next return exists for all rows but the last one.
    t = p.join(SP.counts(p, ["symbol"]), "symbol").filter((F.col("i") >= LOOKBACK) & (F.col("i") < F.col("n") - 1))
    r = t.withColumn("role", SP.static_roles(F.col("i"), F.col("n")))
    return r.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"),
                                          F.max("day").alias("last_day"))


@register("train_cut", sql("""SELECT symbol, count(*) AS n_paths,
  count(*) FILTER (WHERE k < floor(np * CAST(0.85 AS DOUBLE))) AS n_train FROM (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS np
  FROM (SELECT symbol, day, count(*) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS na
        FROM rets) WHERE na = 20) GROUP BY symbol""", "rets"))
def q_train_cut(spark, sf):
    paths = SMP.return_paths(FT.returns_panel(_bars(spark, sf)), 20)
    n = SP.counts(paths, ["symbol"]).withColumnRenamed("n", "n_paths")
    # paths start at every position from the first return on, so k = i - first position
    first = paths.groupBy("symbol").agg(F.min("i").alias("_i0"))
    d = paths.join(n, "symbol").join(first, "symbol").withColumn("_k", F.col("i") - F.col("_i0"))
    return d.groupBy("symbol").agg(F.first("n_paths").alias("n_paths"),
                                   F.count_if(F.col("_k") < SP._floor_frac(F.col("n_paths"), 0.85)).alias("n_train"))


@register("nested_splits", sql("SELECT symbol, outer_fold, inner_fold, role, lo, hi FROM nest", "nest"))
def q_nested(spark, sf):
    return SP.nested(sample_counts(spark, sf), ["symbol"], test_frac=0.15)


@register("guard_fold_leakage", sql("""SELECT f.symbol, f.outer_fold, f.inner_fold,
  count(*) FILTER (WHERE f.role = 'train') AS n_train, count(*) FILTER (WHERE f.role = 'val') AS n_val,
  max(s.day) FILTER (WHERE f.role = 'train') < min(s.day) FILTER (WHERE f.role = 'val')
    AND max(s.j) < max(ts.test_start) AS ok
FROM nest f JOIN samp s ON s.symbol = f.symbol AND s.j >= f.lo AND s.j < f.hi
JOIN (SELECT symbol, CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) AS BIGINT) AS test_start FROM sn) ts
  ON ts.symbol = f.symbol
GROUP BY f.symbol, f.outer_fold, f.inner_fold""", "nest"))
def q_fold_leakage(spark, sf):
    s = samples(spark, sf)
    n = SP.counts(s, ["symbol"]).withColumn("test_start", SP.final_test_start(F.col("n"))).drop("n")
    folds = SP.nested(SP.counts(s, ["symbol"]), ["symbol"], test_frac=0.15)
    a = SP.assign(s, folds, ["symbol"], i="j").join(n, "symbol")
    tr, va = F.col("role") == "train", F.col("role") == "val"
    g = a.groupBy("symbol", "outer_fold", "inner_fold").agg(
        F.count_if(tr).alias("n_train"), F.count_if(va).alias("n_val"),
        F.max(F.when(tr, F.col("day"))).alias("_tmax"), F.min(F.when(va, F.col("day"))).alias("_vmin"),
        F.max("j").alias("_jmax"), F.max("test_start").alias("_ts"))
    return g.select("symbol", "outer_fold", "inner_fold", "n_train", "n_val",
                    ((F.col("_tmax") < F.col("_vmin")) & (F.col("_jmax") < F.col("_ts"))).alias("ok"))


_FIT_ROWS_SQL = " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature, avg({f}) AS mean, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END "
    f"AS std, count(*) AS n_fit FROM fr GROUP BY symbol" for f in FEATS)


@register("fit_scaler_rows", R(sql(_FIT_ROWS_SQL, "feat", extra="""fr AS (
  SELECT feat.* FROM feat JOIN (SELECT symbol, count(*) AS n FROM feat GROUP BY symbol) c USING (symbol)
  WHERE feat.i < floor(c.n * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))))"""), "mean", "std"))
def q_fit_rows(spark, sf):
    p = panel(spark, sf)
    n = SP.counts(p, ["symbol"])
    return rounded(SC.fit_rows(p.join(n, "symbol"), ["symbol"], FEATS, SP.final_test_start(F.col("n"))))


_FIT_WIN_SQL = " UNION ALL ".join(
    f"SELECT symbol, '{f}' AS feature, avg({f}) AS mean, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END "
    f"AS std, count(*) AS n_fit FROM fw GROUP BY symbol" for f in FEATS)

_FW = """fw AS (
  SELECT p.* FROM samp s
  JOIN (SELECT symbol, CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) AS BIGINT) AS ts FROM sn) t
    ON t.symbol = s.symbol AND s.j < t.ts
  JOIN feat p ON p.symbol = s.symbol AND p.i >= s.i - 30 AND p.i < s.i)"""


def window_scaler(spark, sf, p=None):
    p = p if p is not None else panel(spark, sf)
    n = SP.counts(p, ["symbol"]).withColumn("n", F.col("n") - LOOKBACK - 5)  # valid samples per symbol
    n = n.withColumn("_ts", SP.final_test_start(F.col("n")))
    a = F.lit(LOOKBACK)
    b = F.lit(LOOKBACK) + F.col("_ts")
    return SC.fit_windows(p.join(n, "symbol"), ["symbol"], FEATS, a, b, LOOKBACK)


@register("fit_scaler_windows", R(sql(_FIT_WIN_SQL, "samp", "sn", extra=_FW), "mean", "std"))
def q_fit_windows(spark, sf):
    return rounded(window_scaler(spark, sf))


_APPLY_SQL = ("SELECT p.symbol, p.day, " + ", ".join(
    f"(p.{f} - s_{f}.mean) / s_{f}.std AS {f}" for f in FEATS) + " FROM feat p " + " ".join(
    f"JOIN st s_{f} ON s_{f}.symbol = p.symbol AND s_{f}.feature = '{f}'" for f in FEATS))


@register("apply_scaler", R(sql(_APPLY_SQL, "samp", "sn", extra=_FW + ",\nst AS (" + _FIT_WIN_SQL + ")"), *FEATS,
                            digits=4))
def q_apply_scaler(spark, sf):
    full = panel(spark, sf)
    p = full.select("symbol", "day", *FEATS)
    return rounded(SC.apply(p, window_scaler(spark, sf, full), ["symbol"], FEATS), 4)
