"""Registered queries: distribution and time-series statistics (2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adf as ADF
from ..operators import indicators as IND
from ..operators import stats as ST
from ..oracle.views import CTES, sql
from ..session import stage
from ..sources import fixtures as FX
from . import features as FT
from .q_features import FX_SYMBOLS
from .registry import R, register, rounded

FEATS = IND.FEATURES
SPLIT_DAY = "1998-06-30"

CTES.update({
    "rp": (("rets",), """rp AS (SELECT symbol, day, r, abs(r) AS ar,
  row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets)"""),
})


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


def rets(spark, sf):
    return FT.returns_panel(_bars(spark, sf))


@register("moments_population", R(sql("""SELECT symbol, count(*) AS n,
  avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew_pop, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) - 3 AS kurt_pop
FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m FROM rets) GROUP BY symbol""", "rets"),
                                      "skew_pop", "kurt_pop"))
def q_moments_pop(spark, sf):
    return rounded(ST.moments(rets(spark, sf), ["symbol"], "r").select("symbol", "n", "skew_pop", "kurt_pop"))


@register("moments_sample", R(sql("""SELECT symbol, count(*) AS n, skewness(r) AS skew_sample, kurtosis(r) AS kurt_sample
FROM rets GROUP BY symbol""", "rets"), "skew_sample", "kurt_sample"))
def q_moments_sample(spark, sf):
    return rounded(ST.moments(rets(spark, sf), ["symbol"], "r").select("symbol", "n", "skew_sample", "kurt_sample"))


@register("histogram_fixed", R(sql("""SELECT g.symbol, CAST(g.bin AS INTEGER) AS bin, g.lo + g.bin * (g.hi - g.lo) / 80 AS bin_lo,
  g.lo + (g.bin + 1) * (g.hi - g.lo) / 80 AS bin_hi, coalesce(c.n, 0) AS count
FROM (SELECT symbol, lo, hi, unnest(range(0, 80)) AS bin FROM (SELECT symbol, min(r) AS lo, max(r) AS hi FROM rets GROUP BY symbol)) g
LEFT JOIN (SELECT symbol, CAST(least(floor((r - lo) / (hi - lo) * 80), 79) AS INTEGER) AS bin, count(*) AS n
           FROM rets JOIN (SELECT symbol, min(r) AS lo, max(r) AS hi FROM rets GROUP BY symbol) USING (symbol)
           GROUP BY ALL) c ON c.symbol = g.symbol AND c.bin = g.bin""", "rets"), "bin_lo", "bin_hi"))
def q_histogram(spark, sf):
    return rounded(ST.histogram(rets(spark, sf), ["symbol"], "r", 80))


@register("histogram_errors", R(sql("""SELECT g.model, g.horizon, g.symbol, CAST(g.bin AS INTEGER) AS bin, g.lo + g.bin * (g.hi - g.lo) / 40 AS bin_lo,
  g.lo + (g.bin + 1) * (g.hi - g.lo) / 40 AS bin_hi, coalesce(c.n, 0) AS count
FROM (SELECT model, horizon, symbol, lo, hi, unnest(range(0, 40)) AS bin FROM er) g
LEFT JOIN (SELECT model, horizon, symbol, CAST(least(floor((y_true - y_pred - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n
           FROM preds JOIN er USING (model, horizon, symbol) GROUP BY ALL) c
  ON c.model = g.model AND c.horizon = g.horizon AND c.symbol = g.symbol AND c.bin = g.bin""", "preds",
                                    extra="""er AS (SELECT model, horizon, symbol, min(y_true - y_pred) AS lo, max(y_true - y_pred) AS hi
FROM preds GROUP BY model, horizon, symbol)"""), "bin_lo", "bin_hi"))
def q_histogram_errors(spark, sf):
    """40 bins of the prediction errors (real minus predicted) of every model, horizon and symbol."""
    from .q_eval import preds
    e = preds(spark, sf).withColumn("error", F.col("y_true") - F.col("y_pred"))
    return rounded(ST.histogram(e, ["model", "horizon", "symbol"], "error", 40))


_PAIRS = [(a, b) for k, a in enumerate(FEATS) for b in FEATS[k + 1:]]
_CORR_SQL = ("SELECT symbol, unnest(l, recursive := true) FROM (SELECT symbol, [" + ", ".join(
    f"{{'f1': '{a}', 'f2': '{b}', 'corr': corr({a}, {b})}}" for a, b in _PAIRS) + "] AS l FROM feat GROUP BY symbol)")


def feature_panel(spark, sf):
    return FT.feature_panel(_bars(spark, sf), FX.vol_index(spark, sf))


@register("correlation_matrix", R(sql(_CORR_SQL, "feat"), "corr"))
def q_corr(spark, sf):
    return rounded(ST.correlation_matrix(feature_panel(spark, sf), ["symbol"], FEATS))


@register("redundant_pairs", R(sql(f"SELECT * FROM ({_CORR_SQL}) WHERE abs(corr) > 0.9", "feat"), "corr"))
def q_redundant(spark, sf):
    return rounded(ST.redundant_pairs(ST.correlation_matrix(feature_panel(spark, sf), ["symbol"], FEATS)))


_ACF_SQL = """SELECT a.symbol, s.series, CAST(k.lag AS INTEGER) AS lag,
  sum((CASE s.series WHEN 'r' THEN a.r ELSE a.ar END - CASE s.series WHEN 'r' THEN mm.mr ELSE mm.mar END)
    * (CASE s.series WHEN 'r' THEN b.r ELSE b.ar END - CASE s.series WHEN 'r' THEN mm.mr ELSE mm.mar END))
  / max(CASE s.series WHEN 'r' THEN mm.cr ELSE mm.car END) AS acf
FROM rp a CROSS JOIN (SELECT unnest(range(0, 41)) AS lag) k CROSS JOIN (VALUES ('r'), ('abs_r')) s(series)
JOIN rp b ON b.symbol = a.symbol AND b.i = a.i - k.lag
JOIN (SELECT symbol, avg(r) AS mr, avg(ar) AS mar, sum(pow(r, 2)) - count(*) * pow(avg(r), 2) AS cr0,
             sum(pow(r - m1, 2)) AS cr, sum(pow(ar - m2, 2)) AS car FROM (
        SELECT symbol, r, ar, avg(r) OVER (PARTITION BY symbol) AS m1, avg(ar) OVER (PARTITION BY symbol) AS m2 FROM rp)
      GROUP BY symbol) mm ON mm.symbol = a.symbol
GROUP BY a.symbol, s.series, k.lag"""


def acf_table(spark, sf):
    return ST.acf_many(rets(spark, sf).withColumn("abs_r", F.abs("r")), ["symbol"], ["r", "abs_r"])


@register("acf", R(sql(_ACF_SQL, "rp"), "acf"))
def q_acf(spark, sf):
    return rounded(acf_table(spark, sf))


_PACF_SQL = """SELECT symbol, series, CAST(0 AS INTEGER) AS lag, 1.0 AS pacf FROM acfl
UNION ALL SELECT symbol, series, CAST(k AS INTEGER) AS lag, pk AS pacf FROM dl"""

_PACF_CTES = f"""acfl AS (SELECT symbol, series, list(acf ORDER BY lag) AS r FROM ({_ACF_SQL}) GROUP BY symbol, series),
dl(symbol, series, k, phi, pk) AS (
  SELECT symbol, series, 1, [r[2]], r[2] FROM acfl
  UNION ALL
  SELECT symbol, series, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: phi[j] - alpha * phi[k + 1 - j]), alpha), alpha
  FROM (SELECT d.symbol, d.series, d.k, d.phi,
               (a.r[d.k + 2] - list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * a.r[d.k + 2 - j])))
               / (1 - list_sum(list_transform(range(1, d.k + 1), lambda j: d.phi[j] * a.r[j + 1]))) AS alpha
        FROM dl d JOIN acfl a ON a.symbol = d.symbol AND a.series = d.series WHERE d.k < 40))"""


@register("pacf", R(sql(_PACF_SQL, "rp", extra=_PACF_CTES), "pacf"))
def q_pacf(spark, sf):
    """Durbin-Levinson on the ACF rows (small solve per symbol and series); the SQL twin runs the
    same recursion as a recursive CTE over lists."""
    return rounded(ST.pacf(acf_table(spark, sf), ["symbol", "series"]))


_NORM_SQL = """SELECT symbol, n, zs AS z_skew, zk AS z_kurt, zs * zs + zk * zk AS k2, exp(-(zs * zs + zk * zk) / 2) AS p_value FROM (
  SELECT symbol, n,
    delta * ln(yy / alpha + sqrt(pow(yy / alpha, 2) + 1)) AS zs,
    (1 - 2 / (9 * a) - sign(den) * pow((1 - 2 / a) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM (
    SELECT *, CASE WHEN y = 0 THEN 1.0 ELSE y END AS yy, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha,
      1 + xk * sqrt(2 / (a - 4)) AS den FROM (
      SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2,
        6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM (
        SELECT symbol, n, b1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
          3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
          (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS xk,
          6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
        FROM (SELECT symbol, CAST(count(*) AS DOUBLE) AS n,
                avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS b1, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS b2
              FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m FROM rets) GROUP BY symbol)))))"""


@register("normality_test", R(sql(_NORM_SQL, "rets"), "z_skew", "z_kurt", "k2", "p_value"))
def q_normality(spark, sf):
    d = ST.normality(rets(spark, sf), ["symbol"], "r")
    return rounded(d.withColumn("n", F.col("n").cast("double")))


def _spearman_sql(xa: str, xb: str, k: int, src: str = "rp", part: str = "symbol") -> str:
    return f"""SELECT {part}, corr(ra, rb) AS spearman, count(*) AS n FROM (
  SELECT *, rank() OVER (PARTITION BY {part} ORDER BY a) + (count(*) OVER (PARTITION BY {part}, a) - 1) / 2.0 AS ra,
            rank() OVER (PARTITION BY {part} ORDER BY b) + (count(*) OVER (PARTITION BY {part}, b) - 1) / 2.0 AS rb
  FROM (SELECT x.{part.replace(', ', ', x.')}, x.{xa} AS a, y.{xb} AS b FROM {src} x
        JOIN {src} y ON y.symbol = x.symbol AND y.i = x.i + {k}{' AND y.half = x.half' if 'half' in part else ''}))
GROUP BY {part}"""


@register("spearman", R(sql(_spearman_sql("r", "r", 1), "rp"), "spearman"))
def q_spearman(spark, sf):
    pairs = ST.lag_pairs(rets(spark, sf), ["symbol"], F.col("r"), F.col("r"), 1)
    return rounded(ST.spearman(pairs, ["symbol"], "a", "b"))


@register("volatility_clustering", R(sql(_spearman_sql("ar", "ar", 1), "rp"), "spearman"))
def q_vol_clustering(spark, sf):
    pairs = ST.lag_pairs(rets(spark, sf), ["symbol"], F.abs(F.col("r")), F.abs(F.col("r")), 1)
    return rounded(ST.spearman(pairs, ["symbol"], "a", "b"))


@register("leverage_effect", R(sql(_spearman_sql("r", "ar", 5), "rp"), "spearman"))
def q_leverage(spark, sf):
    pairs = ST.lag_pairs(rets(spark, sf), ["symbol"], F.col("r"), F.abs(F.col("r")), 5)
    return rounded(ST.spearman(pairs, ["symbol"], "a", "b"))


@register("stylized_facts", R(sql(f"""SELECT m.symbol, m.n, vc.spearman AS volatility_clustering, lv.spearman AS leverage_effect,
  m.kurt AS excess_kurtosis, m.skew AS skewness
FROM (SELECT symbol, count(*) AS n, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skew,
             avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurt
      FROM (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS mu FROM rp) GROUP BY symbol) m
JOIN ({_spearman_sql("ar", "ar", 1)}) vc USING (symbol)
JOIN ({_spearman_sql("r", "ar", 5)}) lv USING (symbol)""", "rp"),
                              "volatility_clustering", "leverage_effect", "excess_kurtosis", "skewness"))
def q_stylized(spark, sf):
    return rounded(ST.stylized_facts(rets(spark, sf), ["symbol"]))


_W_SQL = f"""SELECT symbol, sum(abs(cdf) * (nxt - v)) AS wasserstein FROM (
  SELECT symbol, v, sum(w) OVER (PARTITION BY symbol ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf,
         lead(v) OVER (PARTITION BY symbol ORDER BY v) AS nxt FROM (
    SELECT symbol, v, sum(w) AS w FROM (
      SELECT symbol, r AS v, 1.0 / count(*) OVER (PARTITION BY symbol) AS w FROM rets WHERE day <= DATE '{SPLIT_DAY}'
      UNION ALL
      SELECT symbol, r AS v, -1.0 / count(*) OVER (PARTITION BY symbol) AS w FROM rets WHERE day > DATE '{SPLIT_DAY}')
    GROUP BY symbol, v))
GROUP BY symbol"""


def halves(spark, sf):
    r = stage(rets(spark, sf), "returns")
    cut = F.lit(SPLIT_DAY).cast("date")
    return r.filter(F.col("day") <= cut), r.filter(F.col("day") > cut)


@register("wasserstein_1d", R(sql(_W_SQL, "rets"), "wasserstein"))
def q_wasserstein(spark, sf):
    u, v = halves(spark, sf)
    return rounded(ST.wasserstein_1d(u, v, ["symbol"], "r"))


# Paths of 20 returns of a series, flattened path after path.
_PATHS = """{name} AS (SELECT symbol, half, p * 20 + pos AS i, r, abs(r) AS ar FROM (
  SELECT symbol, half, p, unnest(path) AS r, unnest(range(0, 20)) AS pos FROM (
    SELECT symbol, half, row_number() OVER (PARTITION BY symbol, half ORDER BY day) - 1 AS p,
           list(r) OVER (PARTITION BY symbol, half ORDER BY day ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS path,
           count(*) OVER (PARTITION BY symbol, half ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS na
    FROM (SELECT symbol, day, r, {half} AS half FROM rets)) WHERE na = 20))"""
_HALF = f"CASE WHEN day <= DATE '{SPLIT_DAY}' THEN 0 ELSE 1 END"
_MOMENTS = """SELECT symbol, half, count(*) AS n, avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5) AS skew,
  avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3 AS kurt
FROM (SELECT symbol, half, r, avg(r) OVER (PARTITION BY symbol, half) AS mu FROM fl) GROUP BY symbol, half"""
_FACTS = f"""facts AS (SELECT m.symbol, m.half, m.n, a.spearman AS vc, l.spearman AS lev, m.kurt, m.skew FROM ({_MOMENTS}) m
JOIN ({_spearman_sql("ar", "ar", 1, "fl", "symbol, half")}) a USING (symbol, half)
JOIN ({_spearman_sql("r", "ar", 5, "fl", "symbol, half")}) l USING (symbol, half))"""
_FLAT_W = _W_SQL.replace(f"FROM rets WHERE day <= DATE '{SPLIT_DAY}'", "FROM fl WHERE half = 0").replace(
    f"FROM rets WHERE day > DATE '{SPLIT_DAY}'", "FROM fl WHERE half = 1")
_SETS = ["vol_clustering", "leverage", "excess_kurtosis", "skewness"]


@register("compare_distributions", R(sql(f"""SELECT w.symbol, w.wasserstein,
  {', '.join(f'{t}.{c} AS {name}_{to}' for t, name in (('a', 'real'), ('b', 'other')) for c, to in zip(('vc', 'lev', 'kurt', 'skew'), _SETS))}
FROM ({_FLAT_W}) w JOIN facts a ON a.symbol = w.symbol AND a.half = 0 JOIN facts b ON b.symbol = w.symbol AND b.half = 1""", "rets",
                                         extra=_PATHS.format(name="fl", half=_HALF) + ",\n" + _FACTS),
                                     "wasserstein", *[f"{n}_{c}" for n in ("real", "other") for c in _SETS]))
def q_compare(spark, sf):
    """Return paths of 20 days of the two periods as two path sets: distance and all facts of both."""
    from ..operators import samples as SMP
    real, other = (SMP.return_paths(d, 20) for d in halves(spark, sf))
    return rounded(ST.compare_paths(real, other, ["symbol"]))


def _inside(xa: str, xb: str, k: int) -> str:
    """Spearman of lag pairs that stay inside a path."""
    return _spearman_sql(xa, xb, k, "fl", "symbol, half").replace("AND y.half = x.half", "AND y.half = x.half AND y.i // 20 = x.i // 20")


@register("stylized_facts_paths", R(sql(f"""SELECT symbol, true AS cross_paths, n, vc AS volatility_clustering, lev AS leverage_effect,
  kurt AS excess_kurtosis, skew AS skewness FROM facts
UNION ALL SELECT m.symbol, false, m.n, a.spearman, l.spearman, m.kurt, m.skew FROM ({_MOMENTS}) m
JOIN ({_inside("ar", "ar", 1)}) a USING (symbol, half) JOIN ({_inside("r", "ar", 5)}) l USING (symbol, half)""", "rets",
                                        extra=_PATHS.format(name="fl", half="0") + ",\n" + _FACTS),
                                    "volatility_clustering", "leverage_effect", "excess_kurtosis", "skewness"))
def q_stylized_paths(spark, sf):
    """Facts of the set of all 20-day paths, with lag pairs across path borders (as the reference) and without."""
    from ..operators import samples as SMP
    paths = stage(SMP.return_paths(rets(spark, sf), 20).select("symbol", "i", "path"), "paths")
    both = [ST.stylized_facts_paths(paths, ["symbol"], cross_paths=c).withColumn("cross_paths", F.lit(c)) for c in (True, False)]
    return rounded(both[0].unionByName(both[1]))


# Twin of the ADF test: every row's regressors as a list, their cross products, and one pivot after another (Gauss-Jordan).
# After k pivots the last element is the residual sum of the regression on the first k columns, so the pivots of one matrix
# give the residual sums of all lags; the inverse and the coefficients of the final one stand in the matrix after all pivots.
_PIVOTS = """{name}(series, symbol, n, z, k, g) AS (SELECT series, symbol, n, z, CAST(0 AS BIGINT), g FROM {source}
  UNION ALL SELECT series, symbol, n, z, k + 1, list_transform(range(0, z * z), lambda e: CASE
    WHEN e // z = k AND e % z = k THEN 1 / g[k * z + k + 1]
    WHEN e // z = k THEN g[e + 1] / g[k * z + k + 1]
    WHEN e % z = k THEN -g[e + 1] / g[k * z + k + 1]
    ELSE g[e + 1] - g[(e // z) * z + k + 1] * g[k * z + e % z + 1] / g[k * z + k + 1] END) FROM {name} WHERE k < z - 1)"""


def _poly(x: str, coefficients: list[float]) -> str:
    return " + ".join(f"({c}) * pow({x}, {j})" for j, c in enumerate(coefficients))


def _products(name: str, source: str) -> str:
    """Sums of all products of the rows ``v`` of ``source`` (series, symbol, z, v), as one list per series and symbol."""
    return f"""{name} AS (SELECT series, symbol, any_value(n) AS n, z, list(p ORDER BY e) AS g FROM (
  SELECT series, symbol, z, e, count(*) AS n, sum(v[e // z + 1] * v[e % z + 1]) AS p
  FROM (SELECT *, unnest(range(0, z * z)) AS e FROM {source}) GROUP BY ALL) GROUP BY series, symbol, z)"""


_ADF = f"""ob AS (SELECT series, symbol, t, n, least(n // 2 - 2, CAST(ceil(12 * pow(n / 100.0, 0.25)) AS BIGINT)) AS m, x, x - lag(x) OVER w AS dx, lag(x) OVER w AS lev
  FROM (SELECT series, symbol, day, row_number() OVER w0 - 1 AS t, count(*) OVER s AS n, x - avg(x) OVER s AS x
        FROM (SELECT 'r' AS series, symbol, day, r AS x FROM rets UNION ALL SELECT 'close', symbol, day, close FROM rets)
        WINDOW s AS (PARTITION BY series, symbol), w0 AS (PARTITION BY series, symbol ORDER BY day))
  WINDOW w AS (PARTITION BY series, symbol ORDER BY t)),
lagged AS (SELECT *, list_reverse(list(dx) OVER (PARTITION BY series, symbol ORDER BY t ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) AS past FROM ob),
wide AS (SELECT series, symbol, m + 3 AS z, list_concat([1.0, lev], list_concat(past[1:m], [dx])) AS v FROM lagged WHERE t > m),
{_products("gw", "wide")},
{_PIVOTS.format(name="pw", source="gw")},
best AS (SELECT series, symbol, arg_min(k - 2, (n * (ln(2 * pi()) + ln(g[z * z] / n) + 1) + 2 * k, k)) AS lag FROM pw WHERE k >= 2 GROUP BY series, symbol),
own AS (SELECT series, symbol, lag + 3 AS z, list_concat([1.0, lev], list_concat(past[1:lag], [dx])) AS v
  FROM lagged JOIN best USING (series, symbol) WHERE t > lag),
{_products("go", "own")},
{_PIVOTS.format(name="po", source="go")},
stats AS (SELECT series, symbol, z - 3 AS lag, n, g[2 * z] / sqrt(g[z * z] / (n - (z - 1)) * g[z + 2]) AS stat FROM po WHERE k = z - 1),
surface AS (SELECT *, CASE WHEN stat <= {ADF.TAU_STAR} THEN {_poly("stat", ADF.TAU_SMALLP)} ELSE {_poly("stat", ADF.TAU_LARGEP)} END AS q FROM stats)"""
_NORMAL = """0.5 + q / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
    lambda j: CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(q * j / 2000, 2))))"""
_CRITS = ", ".join(f"{_poly('1.0 / n', c)} AS crit_{level.rstrip('%')}" for level, c in ADF.CRIT_2010.items())


@register("adf_test", R(sql(f"""SELECT *, p_value < 0.05 AS stationary FROM (
  SELECT symbol, series, stat, CASE WHEN stat > {ADF.TAU_MAX} THEN 1.0 WHEN stat < {ADF.TAU_MIN} THEN 0.0 ELSE {_NORMAL} END AS p_value,
         CAST(lag AS INTEGER) AS used_lag, CAST(n AS BIGINT) AS nobs, {_CRITS} FROM surface)""", "rets", extra=_ADF),
                        "stat", "p_value", "crit_1", "crit_5", "crit_10"))
def q_adf(spark, sf):
    """ADF (constant, AIC lag) of the returns and of the close per symbol; verdict at 5 %."""
    r = stage(rets(spark, sf), "returns")
    a = ADF.adf(r, ["symbol"], "r").withColumn("series", F.lit("r"))
    c = ADF.adf(r, ["symbol"], "close").withColumn("series", F.lit("close"))
    out = a.unionByName(c).withColumn("stationary", F.col("p_value") < 0.05)
    return rounded(out)
