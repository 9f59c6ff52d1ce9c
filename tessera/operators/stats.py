"""Distribution and time-series statistics per group.

Moments and correlations are plain aggregates.  Ranks (Spearman), CDF
differences (1-D Wasserstein) and quantiles never sort a whole group in one
task: values are counted first, dealt by ranges whose borders come from the
data (``value_scan``) and scanned with a carry; autocovariances are lag sums
of (key, block) halo windows, all lags of all series from one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from . import series as S

PART = "_part"


def ranged(by_val: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Rows dealt into ranges of (keys, x) of like size, whatever the values are; ``_part`` numbers the ranges upwards.

    The borders are sampled from the data, so the dealt rows are staged: both levels of a scan must see the same ranges.
    """
    return stage(by_val.repartitionByRange(*keys, x).withColumn(PART, F.spark_partition_id()), "ranged")


def value_scan(by_val: DataFrame, keys: Sequence[str], x: str, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Running aggregates ``(value, op, out)`` over the distinct values ``x`` of each group, in ascending order."""
    return S.running_many(ranged(by_val, keys, x), list(keys), list(specs), i=x, bucket=F.col(PART))


# ------------------------------------------------------------------ moments

def moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Population skewness / excess kurtosis and their bias-corrected versions."""
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skew_pop"),
                              F.kurtosis(x).alias("kurt_pop"))
    n = F.col("n").cast("double")
    skew_s = F.col("skew_pop") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt_s = ((n + 1) * F.col("kurt_pop") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return g.withColumn("skew_sample", skew_s).withColumn("kurt_sample", kurt_s)


def histogram(df: DataFrame, keys: Sequence[str], x: str, bins: int) -> DataFrame:
    """Fixed-count bins over [min, max] per group; the last bin is closed on the right.
    All bins are returned (empty ones with count 0)."""
    rng = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    j = df.join(rng, list(keys), "inner")
    width = F.col("hi") - F.col("lo")
    b = F.least(F.floor(F.try_divide(F.col(x) - F.col("lo"), width) * bins), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left")
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select(*keys, "bin", (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).alias("count"))


def correlation_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (upper triangle) from one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    g = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)])
    st = F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"_c{k}").alias("corr"))
                             for k, (a, b) in enumerate(pairs)])).alias("_p")
    return g.select(*keys, st).select(*keys, "_p.f1", "_p.f2", "_p.corr")


def redundant_pairs(corr: DataFrame, threshold: float = 0.9) -> DataFrame:
    return corr.filter(F.abs(F.col("corr")) > threshold)


# ------------------------------------------------------------------ autocorrelation

def lag_products(panel: DataFrame, keys: Sequence[str], cols: Sequence[str], nlags: int, i: str = "i",
                 block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """(keys, series, v): per column the sums n, x, x x and for k = 1..nlags those of x_t x_{t-k}, x_t, x_{t-k}.

    One pass: each block adds up all lags of all columns, the blocks' arrays are added by a partial aggregate.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys, cols = list(keys), list(cols)
    d = S.halo(panel.select(*keys, i, *[F.col(c).cast("double").alias(c) for c in cols]), before=nlags, after=0, i=i, block=block)
    schema = T.StructType([f for f in d.schema.fields if f.name in keys]
                          + [T.StructField("series", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(i)
        own = int((pdf[S.BLK] != pdf[S.OWN_BLK]).sum())       # the copied rows come first
        rows = []
        for c in cols:
            x = pdf[c].to_numpy(dtype=float)
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            v = [float(known[own:].sum()), x[own:].sum(), x[own:] @ x[own:]]
            parts = []
            for k in range(1, nlags + 1):
                lo = max(own, k)
                late, early = x[lo:], x[lo - k:len(x) - k]
                parts.append((late @ early, late[known[lo - k:len(x) - k]].sum(), early.sum()))
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "series": c, "v": v + [float(p[n]) for n in range(3) for p in parts]})
        return pd.DataFrame(rows, columns=schema.names)

    parts = d.groupBy(*keys, S.BLK).applyInPandas(sums, schema)
    return (parts.groupBy(*keys, "series").agg(Summarizer.sum(array_to_vector("v")).alias("_s"))
            .select(*keys, "series", vector_to_array("_s").alias("v")))


def acf_many(panel: DataFrame, keys: Sequence[str], cols: Sequence[str], nlags: int = 40, i: str = "i",
             block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Biased autocorrelation r_k = sum_{t>=k}(x_t - m)(x_{t-k} - m) / sum (x_t - m)^2, k = 0..nlags, of several columns.

    The centring is applied to the raw sums afterwards.  Output (keys, series, lag, acf); null for a constant series.
    """
    at = lambda k: F.element_at("v", k.cast("int"))
    n, m = F.col("_n"), F.col("_m")
    c0 = at(F.lit(3)) - n * m * m

    def r(k):
        ck = at(k + 3) - m * (at(k + 3 + nlags) + at(k + 3 + 2 * nlags)) + (n - k) * m * m
        return F.struct(k.cast("int").alias("lag"), F.when(k == 0, F.lit(1.0)).otherwise(F.try_divide(ck, c0)).alias("acf"))

    g = lag_products(panel, keys, cols, nlags, i, block).withColumn("_n", at(F.lit(1))).withColumn("_m", F.try_divide(at(F.lit(2)), F.col("_n")))
    lags = F.transform(F.sequence(F.lit(0), F.lit(nlags)), lambda k: F.when(k == 0, r(F.lit(0))).otherwise(r(F.greatest(k, F.lit(1)))))
    return g.select(*keys, "series", F.explode(lags).alias("_r")).select(*keys, "series", "_r.lag", "_r.acf")


def acf(panel: DataFrame, keys: Sequence[str], x: str, nlags: int = 40, i: str = "i",
        block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """``acf_many`` of one column, without its name."""
    return acf_many(panel, keys, [x], nlags, i, block).drop("series")


def _durbin_levinson(r: np.ndarray) -> np.ndarray:
    """PACF from autocorrelations r[0..K] (Yule-Walker with the biased ACF)."""
    K = len(r) - 1
    out = np.zeros(K + 1)
    out[0] = 1.0
    phi = np.zeros(K + 1)
    v = 1.0
    for k in range(1, K + 1):
        a = (r[k] - np.dot(phi[1:k], r[1:k][::-1])) / v
        new = phi.copy()
        new[k] = a
        new[1:k] = phi[1:k] - a * phi[1:k][::-1]
        phi = new
        v *= (1 - a * a)
        out[k] = a
    return out


def pacf(acf_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Durbin-Levinson on the (small) ACF table: one group of nlags+1 rows per key."""
    schema = ", ".join([f"{k} {t}" for k, t in acf_table.select(*keys).dtypes] + ["lag int", "pacf double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        out = _durbin_levinson(pdf["acf"].to_numpy(dtype=float))
        res = pdf[list(keys)].copy()
        res["lag"] = pdf["lag"].astype("int32").to_numpy()
        res["pacf"] = out
        return res

    return acf_table.groupBy(*keys).applyInPandas(solve, schema)


# ------------------------------------------------------------------ normality

def normality(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """D'Agostino-Pearson K^2 from population skewness and kurtosis; p = exp(-K^2 / 2)."""
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("_b1"), F.kurtosis(x).alias("_g2"))
    n = F.col("n").cast("double")
    y = F.col("_b1") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    zs = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    b2 = F.col("_g2") + 3
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9 * a)
    den = 1 + xk * F.sqrt(2 / (a - 4))
    term2 = F.signum(den) * F.pow((1 - 2 / a) / F.abs(den), 1.0 / 3)
    zk = (term1 - term2) / F.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    return g.select(*keys, "n", zs.alias("z_skew"), zk.alias("z_kurt"), k2.alias("k2"),
                    F.exp(-k2 / 2).alias("p_value"))


# ------------------------------------------------------------------ ranks

def average_rank(by_val: DataFrame, keys: Sequence[str], x: str, n: str, out: str) -> DataFrame:
    """(keys, x, out): average rank (1-based, ties share the mean rank) of each distinct value that occurs ``n`` times.

    rank = (#values below) + (ties + 1) / 2; the count below is a running sum over the distinct values.
    """
    r = value_scan(by_val, keys, x, [(n, "sum", "_le")])
    return r.select(*keys, x, (F.col("_le") - F.col(n) + (F.col(n) + 1) / 2.0).alias(out))


def spearman(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Spearman correlation of paired columns (Pearson of average ranks) and the number of pairs.

    Pairs are counted per distinct (a, b) before the ranks join them, so a value that a large share of the rows holds
    meets its rank once per distinct partner.
    """
    keys = list(keys)
    counted = stage(pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_w")), "pairs")
    ranks = [average_rank(counted.groupBy(*keys, c).agg(F.sum("_w").alias("_n")), keys, c, "_n", out) for c, out in ((a, "_ra"), (b, "_rb"))]
    j = counted.join(ranks[0], [*keys, a]).join(ranks[1], [*keys, b])
    w, ra, rb = F.col("_w"), F.col("_ra"), F.col("_rb")
    g = j.groupBy(*keys).agg(F.sum("_w").alias("n"), *[F.sum(w * e).alias(c) for c, e in (
        ("_sa", ra), ("_sb", rb), ("_saa", ra * ra), ("_sbb", rb * rb), ("_sab", ra * rb))])
    n = F.col("n").cast("double")
    cov = lambda xy, x, y: F.col(xy) / n - F.col(x) / n * F.col(y) / n
    r = F.try_divide(cov("_sab", "_sa", "_sb"), F.sqrt(cov("_saa", "_sa", "_sa")) * F.sqrt(cov("_sbb", "_sb", "_sb")))
    return g.select(*keys, r.alias("spearman"), "n")


def lag_pairs(panel: DataFrame, keys: Sequence[str], x: Column, y: Column, k: int, i: str = "i",
              block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Pairs (x_{t-k}, y_t) over consecutive positions (halo window)."""
    d = panel.withColumn("_x", x).withColumn("_y", y)
    d = S.halo(d, before=k, after=0, i=i, block=block)
    w = S.block_window(list(keys), i)
    d = S.own_rows(d.withColumn("_xl", F.lag("_x", k).over(w))).drop(S.BLK)
    return d.filter(F.col("_xl").isNotNull()).select(*keys, i, F.col("_xl").alias("a"), F.col("_y").alias("b"))


def stylized_facts(panel: DataFrame, keys: Sequence[str], r: str = "r", i: str = "i",
                   block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Volatility clustering (Spearman |r| lag 1), leverage (Spearman r_t vs |r_{t+5}|),
    population excess kurtosis and skewness; 0 for the Spearman facts on too short series."""
    vc = spearman(lag_pairs(panel, keys, F.abs(F.col(r)), F.abs(F.col(r)), 1, i, block), keys, "a", "b")
    lev = spearman(lag_pairs(panel, keys, F.col(r), F.abs(F.col(r)), 5, i, block), keys, "a", "b")
    mom = panel.groupBy(*keys).agg(F.count(r).alias("n"), F.kurtosis(r).alias("excess_kurtosis"),
                                   F.skewness(r).alias("skewness"))
    out = (mom.join(vc.select(*keys, F.col("spearman").alias("_vc")), list(keys), "left")
              .join(lev.select(*keys, F.col("spearman").alias("_lev")), list(keys), "left"))
    return out.select(*keys, "n",
                      F.when(F.col("n") > 2, F.col("_vc")).otherwise(F.lit(0.0)).alias("volatility_clustering"),
                      F.when(F.col("n") > 5, F.col("_lev")).otherwise(F.lit(0.0)).alias("leverage_effect"),
                      "excess_kurtosis", "skewness")


# ------------------------------------------------------------------ distances

def wasserstein_1d(u: DataFrame, v: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """1-D Wasserstein distance per group: sum over distinct values of |F_u - F_v| * gap to the next value.

    Occurrences in both sets are counted per value; their running counts give both CDFs.  The gap to the next distinct
    value uses ``lead`` inside a range and, at its end, the first value of the next range.  Groups that lack one of the
    sets are left out.
    """
    keys = list(keys)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = u.select(*keys, x, one.alias("_u"), zero.alias("_v")).unionByName(v.select(*keys, x, zero.alias("_u"), one.alias("_v")))
    by_val = both.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum("_u").alias("_u"), F.sum("_v").alias("_v"))
    d = ranged(by_val, keys, x)
    size = d.groupBy(*keys).agg(F.sum("_u").alias("_nu"), F.sum("_v").alias("_nv")).filter("_nu > 0 and _nv > 0")
    w = Window.partitionBy(*keys, PART).orderBy(x)
    firsts = d.groupBy(*keys, PART).agg(F.min(x).alias("_first"))
    wb = (Window.partitionBy(*keys) if keys else Window).orderBy(PART)
    nxt = firsts.select(*keys, PART, F.lead("_first", 1).over(wb).alias("_next_part"))
    d = S.running_many(d.withColumn("_next", F.lead(x, 1).over(w)), keys, [("_u", "sum", "_cu"), ("_v", "sum", "_cv")], i=x, bucket=F.col(PART))
    d = d.join(nxt, [*keys, PART], "left")
    d = d.join(size, keys) if keys else d.crossJoin(size)
    gap = F.coalesce("_next", "_next_part") - F.col(x)
    return d.groupBy(*keys).agg(F.sum(F.abs(F.col("_cu") / F.col("_nu") - F.col("_cv") / F.col("_nv")) * gap).alias("wasserstein"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy / pandas default) per group.

    No group is ever held in one buffer: values are counted per distinct
    value, the running count is a two-level scan over ranges of them, and the
    order statistics at floor(h) and floor(h)+1 (h = (n-1) p) are picked by
    a conditional ``min``.  Output (keys, q0, q1, ...) in the order of ``probs``.
    """
    keys = list(keys)
    by_val = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"))
    cum = stage(value_scan(by_val, keys, x, [("_c", "sum", "_le")]), "counts")
    n = cum.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    d = cum.join(n, keys, "inner") if keys else cum.crossJoin(n)
    aggs = []
    for k, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        aggs += [F.min(F.when(F.col("_le") >= lo + 1, F.col(x))).alias(f"_lo{k}"),
                 F.min(F.when(F.col("_le") >= lo + 2, F.col(x))).alias(f"_hi{k}"),
                 F.first(h - lo).alias(f"_fr{k}")]
    g = d.groupBy(*keys).agg(*aggs)
    outs = []
    for k in range(len(probs)):
        v_lo, v_hi = F.col(f"_lo{k}"), F.coalesce(F.col(f"_hi{k}"), F.col(f"_lo{k}"))
        outs.append((v_lo + F.col(f"_fr{k}") * (v_hi - v_lo)).alias(f"q{k}"))
    return g.select(*keys, *outs)


def stylized_facts_paths(paths: DataFrame, keys: Sequence[str], path_id: str = "i", path: str = "path",
                         cross_paths: bool = True, block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """Stylized facts of a set of return paths per key.

    ``cross_paths=True`` flattens the paths row-major in ``path_id`` order
    (the reference's behaviour: lag pairs cross path borders, q14);
    ``False`` forms lag pairs only inside each path.  Moments use all values.
    """
    keys = list(keys)
    ex = paths.select(*keys, F.col(path_id).alias("_path"), F.posexplode(path).alias("_pos", "r"))
    base = paths.groupBy(*keys).agg(F.min(path_id).alias("_p0"), F.max(F.size(F.col(path))).alias("_len"))
    ex = ex.join(base, keys).withColumn("_i", (F.col("_path") - F.col("_p0")) * F.col("_len") + F.col("_pos"))
    if cross_paths:
        return stylized_facts(ex.select(*keys, F.col("_i").alias("i"), "r"), keys, block=block)
    # lag pairs inside each path only; ranks and moments over the key
    inner = ex.select(*keys, "_path", F.col("_pos").alias("i"), "r")
    vc = lag_pairs(inner, [*keys, "_path"], F.abs(F.col("r")), F.abs(F.col("r")), 1, block=block)
    lev = lag_pairs(inner, [*keys, "_path"], F.col("r"), F.abs(F.col("r")), 5, block=block)
    vc, lev = spearman(vc, keys, "a", "b"), spearman(lev, keys, "a", "b")
    mom = ex.groupBy(*keys).agg(F.count("r").alias("n"), F.kurtosis("r").alias("excess_kurtosis"),
                                F.skewness("r").alias("skewness"))
    out = (mom.join(vc.select(*keys, F.col("spearman").alias("volatility_clustering")), keys, "left")
              .join(lev.select(*keys, F.col("spearman").alias("leverage_effect")), keys, "left"))
    return out.select(*keys, "n", "volatility_clustering", "leverage_effect", "excess_kurtosis", "skewness")


def compare_paths(real: DataFrame, other: DataFrame, keys: Sequence[str], path_id: str = "i", path: str = "path",
                  cross_paths: bool = True, block: int = S.DEFAULT_BLOCK) -> DataFrame:
    """(keys, wasserstein, real_ and other_ volatility clustering, leverage, excess kurtosis, skewness) of two path sets.

    The distance is that of all returns of the sets; the facts are those of ``stylized_facts_paths``.
    """
    keys = list(keys)
    sets = {"real": stage(real.select(*keys, path_id, path), "paths"), "other": stage(other.select(*keys, path_id, path), "paths")}
    flat = [d.select(*keys, F.explode(path).alias("r")) for d in sets.values()]
    out = wasserstein_1d(*flat, keys, "r")
    short = {"volatility_clustering": "vol_clustering", "leverage_effect": "leverage", "excess_kurtosis": "excess_kurtosis", "skewness": "skewness"}
    for name, d in sets.items():
        facts = stylized_facts_paths(d, keys, path_id, path, cross_paths, block)
        out = out.join(facts.select(*keys, *[F.col(c).alias(f"{name}_{to}") for c, to in short.items()]), keys)
    return out
