"""Registered queries: daily embedding chain, calendar joins, alignment guards (2.3, 2.4, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import news as N
from ..oracle.views import CTES, WS, sql
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources import sinks as SK
from . import corpus as C
from . import features as FT
from .q_features import FX_SYMBOLS
from .q_news import news_dedup
from .registry import R, register, rounded

CTES.update({
    "md": (("bars",), "md AS (SELECT DISTINCT day FROM bars)"),
    "nd": (("dedup",), "nd AS (SELECT DISTINCT day FROM dedup)"),
    "fb": (("md", "nd"), """fb AS (
  SELECT md.day, coalesce(a.day, b.day, c.day) AS src FROM md
  LEFT JOIN nd a ON a.day = md.day LEFT JOIN nd b ON b.day = md.day - 1 LEFT JOIN nd c ON c.day = md.day + 1)"""),
    "cal": (("fb",), """cal AS (
  SELECT day, source_day,
         CASE WHEN src IS NOT NULL THEN 'real' WHEN source_day IS NOT NULL THEN 'filled' ELSE 'zero' END AS origin
  FROM (SELECT day, src, max(src) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source_day
        FROM fb))"""),
    "vecs": (("dedup",), """vecs AS (
  SELECT d.row_no, d.day, e.embedding AS emb FROM dedup d
  JOIN embeddings e ON e.vec_id = d.row_no % (SELECT count(*) FROM embeddings))"""),
    "dsum": (("vecs",), """dsum AS (
  SELECT day, max(n) AS n_news, count(*) AS dim, sum(m) AS emb_sum,
         max(CASE WHEN k = 1 THEN m END) AS emb_first, sqrt(sum(m * m)) AS emb_norm
  FROM (SELECT day, k, avg(v) AS m, count(*) AS n
        FROM (SELECT day, unnest(range(1, len(emb) + 1)) AS k, unnest(emb) AS v FROM vecs)
        GROUP BY day, k)
  GROUP BY day)"""),
    "daily": (("cal", "dsum"), """daily AS (
  SELECT cal.day, cal.source_day, cal.origin, coalesce(ds.n_news, 0) AS n_news,
         coalesce(ds.emb_sum, 0.0) AS emb_sum, coalesce(ds.emb_norm, 0.0) AS emb_norm
  FROM cal LEFT JOIN dsum ds ON ds.day = cal.source_day)"""),
})


def _bars(spark, sf):
    return FX.bars(spark, sf, symbols=FX_SYMBOLS[0])


def encode_lookup(spark, sf):
    """Fixture encoder: the vector of row ``row_no`` is ``embeddings[row_no % count]``."""
    def enc(df):
        return FX.news_vectors(spark, sf, df.select("row_no", "day", "headline"))
    return enc


def news_vectors(spark, sf):
    return encode_lookup(spark, sf)(news_dedup(spark, sf))


def market_days(spark, sf):
    return RD.market_days(_bars(spark, sf))


def daily(spark, sf):
    dim = FX.embedding_dim(spark, sf)
    return C.daily_embeddings(market_days(spark, sf), news_dedup(spark, sf), encode_lookup(spark, sf), dim)


@register("nearest_day_fallback", sql("SELECT day, src FROM fb", "fb"))
def q_fallback(spark, sf):
    return E.nearest_day_fallback(market_days(spark, sf), news_dedup(spark, sf))


@register("forward_fill", sql("SELECT day, source_day, origin FROM cal", "cal"))
def q_forward_fill(spark, sf):
    return C.calendar(market_days(spark, sf), news_dedup(spark, sf))


@register("fill_origin_counts", sql("SELECT origin, count(*) AS n_days FROM cal GROUP BY origin", "cal"))
def q_fill_origin(spark, sf):
    return C.calendar(market_days(spark, sf), news_dedup(spark, sf)).groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_days"))


@register("daily_mean_embedding", R(sql("SELECT day, n_news, dim, emb_sum, emb_first, emb_norm FROM dsum", "dsum"),
                                    "emb_sum", "emb_first", "emb_norm"))
def q_daily_mean(spark, sf):
    d = E.daily_mean(news_vectors(spark, sf).select("day", "emb"))
    return rounded(d.select("day", "n_news", F.size("emb").cast("long").alias("dim"),
                            E.vector_sum().alias("emb_sum"), F.col("emb")[0].alias("emb_first"),
                            E.l2_norm().alias("emb_norm")))


@register("daily_embedding", R(sql("SELECT day, source_day, origin, n_news, emb_sum, emb_norm FROM daily", "daily"),
                               "emb_sum", "emb_norm"))
def q_daily_embedding(spark, sf):
    d = daily(spark, sf)
    return rounded(d.select("day", "source_day", "origin", "n_news",
                            E.vector_sum().alias("emb_sum"), E.l2_norm().alias("emb_norm")))


@register("embedding_norms", R(sql("""SELECT count(*) AS n_days, avg(emb_norm) AS mean_norm, min(emb_norm) AS min_norm,
  max(emb_norm) AS max_norm, max(CASE WHEN day = DATE '1995-03-16' THEN emb_norm END) AS check_norm,
  coalesce(bool_or(day = DATE '1995-03-16' AND emb_norm >= 1.0), false) AS check_ok FROM daily""", "daily"),
                               "mean_norm", "min_norm", "max_norm", "check_norm"))
def q_norms(spark, sf):
    d = daily(spark, sf).withColumn("_norm", E.l2_norm())
    is_day = F.col("day") == F.lit("1995-03-16").cast("date")
    return rounded(d.agg(F.count(F.lit(1)).alias("n_days"), F.avg("_norm").alias("mean_norm"),
                         F.min("_norm").alias("min_norm"), F.max("_norm").alias("max_norm"),
                         F.max(F.when(is_day, F.col("_norm"))).alias("check_norm"),
                         F.coalesce(F.bool_or(is_day & (F.col("_norm") >= 1.0)), F.lit(False)).alias("check_ok")))


@register("join_daily_embedding", R(sql("""SELECT r.symbol, r.day, ds.day IS NOT NULL AS matched,
  coalesce(ds.emb_sum, 0.0) AS emb_sum FROM rets r LEFT JOIN dsum ds ON ds.day = r.day""", "rets", "dsum"),
                                    "emb_sum"))
def q_join_daily(spark, sf):
    dim = FX.embedding_dim(spark, sf)
    vec = E.daily_mean(news_vectors(spark, sf).select("day", "emb"))
    p = FT.returns_panel(_bars(spark, sf)).select("symbol", "day")
    j = E.join_daily_embedding(p, vec, dim)
    return rounded(j.select("symbol", "day", "matched", E.vector_sum().alias("emb_sum")))


@register("guard_alignment", R(sql("""SELECT symbol, avg(CASE WHEN ds.day IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(CASE WHEN ds.day IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.95 AS ok, min(r.day) AS first_day, max(r.day) AS last_day
FROM rets r LEFT JOIN dsum ds ON ds.day = r.day GROUP BY symbol""", "rets", "dsum"), "coverage"))
def q_guard_alignment(spark, sf):
    from ..operators import guards as GD
    dim = FX.embedding_dim(spark, sf)
    vec = E.daily_mean(news_vectors(spark, sf).select("day", "emb"))
    p = FT.returns_panel(_bars(spark, sf)).select("symbol", "day")
    return rounded(GD.alignment_report(E.join_daily_embedding(p, vec, dim), "symbol"))


@register("guard_all_zero_embedding", sql("""SELECT count(*) AS n_days, bool_or(emb_norm > 0) AS any_nonzero,
  count(*) FILTER (WHERE emb_norm = 0) AS n_zero_days FROM daily""", "daily"))
def q_guard_zero(spark, sf):
    d = daily(spark, sf)
    nz = E.any_nonzero()
    return d.agg(F.count(F.lit(1)).alias("n_days"), F.bool_or(nz).alias("any_nonzero"),
                 F.count_if(~nz).alias("n_zero_days"))


@register("pending_days", sql("""SELECT md.day, CASE WHEN s.day IS NULL THEN 'pending' ELSE 'reused' END AS status
FROM md LEFT JOIN (SELECT day FROM daily WHERE day < DATE '1996-01-01') s ON s.day = md.day""", "md", "daily"))
def q_pending(spark, sf):
    md = market_days(spark, sf)
    stored = daily(spark, sf).filter(F.col("day") < F.lit("1996-01-01").cast("date")).select("day")
    pend = md.join(stored, "day", "left_anti").withColumn("status", F.lit("pending"))
    reuse = md.join(stored, "day", "left_semi").withColumn("status", F.lit("reused"))
    return pend.unionByName(reuse)


@register("sink_wide_embeddings", R(sql("SELECT day, emb_sum FROM daily", "daily"), "emb_sum", digits=4))
def q_sink_wide(spark, sf):
    dim = FX.embedding_dim(spark, sf)
    path = scratch_path(spark, "wide-emb")
    SK.sink_wide_embeddings(daily(spark, sf), path, dim)
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    back = back.select(F.col("day").cast("date").alias("day"), *[F.col(c).cast("double") for c in back.columns[1:]])
    w = RD.load_wide_embeddings(back)
    return rounded(w.select("day", E.vector_sum().alias("emb_sum")), 4)


@register("load_wide_embeddings", R(sql("SELECT day, dim, emb_sum, emb_first FROM dsum", "dsum"),
                                    "emb_sum", "emb_first", digits=4))
def q_load_wide(spark, sf):
    dim = FX.embedding_dim(spark, sf)
    vec = E.daily_mean(news_vectors(spark, sf).select("day", "emb"))
    wide = SK.wide_embeddings(vec, dim)
    w = RD.load_wide_embeddings(wide)
    return rounded(w.select("day", F.size("emb").cast("long").alias("dim"), E.vector_sum().alias("emb_sum"),
                            F.col("emb")[0].alias("emb_first")), 4)


@register("day_texts", sql("""SELECT day, count(*) AS n_texts, CAST(sum(length(headline)) AS BIGINT) AS n_chars,
  min(md5(headline)) AS first_text FROM dedup GROUP BY day""", "dedup"))
def q_day_texts(spark, sf):
    """All texts of a day (count, characters, a digest), without gathering them."""
    return news_dedup(spark, sf).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("headline").cast("long")).alias("n_chars"),
        F.min(F.md5(F.col("headline").cast("binary"))).alias("first_text"))


_ENCODED = r"""tok AS (
  SELECT row_no, day, unnest(regexp_extract_all(lower(trim(headline || ' ' || body, {WS})), '[0-9a-z_\x{80}-\x{10FFFF}]+')) AS t FROM dedup),
hashed AS (
  SELECT row_no, day, CAST('0x' || substr(h, 1, 15) AS BIGINT) % (SELECT min(len(embedding)) FROM embeddings) AS b,
         CASE WHEN substr(h, 16, 1) < '8' THEN 1 ELSE -1 END AS s
  FROM (SELECT row_no, day, md5('42:' || t) AS h FROM tok)),
bucket AS (SELECT row_no, day, b, sum(s) AS x FROM hashed GROUP BY row_no, day, b),
unit AS (
  SELECT row_no, day, b, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY row_no)) AS FLOAT) AS v FROM bucket WHERE x <> 0),
per_day AS (SELECT day, count(*) AS n_news FROM dedup GROUP BY day),
means AS (SELECT u.day, u.b, sum(CAST(v AS DOUBLE)) / min(n_news) AS m FROM unit u JOIN per_day p ON p.day = u.day GROUP BY u.day, u.b)""".replace("{WS}", WS)


@register("encode_text", R(sql("""SELECT p.day, p.n_news, coalesce(sum(m), 0.0) AS emb_sum, coalesce(sqrt(sum(m * m)), 0.0) AS emb_norm
FROM per_day p LEFT JOIN means ON means.day = p.day GROUP BY p.day, p.n_news""", "dedup", extra=_ENCODED), "emb_sum", "emb_norm"))
def q_encode_text(spark, sf):
    """Default hashing encoder in mapInPandas on the corpus texts, then daily means."""
    from ..functions import text as TX
    from ..functions.udf import encode_text
    dim = FX.embedding_dim(spark, sf)
    d = news_dedup(spark, sf).select("row_no", "day", TX.news_text().alias("text"))
    vec = E.daily_mean(encode_text(d, dim=dim).select("day", "emb"))
    return rounded(vec.select("day", "n_news", E.vector_sum().alias("emb_sum"), E.l2_norm().alias("emb_norm")))


@register("return_paths_aligned", R(sql("""SELECT p.symbol, p.start_day, p.path_sum, ds.day IS NOT NULL AS matched,
  coalesce(ds.emb_sum, 0.0) AS cond_sum
FROM (SELECT symbol, day AS start_day, sum(r) OVER w AS path_sum, count(*) OVER wa AS na FROM rets
      WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING),
             wa AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) p
LEFT JOIN dsum ds ON ds.day = p.start_day WHERE p.na = 20""", "rets", "dsum"), "path_sum", "cond_sum"))
def q_paths_aligned(spark, sf):
    """20-day return paths over all bars, conditioned on the vector of the start day (zeros if none):
    the key join replaces the positional offset."""
    from ..operators import samples as SMP
    dim = FX.embedding_dim(spark, sf)
    paths = SMP.return_paths(FT.returns_panel(_bars(spark, sf)), 20).withColumnRenamed("start_day", "day")
    vec = E.daily_mean(news_vectors(spark, sf).select("day", "emb"))
    j = E.join_daily_embedding(paths, vec, dim)
    return rounded(j.select("symbol", F.col("day").alias("start_day"),
                            F.aggregate("path", F.lit(0.0), lambda a, x: a + x).alias("path_sum"), "matched",
                            E.vector_sum().alias("cond_sum")))
