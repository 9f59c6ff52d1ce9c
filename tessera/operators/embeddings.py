"""Daily embedding chain: calendar mapping, per-day vector means, alignment.

The calendar step decides, for every market day, which *source day* of news
feeds it: the day itself, else the day before, else the day after (the last
one looks ahead, as in the reference), else the last earlier source day
(forward fill), else nothing (zero vector).  It runs on distinct days only;
vectors are averaged once per source day and joined back by key, so no
vector ever travels through a window.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series as S


def nearest_day_fallback(market_days: DataFrame, news_days: DataFrame) -> DataFrame:
    """``(day, src)``: day, day-1 or day+1 (in that priority) when it has news.

    Three left equi-joins against the distinct news days (no range join).
    """
    nd = news_days.select(F.col("day").alias("_nd")).distinct()
    md = market_days.select("day").distinct()
    a = nd.select(F.col("_nd").alias("_a"))
    b = nd.select(F.col("_nd").alias("_b"))
    c = nd.select(F.col("_nd").alias("_c"))
    j = (md.join(a, md["day"] == a["_a"], "left")
           .join(b, F.date_sub(md["day"], 1) == b["_b"], "left")
           .join(c, F.date_add(md["day"], 1) == c["_c"], "left"))
    return j.select("day", F.coalesce("_a", "_b", "_c").alias("src"))


def forward_fill_calendar(fallback: DataFrame) -> DataFrame:
    """``(day, source_day, origin)`` with origin real / filled / zero.

    As-of backward on the calendar: the last non-null ``src`` up to each day.
    ``src`` is non-decreasing in ``day`` (it lies in [day-1, day+1] and the
    priority keeps the order), so the as-of value is the running maximum,
    computed with month blocks and a carry (``series.running``).
    """
    d = S.running(fallback, [], "src", "max", "source_day", i="day", bucket=S.month_bucket("day"))
    origin = (F.when(F.col("src").isNotNull(), F.lit("real"))
              .when(F.col("source_day").isNotNull(), F.lit("filled")).otherwise(F.lit("zero")))
    return d.select("day", "source_day", origin.alias("origin"))


def daily_mean(vectors: DataFrame, key: str = "day", col: str = "emb") -> DataFrame:
    """Element-wise mean of the vectors of each key (double precision).

    ``Summarizer.mean`` is a partial aggregate: each task folds its rows into
    one running sum per key before the shuffle.
    """
    v = vectors.select(key, array_to_vector(F.col(col)).alias("_v"))
    return (v.groupBy(key)
             .agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n_news"))
             .select(key, vector_to_array("_m", "float64").alias(col), "n_news"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def daily_embedding(calendar: DataFrame, day_vectors: DataFrame, dim: int) -> DataFrame:
    """Market-day vectors ``(day, emb, n_news, origin)``; zeros where origin is zero."""
    dv = day_vectors.withColumnRenamed("day", "source_day")
    j = calendar.join(dv, "source_day", "left")
    return j.select("day", F.coalesce(F.col("emb"), zeros(dim)).alias("emb"),
                    F.coalesce(F.col("n_news"), F.lit(0)).alias("n_news"), "origin", "source_day")


def join_daily_embedding(samples: DataFrame, daily: DataFrame, dim: int) -> DataFrame:
    """Left join samples to the daily vectors; zero vector and ``matched`` false when absent."""
    d = daily.select("day", F.col("emb").alias("_emb"))
    j = samples.join(d, "day", "left")
    return (j.withColumn("matched", F.col("_emb").isNotNull())
             .withColumn("emb", F.coalesce(F.col("_emb"), zeros(dim))).drop("_emb"))


def l2_norm(col: str = "emb") -> Column:
    return F.sqrt(F.aggregate(F.transform(F.col(col), lambda x: x * x), F.lit(0.0), lambda a, x: a + x))


def vector_sum(col: str = "emb") -> Column:
    return F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x)


def any_nonzero(col: str = "emb") -> Column:
    return F.exists(F.col(col), lambda x: x != 0)
