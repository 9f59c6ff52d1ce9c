"""Corpus chain: clean -> dedup -> calendar mapping -> encode -> daily mean -> fill.

The calendar (market day -> source day) is built from distinct days only.
News is semi-joined to the source days in use *before* the expensive encode
step, so texts of days nobody needs are never encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import news as N


def calendar(market_days: DataFrame, news: DataFrame) -> DataFrame:
    fb = E.nearest_day_fallback(market_days, news.select("day"))
    return E.forward_fill_calendar(fb)


def daily_embeddings(market_days: DataFrame, news: DataFrame, encode, dim: int,
                     cap: int | None = None) -> DataFrame:
    """``(day, emb, n_news, origin, source_day)`` for every market day.

    ``encode(df) -> df`` adds an ``emb`` column to news rows (a lookup, or a
    model through ``udf.encode_text``).
    """
    cal = calendar(market_days, news)
    used = cal.select(F.col("source_day").alias("day")).where(F.col("day").isNotNull()).distinct()
    todo = news.join(used, "day", "left_semi")
    if cap:
        todo = N.cap_rows_per_day(todo, cap)
    vec = E.daily_mean(encode(todo).select("day", "emb"))
    return E.daily_embedding(cal, vec, dim)
