"""News corpus operators: cleaning, dedup, reports, per-day caps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX

NEWS_COLS = ["source", "src_rank", "row_no", "day", "headline", "body"]


def clean_news(df: DataFrame) -> DataFrame:
    """Drop null day/headline, strip both texts, null body -> "", drop empty headline."""
    extra = [c for c in df.columns if c not in ("day", "headline", "body")]
    return (df.filter(F.col("day").isNotNull() & F.col("headline").isNotNull())
              .select(*extra, "day",
                      TX.strip("headline").alias("headline"),
                      TX.strip(F.coalesce(F.col("body"), F.lit(""))).alias("body"))
              .filter(F.col("headline") != ""))


def filter_period(df: DataFrame, start: str, end: str, coverage_end: str | None = None) -> DataFrame:
    """``start <= day <= min(end, coverage_end)`` (a pushed-down range predicate).

    A corpus partitioned by month (string column ``ym``, as ``sinks.sink_news_by_month`` writes it) is filtered by the
    implied range of months too, so only the folders of the period are listed and read.
    """
    stop = min(end, coverage_end) if coverage_end else end
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(stop).cast("date"))
    if dict(df.dtypes).get("ym") == "string":
        inside = inside & F.col("ym").between(start[:7], stop[:7])
    return df.filter(inside)


# Decimal digits that hold every value of an integer type counted from its smallest one.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}
_LOWEST = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}


def packed_order(df: DataFrame, order) -> Column | None:
    """One decimal that sorts like the integer columns ``order`` (nulls first); None if they do not fit 38 digits.

    A decimal is a fixed-width aggregation buffer, so its minimum stays a hash aggregate; a struct's does not.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if any(types[c] not in _DIGITS for c in order) or sum(_DIGITS[types[c]] for c in order) > 38:
        return None
    out = None
    for c in order:
        digits = f"decimal({_DIGITS[types[c]] + 1},0)"
        place = F.coalesce(F.col(c).cast(digits) + F.lit(Decimal(_LOWEST[types[c]] + 1)), F.lit(Decimal(0)))
        out = place if out is None else out * F.lit(Decimal(10 ** _DIGITS[types[c]])) + place
    return out.cast("decimal(38,0)")


def dedup_news(df: DataFrame, keys=("day", "headline"), order=("src_rank", "row_no"),
               bucket: str | None = None, unique_order: bool = False) -> DataFrame:
    """Exact dedup on ``keys``, keeping the first row by ``order``.  ``bucket`` adds a grouping column (e.g. the month)
    that is implied by the key; the result is the same.

    With ``unique_order`` the caller states that the (integer) order columns identify a row.  Rows are then materialised
    late: a hash aggregate with map-side combine over keys and packed order alone finds the first rows (a key repeated a
    million times costs one short row per partition, and no text is read for it), and whole rows meet them in a semi join
    on the packed order, whose values are all different, so no key is hot.  Callers that use few columns never read the
    bodies at all.

    Without it, equal order values may occur: ``min_by`` over whole rows keeps exactly one (a sort aggregate, also
    combined per partition first).
    """
    group = ([bucket] if bucket else []) + list(keys)
    packed = packed_order(df, order) if unique_order else None
    if packed is not None:
        first = df.groupBy(*group).agg(F.min(packed).alias("_first")).select("_first")
        return df.withColumn("_order", packed).join(first, F.col("_order") == F.col("_first"), "left_semi").drop("_order")
    rest = [c for c in df.columns if c not in group]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*group).agg(first).select(*group, "_first.*").select(*df.columns)


def ingest_stats(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: raw rows, kept, duplicates, first/last day, non-empty bodies, distinct days."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    b = kept.agg(F.count(F.lit(1)).alias("kept_rows"),
                 F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                 F.count_if(F.col("body") != "").alias("with_body"),
                 F.countDistinct("day").alias("distinct_days"))
    return (a.crossJoin(b)
             .withColumn("duplicates", F.col("raw_rows") - F.col("kept_rows"))
             .select("raw_rows", "kept_rows", "duplicates", "first_day", "last_day", "with_body", "distinct_days"))


def by_year(df: DataFrame) -> DataFrame:
    """Rows, news days and mean rows per news day, per year."""
    return (df.groupBy(F.year("day").alias("year"))
              .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("day").alias("n_days"))
              .withColumn("rows_per_day", F.col("n_rows") / F.col("n_days")))


def by_source_rollup(df: DataFrame) -> DataFrame:
    """Rows per (source, year) with per-source and grand totals (rollup)."""
    return (df.rollup("source", F.year("day").alias("year"))
              .agg(F.count(F.lit(1)).alias("n_rows")))


def by_month_dense(df: DataFrame) -> DataFrame:
    """Rows per month from the first to the last month, empty months as 0.

    One pass: the counts per month (as many as the span has months, whatever the row count) are gathered into one map,
    from which the months of the span are looked up.
    """
    month = F.trunc("day", "month")
    counts = df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("month").isNotNull())
    span = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi"),
                      F.map_from_entries(F.collect_list(F.struct("month", "n_rows"))).alias("_n"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"), "_n")
    return months.select("month", F.coalesce(F.try_element_at("_n", F.col("month")), F.lit(0)).alias("n_rows"))


def cap_rows_per_day(df: DataFrame, n: int, seed: int = 42, key: str = "day",
                     text: str = "headline", tie: str = "row_no") -> DataFrame:
    """At most ``n`` rows per day, drawn by a seeded hash order (deterministic).

    ``row_number() <= n`` is planned with a window group limit, which keeps
    only the top ``n`` per day inside each partition before the shuffle.
    """
    order = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(text)))
    w = Window.partitionBy(key).orderBy(order, F.col(tie))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def business_day_coverage(news: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct news days / Mon-Fri days of the period, in percent (can exceed 100)."""
    days = news.select("day").distinct()
    if start is None or end is None:
        span = news.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    else:
        span = news.sparkSession.range(1).select(F.lit(start).cast("date").alias("lo"),
                                                 F.lit(end).cast("date").alias("hi"))
    bdays = (span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
                 .filter(~F.dayofweek("d").isin(1, 7))
                 .agg(F.count(F.lit(1)).alias("business_days")))
    nd = days.agg(F.count(F.lit(1)).alias("news_days"))
    return (nd.crossJoin(bdays)
              .withColumn("coverage_pct", F.lit(100.0) * F.col("news_days") / F.col("business_days")))


def union_sources(*sources: DataFrame | None) -> DataFrame:
    """Append sources by name (missing columns null); absent sources are skipped."""
    present = [s for s in sources if s is not None]
    if not present:
        raise ValueError("no source present")
    out = present[0]
    for s in present[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def sorted_violations(df: DataFrame, key: str = "source", order: str = "row_no",
                      block: int = 1 << 16) -> DataFrame:
    """Rows whose day is earlier than the previous row (by ``order``) of the same source.

    Two levels, so one huge source never sits in one task: ``lag`` inside
    (source, order-block); block boundaries are checked on a small table of
    per-block first/last days.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    w = Window.partitionBy(key, "_b").orderBy(order)
    inner = b.withColumn("_prev", F.lag("day").over(w)).filter(F.col("day") < F.col("_prev"))
    summ = b.groupBy(key, "_b").agg(F.min_by("day", F.col(order)).alias("_first_day"),
                                    F.max_by("day", F.col(order)).alias("_last_day"),
                                    F.min(order).alias("_first_row"))
    wb = Window.partitionBy(key).orderBy("_b")
    edges = (summ.withColumn("_prev", F.lag("_last_day").over(wb))
                 .filter(F.col("_first_day") < F.col("_prev"))
                 .select(key, F.col("_first_row").alias(order), "_prev"))
    cross = b.join(edges, [key, order], "inner")
    cols = df.columns + ["_prev"]
    return inner.select(*cols).unionByName(cross.select(*cols))
