"""Registered queries: news sources, cleaning, dedup, reports (2.1, 2.2, 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from ..operators import news as N
from ..oracle.views import WS, sql
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources import sinks as SK
from .registry import R, register, rounded

NEWS_OUT = "source, src_rank, row_no, day, headline, body"


def news_clean(spark, sf):
    return N.clean_news(FX.news_raw(spark, sf))


def news_dedup(spark, sf):
    return N.dedup_news(news_clean(spark, sf), unique_order=True)   # (source rank, row number) identify a row


@register("clean_news", sql(f"SELECT {NEWS_OUT} FROM clean", "clean"))
def q_clean_news(spark, sf):
    return news_clean(spark, sf).select(*NEWS_OUT.split(", "))


@register("dedup_news_global", sql(f"SELECT {NEWS_OUT} FROM dedup", "dedup"))
def q_dedup_global(spark, sf):
    return news_dedup(spark, sf)


@register("dedup_news_bucketed", sql(f"SELECT {NEWS_OUT}, CAST(date_trunc('month', day) AS DATE) AS ym FROM dedup",
                                     "dedup"))
def q_dedup_bucketed(spark, sf):
    c = news_clean(spark, sf).withColumn("ym", F.trunc("day", "month"))
    return N.dedup_news(c, bucket="ym", unique_order=True)


@register("news_ingest_stats", sql("""SELECT r.raw_rows, k.kept_rows, r.raw_rows - k.kept_rows AS duplicates,
  k.first_day, k.last_day, k.with_body, k.distinct_days
FROM (SELECT count(*) AS raw_rows FROM news) r,
     (SELECT count(*) AS kept_rows, min(day) AS first_day, max(day) AS last_day,
             count(*) FILTER (WHERE body <> '') AS with_body, count(DISTINCT day) AS distinct_days FROM dedup) k""",
                                   "dedup"))
def q_ingest_stats(spark, sf):
    return N.ingest_stats(FX.news_raw(spark, sf), news_dedup(spark, sf))


@register("news_by_year", R(sql("""SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS n_rows,
  count(DISTINCT day) AS n_days, count(*) / count(DISTINCT day) AS rows_per_day FROM dedup GROUP BY 1""", "dedup"),
                            "rows_per_day"))
def q_by_year(spark, sf):
    d = N.by_year(news_dedup(spark, sf))
    return rounded(d.withColumn("year", F.col("year").cast("long")))


@register("news_by_source_rollup", sql("""SELECT source, CAST(year(day) AS BIGINT) AS year, count(*) AS n_rows
FROM dedup GROUP BY ROLLUP (source, year(day))""", "dedup"))
def q_by_source(spark, sf):
    return N.by_source_rollup(news_dedup(spark, sf)).withColumn("year", F.col("year").cast("long"))


@register("news_by_month_dense", sql("""SELECT CAST(m.month AS DATE) AS month, coalesce(c.n, 0) AS n_rows
FROM (SELECT unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH)) AS month
      FROM dedup) m
LEFT JOIN (SELECT date_trunc('month', day) AS month, count(*) AS n FROM dedup GROUP BY 1) c
  ON CAST(c.month AS DATE) = CAST(m.month AS DATE)""", "dedup"))
def q_by_month_dense(spark, sf):
    return N.by_month_dense(news_dedup(spark, sf))


@register("cap_rows_per_day", sql("""SELECT day, row_no, headline FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY md5('42:' || headline), row_no) AS rk FROM dedup)
WHERE rk <= 3""", "dedup"))
def q_cap(spark, sf):
    return N.cap_rows_per_day(news_dedup(spark, sf), 3, seed=42).select("day", "row_no", "headline")


@register("business_day_coverage", R(sql("""SELECT nd.news_days, bd.business_days,
  100.0 * nd.news_days / bd.business_days AS coverage_pct
FROM (SELECT count(DISTINCT day) AS news_days FROM dedup) nd,
     (SELECT count(*) AS business_days FROM (
        SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM dedup)
      WHERE dayofweek(d) NOT IN (0, 6)) bd""", "dedup"), "coverage_pct"))
def q_coverage(spark, sf):
    return rounded(N.business_day_coverage(news_dedup(spark, sf)))


def _api_news(spark, sf):
    """Second source: API-like records derived from the conversations table."""
    c = FX.table(spark, sf, "conversations")
    return c.select(F.lit("api").alias("source"), F.lit(100).alias("src_rank"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"),
                    F.date_add(F.lit("1995-01-02").cast("date"),
                               ((F.col("conv_id") * 7 + F.col("turn")) % 250).cast("int")).alias("day"),
                    TX.first_line("text").alias("headline"))


_API_SQL = """api AS (
  SELECT 'api' AS source, 100 AS src_rank, conv_id * 1000 + turn AS row_no,
         DATE '1995-01-02' + CAST((conv_id * 7 + turn) % 250 AS INTEGER) AS day,
         split_part(text, chr(10), 1) AS headline, CAST(NULL AS VARCHAR) AS body
  FROM conversations)"""


@register("union_sources", sql(f"""SELECT u.src_rank, count(*) AS n_rows,
  (SELECT count(*) FROM k WHERE k.src_rank = u.src_rank) AS n_kept
FROM u GROUP BY u.src_rank""", "news", extra=f"""{_API_SQL},
u AS (SELECT source, src_rank, row_no, day, trim(headline, {WS}) AS headline, trim(coalesce(body, ''), {WS}) AS body
      FROM (SELECT source, src_rank, row_no, day, headline, body FROM news UNION ALL SELECT * FROM api)
      WHERE day IS NOT NULL AND headline IS NOT NULL AND trim(headline, {WS}) <> ''),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, headline ORDER BY src_rank, row_no) AS rn FROM u)
      WHERE rn = 1)"""))
def q_union(spark, sf):
    u = N.clean_news(N.union_sources(FX.news_raw(spark, sf), None, _api_news(spark, sf)))
    k = N.dedup_news(u)
    a = u.groupBy("src_rank").agg(F.count(F.lit(1)).alias("n_rows"))
    b = k.groupBy("src_rank").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(b, "src_rank", "left").select("src_rank", "n_rows", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def _raw_dates(spark, sf):
    e = FX.table(spark, sf, "events")
    k = F.col("event_id") % 5
    return e.select("event_id", F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
                    .when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")))
                    .when(k == 2, F.lit("nan")).when(k == 3, F.lit(""))
                    .otherwise(F.concat(F.lit("garbage "), F.col("event_type"))).alias("raw"))


@register("parse_news_date", """SELECT event_id, raw,
  CAST(coalesce(try_strptime(substr(raw, 1, 19), '%Y-%m-%d %H:%M:%S'),
                CAST(TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)) AS DATE) AS day
FROM (SELECT event_id, CASE event_id % 5
        WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC'
        WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:00'
        WHEN 2 THEN 'nan' WHEN 3 THEN '' ELSE 'garbage ' || event_type END AS raw FROM events)""")
def q_parse_news_date(spark, sf):
    return _raw_dates(spark, sf).withColumn("day", D.parse_news_date("raw"))


@register("parse_iso_day", """SELECT event_id, raw,
  coalesce(try_strptime(substr(raw, 1, 10), '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y'))::DATE AS day
FROM (SELECT event_id, CASE event_id % 4
        WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
        WHEN 2 THEN 'nan' ELSE strftime(ts, '%m/%d/%Y') END AS raw FROM events)""")
def q_parse_iso_day(spark, sf):
    e = FX.table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd"))
           .when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
           .when(k == 2, F.lit("nan")).otherwise(F.date_format("ts", "MM/dd/yyyy")))
    return e.select("event_id", raw.alias("raw")).withColumn("day", D.parse_iso_day("raw"))


@register("filter_period", sql(f"SELECT {NEWS_OUT} FROM dedup WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'",
                               "dedup"))
def q_filter_period(spark, sf):
    return N.filter_period(news_dedup(spark, sf), "1995-03-01", "1995-08-31", coverage_end="1995-06-30")


@register("news_text", sql(f"SELECT row_no, trim(headline || ' ' || body, {WS}) AS text FROM dedup", "dedup"))
def q_news_text(spark, sf):
    return news_dedup(spark, sf).select("row_no", TX.news_text().alias("text"))


@register("resolve_columns", sql("SELECT CAST(day AS VARCHAR) AS date, headline, body, source, src_rank, row_no FROM news",
                                 "news"))
def q_resolve_columns(spark, sf):
    raw = FX.news_raw(spark, sf).select(F.col("day").alias("Published_At"), F.col("headline").alias(" Article_Title"),
                                        F.col("body").alias("Story"), "source", "src_rank", "row_no")
    return RD.resolve_columns(raw, with_body=True)


@register("scan_news_csv", sql(f"SELECT {NEWS_OUT} FROM clean", "clean"))
def q_scan_news_csv(spark, sf):
    """Sink the cleaned corpus as CSV in the shared scratch folder, then scan it back."""
    path = scratch_path(spark, "news-csv")
    news_clean(spark, sf).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    schema = "source string, src_rank int, row_no long, day date, headline string, body string"
    back = RD.scan_news_csv(spark, path, schema=schema, multiline=True)
    return N.clean_news(back).select(*NEWS_OUT.split(", "))


@register("scan_news_json", sql("""SELECT id, CAST(CAST(TRY_CAST(ts AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS DATE) AS day,
  headline, body
FROM (SELECT row_no AS id, strftime(day, '%Y-%m-%d') || 'T02:30:00+05:00' AS ts, headline, body FROM clean)""",
                                "clean"))
def q_scan_news_json(spark, sf):
    """API-style JSON records (half with ``publishedDate``, half ``publishDate``) written and read back."""
    path = scratch_path(spark, "news-json")
    c = news_clean(spark, sf)
    ts = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T02:30:00+05:00"))
    even = F.col("row_no") % 2 == 0
    recs = c.select(F.when(even, ts).alias("publishedDate"), F.when(~even, ts).alias("publishDate"),
                    F.col("headline").alias("title"), F.col("body").alias("description"),
                    "source", F.col("row_no").alias("id"))
    recs.write.mode("overwrite").json(path)
    return RD.scan_news_json(spark, path)
