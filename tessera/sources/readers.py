"""Readers: CSV / JSON news files, bars, wide embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import text as TX

# Accepted header names (case-insensitive, stripped) per role, in order of preference.
DATE_COLS = ("date", "publish_date", "publishdate", "published_at", "publisheddate", "time")
HEADLINE_COLS = ("headline", "title", "article_title", "head", "subject")
BODY_COLS = ("body", "article", "content", "text", "article_text", "story", "description")


def _column_for(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column of the most preferred alias; of columns that normalise alike, the first."""
    headers = {name.strip().casefold(): name for name in reversed(columns)}
    return next((headers[alias] for alias in aliases if alias in headers), None)


def resolve_columns(df: DataFrame, with_body: bool = False) -> DataFrame:
    """Map unknown headers to ``date, headline, body`` (schema inspection only).

    Raises ValueError listing the columns when date or headline is missing;
    ``body`` is taken only if ``with_body`` (else the empty string).
    """
    cols = df.columns
    c_date, c_head = _column_for(cols, DATE_COLS), _column_for(cols, HEADLINE_COLS)
    c_body = _column_for(cols, BODY_COLS) if with_body else None
    if c_date is None or c_head is None:
        raise ValueError(f"cannot identify date/headline among columns {cols}; "
                         f"expected one of {sorted(DATE_COLS)} and one of {sorted(HEADLINE_COLS)}")
    body = F.col(c_body).cast("string") if c_body else F.lit("")
    extra = [c for c in cols if c in ("source", "src_rank", "row_no")]
    return df.select(F.col(c_date).cast("string").alias("date"),
                     F.col(c_head).cast("string").alias("headline"),
                     body.alias("body"), *extra)


def scan_news_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  multiline: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Large CSV: header, malformed rows dropped, only ``columns`` kept.

    Splits replace the reference's 500k-row chunks.  ``multiline`` is needed
    only when quoted fields hold newlines (it makes each file one split).
    """
    r = (spark.read.option("header", True).option("mode", "DROPMALFORMED")
         .option("multiLine", multiline).option("escape", '"'))
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    return df.select(*columns) if columns else df


NEWS_JSON_SCHEMA = T.StructType([
    T.StructField("publishedDate", T.StringType()),
    T.StructField("publishDate", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("id", T.LongType()),
])


def normalize_news_records(df: DataFrame) -> DataFrame:
    """API records -> ``(day, headline, body)``: publishedDate else publishDate,
    parsed as UTC; stripped; bad date or empty title dropped."""
    raw = F.coalesce(F.nullif(F.col("publishedDate"), F.lit("")), F.nullif(F.col("publishDate"), F.lit("")))
    out = df.select(
        D.parse_news_date(raw).alias("day"),
        TX.strip(F.coalesce(F.col("title"), F.lit(""))).alias("headline"),
        TX.strip(F.coalesce(F.col("description"), F.lit(""))).alias("body"),
        *[c for c in ("id",) if c in df.columns])
    return out.filter(F.col("day").isNotNull() & (F.col("headline") != ""))


def scan_news_json(spark: SparkSession, path: str) -> DataFrame:
    return normalize_news_records(spark.read.schema(NEWS_JSON_SCHEMA).json(path))


def load_bars(bars: DataFrame, symbols: Sequence[str] | None = None,
              start: str | None = None, end: str | None = None, required: bool = False) -> DataFrame:
    """Bars for some symbols and a period (end exclusive), rows with any null dropped.

    Filters are plain predicates on the scan columns, so Catalyst pushes them
    into the parquet reader (and prunes partitions when bars are partitioned).
    With ``required`` each of the symbols (without ``symbols``: the table) must have a row: a ValueError names those
    that have none, before anything is computed from an empty panel.
    """
    d = bars
    if symbols is not None:
        d = d.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        d = d.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(F.col("day") < F.lit(end).cast("date"))
    d = d.dropna("any")
    if required and symbols is None and d.isEmpty():
        raise ValueError(f"no bars between {start} and {end}")
    if required and symbols is not None:
        missing = sorted(set(symbols) - {r["symbol"] for r in d.select("symbol").distinct().collect()})
        if missing:
            raise ValueError(f"no bars of {missing} between {start} and {end}")
    return d


def market_days(bars: DataFrame) -> DataFrame:
    return bars.select("day").distinct()


def load_wide_embeddings(df: DataFrame, key: str = "day", prefix: str = "emb_") -> DataFrame:
    """Wide ``key, emb_0..emb_k`` -> ``key, emb array<float>`` (columns in index order)."""
    cols = sorted([c for c in df.columns if c.startswith(prefix)], key=lambda c: int(c[len(prefix):]))
    return df.select(key, F.array(*[F.col(c).cast("float") for c in cols]).alias("emb"))
