"""Date parsing with a fast fixed-format path and a flexible fallback.

All parses are ``try_`` forms (null on failure, also under ANSI mode); the
session time zone is UTC, so offsets are converted to UTC before the day is
taken.  ``coalesce`` evaluates the fallback only where the fast path failed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

# Formats tried after the fast path, in order (Spark datetime patterns).
FLEX_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "M/d/yyyy",
    "M/d/yy",
    "yyyyMMdd",
    "yyyy-MM-dd HH:mm:ss z",
    "yyyy-MM-dd HH:mm",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d yyyy",
    "d MMM yyyy HH:mm:ss z",
)
# A weekday in front of a date says nothing new, and Spark's patterns can't parse one.
_WEEKDAY = r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


def _missing(s: Column) -> Column:
    return (s == "") | (F.lower(s) == "nan")


def _flexible(s: Column) -> Column:
    s = F.regexp_replace(s, _WEEKDAY, "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FLEX_FORMATS])


def parse_news_date(c) -> Column:
    """Two-tier parse: first 19 chars as ``yyyy-MM-dd HH:mm:ss``, else flexible (UTC); day."""
    s = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    fast = F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    ts = F.when(_missing(s), F.lit(None)).otherwise(F.coalesce(fast, _flexible(s)))
    return F.to_date(ts)


def parse_iso_day(c) -> Column:
    """First 10 chars as ``yyyy-MM-dd``, else flexible; day."""
    s = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    fast = F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd"))
    ts = F.when(_missing(s), F.lit(None)).otherwise(F.coalesce(fast, _flexible(s)))
    return F.to_date(ts)
