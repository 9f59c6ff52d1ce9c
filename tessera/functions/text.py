"""Scalar text helpers (JVM-side column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends by ``strip`` (ASCII whitespace, like str.strip
# on ASCII input): space, tab, newline, carriage return, vertical tab, form feed.
WS = " \t\n\r\x0b\x0c"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WS))


def news_text(headline="headline", body="body", max_chars: int | None = None) -> Column:
    """``strip(headline + " " + body)``; the legacy path cuts to ``max_chars``."""
    t = strip(F.concat_ws(" ", F.coalesce(col(headline), F.lit("")), F.coalesce(col(body), F.lit(""))))
    return F.substring(t, 1, max_chars) if max_chars else t


def first_line(c) -> Column:
    return F.substring_index(col(c), "\n", 1)


def after_first_line(c) -> Column:
    c = col(c)
    pos = F.instr(c, "\n")
    return F.when(pos > 0, F.substring(c, pos + 1, F.length(c))).otherwise(F.lit(""))
