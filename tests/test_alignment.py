"""Alignment of daily vectors with market days (40 business days, vectors of ones, dim 8)."""
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import embeddings as E
from tessera.operators import guards as G

DIM = 8


def _days(n=40):
    return [d.date() for d in pd.bdate_range("2015-01-02", periods=n)]


def _samples(spark):
    return spark.createDataFrame([("AAA", d) for d in _days()], "symbol string, day date")


def _vectors(spark, days):
    return spark.createDataFrame([(d, [1.0] * DIM) for d in days], "day date, emb array<double>")


def _coverage(spark, days):
    j = E.join_daily_embedding(_samples(spark), _vectors(spark, days), DIM)
    return j, G.alignment_report(j, "symbol").collect()[0]


def test_aligned(spark):
    j, rep = _coverage(spark, _days())
    assert rep.ok and rep.coverage == 1.0
    assert j.filter(~E.any_nonzero()).count() == 0


def test_shifted_one_day_fails(spark):
    _, rep = _coverage(spark, [d + dt.timedelta(days=1) for d in _days()])
    assert not rep.ok


def test_half_coverage_fails(spark):
    _, rep = _coverage(spark, _days()[:20])
    assert not rep.ok


def test_one_missing_day_tolerated(spark):
    days = _days()
    j, rep = _coverage(spark, days[:10] + days[11:])
    assert rep.ok and j.filter(~F.col("matched")).count() == 1


def test_no_vectors_gives_zeros(spark):
    j = E.join_daily_embedding(_samples(spark), _vectors(spark, []), DIM)
    assert j.filter(E.any_nonzero()).count() == 0 and j.count() == 40


def test_fallback_and_fill(spark):
    market = spark.createDataFrame([(d,) for d in _days(10)], "day date")
    news = spark.createDataFrame([(_days(10)[2],), (_days(10)[5] + dt.timedelta(days=1),)], "day date")
    fb = {r.day: r.src for r in E.nearest_day_fallback(market, news).collect()}
    cal = {r.day: (r.source_day, r.origin) for r in E.forward_fill_calendar(E.nearest_day_fallback(market, news)).collect()}
    d = _days(10)
    assert fb[d[2]] == d[2] and fb[d[5]] == d[5] + dt.timedelta(days=1)       # day + 1 looks ahead
    assert cal[d[0]] == (None, "zero") and cal[d[4]] == (d[2], "filled")
