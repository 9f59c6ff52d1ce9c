"""Corpus cleaning, dedup, coverage guard and column resolution (shapes of the reference tests)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.operators import guards as G
from tessera.operators import news as N
from tessera.sources import readers as RD


def _corpus(spark, n=40):
    rows = [("s", 0, i, dt.date(2015, 1, 2) + dt.timedelta(days=i % 5), f"  titular {i % 30}  ", None) for i in range(n)]
    rows.append(("s", 0, 999, None, "sin fecha", "x"))
    rows.append(("s", 0, 1000, dt.date(2015, 1, 2), "   ", "vacio"))
    return spark.createDataFrame(rows, "source string, src_rank int, row_no long, day date, headline string, body string")


def test_clean_and_dedup_keep_first(spark):
    c = N.clean_news(_corpus(spark))
    assert c.count() == 40
    assert c.filter(F.col("body") != "").count() == 0
    d = N.dedup_news(c)
    keys = {(r.day, r.headline) for r in c.collect()}
    assert d.count() == len(keys)
    first = {r.headline: r.row_no for r in d.filter(F.col("day") == dt.date(2015, 1, 2)).collect()}
    assert first["titular 0"] == 0


def test_late_dedup_equals_min_by(spark):
    """Negative, extreme and null order values, null keys and repeated keys; ties keep one row without unique_order."""
    big = 2 ** 63 - 1
    rows = [("a", 1, 5, "k", "x"), ("a", -3, big, "k", "y"), ("a", -3, -big - 1, "k", "z"), ("b", None, 7, "k", "n"), ("b", 2, None, "m", "o"),
            ("b", 2, 0, "m", "p"), ("c", 2 ** 31 - 1, 1, None, "q"), ("c", -2 ** 31, 2, None, "r"), ("d", 0, 0, "", "s")]
    df = spark.createDataFrame(rows, "source string, src_rank int, row_no long, headline string, body string")
    late = {tuple(r) for r in N.dedup_news(df, ("headline",), unique_order=True).collect()}
    assert late == {tuple(r) for r in N.dedup_news(df, ("headline",)).collect()} == {rows[3], rows[4], rows[7], rows[8]}
    tied = df.union(df)
    assert N.dedup_news(tied, ("headline",)).count() == 4
    assert N.dedup_news(df.limit(0), ("headline",), unique_order=True).count() == 0
    assert N.packed_order(df, ["source"]) is None and N.packed_order(df, ["row_no", "row_no"]) is None
    text_order = N.dedup_news(df, ("headline",), order=("body",), unique_order=True)      # no packed form: the other way
    assert {r.body for r in text_order.collect()} == {"n", "o", "q", "s"}


@pytest.mark.parametrize("end,ok", [("2023-12-29", True), ("2020-06-11", False), ("2023-11-30", True)])
def test_coverage_guard(spark, end, ok):
    rows = [(dt.date.fromisoformat(end),), (dt.date(2015, 1, 2),), (dt.date(2018, 5, 4),)]
    df = spark.createDataFrame(rows, "day date")
    rep = G.coverage_end(df, "2023-12-31")
    assert rep.collect()[0].ok is ok
    if not ok:
        with pytest.raises(G.GuardError):
            G.enforce(rep, "coverage")
        assert G.coverage_end(df, "2023-12-31", override=True).collect()[0].ok


def test_resolve_columns(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00 UTC", "t", "b")], "Published_At string, Title string, Story string")
    assert RD.resolve_columns(df, with_body=True).columns[:3] == ["date", "headline", "body"]
    assert RD.resolve_columns(df).collect()[0].body == ""
    with pytest.raises(ValueError, match="Title"):
        RD.resolve_columns(df.drop("Published_At"))


def test_date_parsing(spark):
    df = spark.createDataFrame([("2020-06-05 06:30:54 UTC",), ("2020-06-05T02:30:00+05:00",), ("nan",), ("",), ("junk",)],
                               "raw string")
    got = [r.d for r in df.select(D.parse_news_date("raw").alias("d")).collect()]
    assert got == [dt.date(2020, 6, 5), dt.date(2020, 6, 4), None, None, None]


FORMAT_VALUES = [
    ("2020-06-05T06:30:54.123456+00:00", 5), ("2020-06-05T06:30:54Z", 5), ("2020-06-05T06:30:54.5", 5),
    ("2020-06-05 23:30:54.25-05:00", 5), ("2020-06-05T23:30:54-05:00", 6), ("2020-06-05", 5), ("2020/06/05", 5), ("06/05/2020", 5), ("6/5/2020", 5),
    ("6/5/20", 5), ("20200605", 5), ("2020-06-05 06:30:54 UTC", 5), ("2020-06-05 06:30", 5), ("Jun 5, 2020", 5),
    ("June 5, 2020", 5), ("5 Jun 2020", 5), ("5 June 2020", 5), ("Jun 5 2020", 5), ("5 Jun 2020 06:30:54 GMT", 5),
    ("Fri, 5 Jun 2020 06:30:54 GMT", 5), ("Friday, June 5, 2020", 5), ("  2020-06-05  ", 5),
]


@pytest.mark.parametrize("parse", [D.parse_news_date, D.parse_iso_day])
def test_every_date_format_has_a_value(spark, parse):
    assert len(FORMAT_VALUES) >= len(D.FLEX_FORMATS)
    df = spark.createDataFrame(FORMAT_VALUES + [("32 Jun 2020", None), (None, None), ("Fri", None)], "raw string, want int")
    # The fast paths read the first 19 (news) or ten (ISO days) characters: an offset behind them does not move the day.
    fast = parse is D.parse_iso_day
    bad = [(r.raw, r.d) for r in df.select("raw", "want", parse("raw").alias("d")).collect()
           if r.d != (None if r.want is None else dt.date(2020, 6, 5 if fast and r.raw.startswith("2020-06-05") else r.want))]
    assert bad == []


def test_sorted_guard_two_levels(spark):
    rows = [("a", i, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(50)] + [("a", 50, dt.date(2020, 1, 3))]
    df = spark.createDataFrame(rows, "source string, row_no long, day date")
    for block in (4, 1 << 16):
        assert N.sorted_violations(df, block=block).count() == 1


def test_fingerprint_changes_with_content(spark):
    a = _corpus(spark)
    fa = G.fingerprint(a).collect()[0]
    assert fa == G.fingerprint(a.repartition(3)).collect()[0]
    fb = G.fingerprint(a.withColumn("headline", F.concat("headline", F.lit("x")))).collect()[0]
    assert fa.hash_sum != fb.hash_sum
