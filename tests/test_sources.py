"""Sources and sinks: month pruning, files by symbol, bars that must be there."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.news import filter_period
from tessera.sources.readers import load_bars
from tessera.sources.sinks import sink_news_by_month, sink_samples


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "news")
    days = spark.range(400).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("day"), F.col("id").alias("row_no"))
    sink_news_by_month(days.withColumn("headline", F.concat(F.lit("h"), "row_no")), path)
    return path


def test_filter_period_prunes_months(spark, corpus):
    read = spark.read.schema("day date, row_no long, headline string, ym string").parquet(corpus)
    got = filter_period(read, "2020-03-10", "2020-12-31", coverage_end="2020-05-02")
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(ym" in plan and "2020-03" in plan and "2020-05" in plan
    days = sorted(r["day"] for r in got.collect())
    assert (days[0], days[-1], len(days)) == (datetime.date(2020, 3, 10), datetime.date(2020, 5, 2), 54)


def test_filter_period_without_months(spark, corpus):
    read = spark.read.schema("day date, row_no long, headline string, ym string").parquet(corpus)
    args = ("2020-02-29", "2020-03-01")
    assert sorted(filter_period(read.drop("ym"), *args).collect()) == sorted(filter_period(read, *args).drop("ym").collect())
    assert filter_period(read, "2020-05-01", "2020-04-01").count() == 0


def test_sink_samples_few_files_a_symbol(spark, tmp_path):
    rows = spark.range(4000, numPartitions=16).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("symbol"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("day"), "id")
    sink_samples(rows, str(tmp_path / "out"))
    files = {d: [f for f in os.listdir(tmp_path / "out" / d) if f.endswith(".parquet")] for d in os.listdir(tmp_path / "out") if "=" in d}
    assert len(files) == 5 and sum(map(len, files.values())) <= 5 + 4      # partitions + borders, not 16 x 5
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select("symbol", "day", "id").collect()) == sorted(rows.collect())


def test_required_bars(spark):
    bars = spark.sql("select * from values ('A', date'2020-01-02', 1.0D), ('B', date'2020-01-02', cast(null as double)) as t(symbol, day, close)")
    assert load_bars(bars, ["A"], "2020-01-01", "2020-02-01", required=True).count() == 1
    assert load_bars(bars, ["Z"]).count() == 0
    with pytest.raises(ValueError, match="B.*Z"):
        load_bars(bars, ["A", "B", "Z"], required=True)
    with pytest.raises(ValueError, match="no bars between"):
        load_bars(bars, start="2021-01-01", required=True)
