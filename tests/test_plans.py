"""Plan shape: no single-partition exchange in the ordered / grouped operators, filters reach the scan."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"

NO_SINGLE_PARTITION = ["log_return", "sma", "rsi", "macd", "target_cumulative", "sliding_windows", "running_drawdown",
                       "long_short_backtest", "dedup_news_global", "cap_rows_per_day", "daily_mean_embedding",
                       "spearman", "acf", "wasserstein_1d", "ridge_gram_sums", "describe_returns", "auc_roc"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _window_over_single_partition(plan: str) -> bool:
    """A Window whose input exchange is SinglePartition (a whole table in one task).

    Global one-row aggregates (e.g. a count) also use SinglePartition, but
    only after per-task partial aggregation, so they are not flagged.
    """
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if line.strip().lstrip("+-: ").startswith("Window "):
            for nxt in lines[k + 1:k + 4]:
                if "Exchange SinglePartition" in nxt:
                    return True
    return False


@pytest.mark.parametrize("key", NO_SINGLE_PARTITION)
def test_no_window_over_single_partition(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert not _window_over_single_partition(plan), key
    if key != "daily_mean_embedding":      # that one has a global count of the vector table
        assert "SinglePartition" not in plan, key


def test_filters_and_pruning_reach_the_scan(spark):
    plan = _plan(E.queries()["load_bars"](spark, SF))
    # bars are an aggregate of lineitem: only the needed lineitem columns are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double" in plan
    assert "l_tax" not in plan and "l_discount" not in plan
    from tessera.sources import readers as RD
    news = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").filter("n_chars > 100")
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,100)]" in _plan(news)


@pytest.mark.parametrize("key", ["dedup_news_global", "dedup_news_bucketed"])
def test_dedup_aggregates_no_bodies(spark, key):
    """Keys and the packed order are hash-aggregated; bodies are neither sorted for an aggregate nor part of one."""
    plan = _plan(E.queries()[key](spark, SF))
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    for line in plan.splitlines():
        if "Aggregate" in line:
            assert "body" not in line, line


def test_reports_read_no_bodies(spark):
    """A count per month needs days and headlines only; the body's expression is gone from the plan."""
    assert "body" not in _plan(E.queries()["news_by_month_dense"](spark, SF))
