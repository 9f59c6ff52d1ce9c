"""Driver contract: entry runs, every oracle key has a query, flagship schema is stable."""
import __spark_entry__ as E


def test_contract(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"model", "horizon", "symbol", "strategy_sharpe", "strategy_max_drawdown"} <= set(df.columns)


def test_small_queries_run(spark):
    qs = E.queries()
    for k in ("dedup_news_global", "business_day_coverage", "trial_records", "select_one_se", "regime_label"):
        assert qs[k](spark, "/root/testdata/sf0.001").count() > 0


def test_clear_staged(spark):
    import os
    from tessera.session import clear_staged, stage
    d = stage(spark.range(10), "probe")
    assert d.count() == 10
    path = d.inputFiles()[0].replace("file:", "")
    assert clear_staged(spark) >= 1
    assert not os.path.exists(path)
