"""Fold geometry of the reference (sizes for n = 2068, nesting, no look-ahead)."""
from pyspark.sql import functions as F

from tessera.operators import splits as SP


def _n(spark, n):
    return spark.createDataFrame([("A", n)], "symbol string, n long")


def test_walk_forward_sizes(spark):
    f = SP.walk_forward(_n(spark, 2068), ["symbol"]).orderBy("fold").collect()
    assert [r.train_hi - r.train_lo for r in f] == [1240, 1378, 1516, 1654, 1792]
    assert {r.val_hi - r.val_lo for r in f} == {138}
    assert all(r.val_lo == r.train_hi for r in f)


def test_nested_inner_totals(spark):
    t = SP.nested(_n(spark, 2068), ["symbol"])
    inner = (t.filter(F.col("inner_fold").isNotNull() & (F.col("role") == "val"))
              .groupBy("outer_fold").agg(F.sum(F.col("hi") - F.col("lo")).alias("tot")).orderBy("outer_fold"))
    assert [r.tot for r in inner.collect()] == [372, 414, 453, 495, 537]
    outer_val = {r.outer_fold: (r.lo, r.hi) for r in t.filter(F.col("inner_fold").isNull() & (F.col("role") == "val")).collect()}
    for r in t.filter(F.col("inner_fold").isNotNull()).collect():
        assert r.hi <= outer_val[r.outer_fold][0]          # inner folds never touch the outer validation


def test_nothing_reaches_test(spark):
    t = SP.nested(_n(spark, 2433), ["symbol"], test_frac=0.15)
    ts = int(2433 * (1 - 0.15))
    assert max(r.hi for r in t.collect()) <= ts


def test_offset_train_range(spark):
    """Inner folds over a train range that does not start at 0 (positions 100..299)."""
    d = spark.createDataFrame([("A", 200, 100)], "symbol string, n long, off long")
    f = SP.walk_forward(d, ["symbol"], n_splits=3, offset="off").orderBy("fold").collect()
    assert f[0].train_lo == 100 and f[0].train_hi == 100 + 120
    assert all(100 <= r.val_lo < r.val_hi <= 300 for r in f)
    assert [r.val_hi - r.val_lo for r in f] == [20, 20, 20]


def test_assign_and_static_roles(spark):
    s = spark.createDataFrame([("A", i) for i in range(100)], "symbol string, i long")
    folds = spark.createDataFrame([("A", 0, 10, 20), ("A", 1, 20, 30)], "symbol string, fold int, lo long, hi long")
    a = SP.assign(s, folds, ["symbol"]).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in a] == [10, 10]
    roles = s.withColumn("n", F.lit(100)).select(SP.static_roles(F.col("i"), F.col("n")).alias("role")).groupBy("role").count()
    got = {r.role: r["count"] for r in roles.collect()}
    assert got == {"train": 69, "val": 15, "test": 16}


def test_model_folds_end_before_the_test_rows(spark):
    from tessera.plans import q_models as Q
    des = spark.sql("SELECT s AS symbol, j FROM (SELECT explode(array('A', 'B')) AS s), (SELECT id AS j FROM range(997))")
    ends = Q.wf_folds(des).join(Q.test_geometry(des).select("symbol", "test_start"), "symbol")
    assert ends.count() == 10
    assert ends.filter("train_hi > test_start or val_hi > test_start").count() == 0


def test_positions_equal_the_feature_panels(spark):
    """Rows and positions told without the recursive indicators: flat closes, a day without volume, a short symbol."""
    import datetime as dt
    from tessera.plans import features as FT

    day = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(160)]
    rows = []
    for symbol, n in (("A", 160), ("B", 40), ("C", 60)):
        for k in range(n):
            close = 100.0 if symbol == "A" and 90 <= k < 115 else 100.0 + (k * 7 % 11)
            volume = 0.0 if symbol == "A" and k == 130 else 10.0 + k % 5
            rows.append((symbol, day[k], close, close + 1, close - 1, close, volume))
    bars = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double")
    vol = spark.createDataFrame([(d, 20.0 + k % 3) for k, d in enumerate(day) if k != 70], "day date, vix_close double")
    want = {(r.symbol, r.day, r.i) for r in FT.feature_panel(bars, vol).select("symbol", "day", "i").collect()}
    assert {(r.symbol, r.day, r.i) for r in FT.feature_positions(bars, vol).collect()} == want
    # A loses its first row, day 70, the warm-up, 6 flat frames and the step out of no volume; B never gets warm.
    counts = {r.symbol: r.n for r in FT.feature_counts(bars, vol).collect()}
    assert counts == {s: sum(w[0] == s for w in want) for s in ("A", "C")}
    assert counts["A"] == 160 - 1 - 1 - 49 - 6 - 1
