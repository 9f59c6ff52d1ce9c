"""Refreshing partitioned outputs by fingerprint, and studies that grow by their missing trials."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as SR
from tessera.session import scratch_path
from tessera.sources import manifest as MF


def corpus(spark, changed=(), gone=()):
    rows = [(f"2020-{m:02d}", dt.date(2020, m, d), f"h{d}" + ("!" if m in changed else "")) for m in range(1, 5) for d in range(1, 6) if m not in gone]
    return spark.createDataFrame(rows, "ym string, day date, headline string")


def per_day(calls):
    def compute(rows):
        calls.append(sorted(r.ym for r in rows.select("ym").distinct().collect()))
        return rows.groupBy("ym", "day").agg(F.max("headline").alias("last"))
    return compute


def test_one_changed_month_is_recomputed_alone(spark):
    path, calls = scratch_path(spark, "refresh"), []
    first = {r.ym: r.status for r in MF.refresh(spark, corpus(spark), path, "ym", per_day(calls)).collect()}
    assert set(first.values()) == {"recomputed"} and len(first) == 4
    assert {r.status for r in MF.refresh(spark, corpus(spark).repartition(3), path, "ym", per_day(calls)).collect()} == {"kept"}
    assert len(calls) == 1
    second = {r.ym: r.status for r in MF.refresh(spark, corpus(spark, changed=(2,), gone=(4,)), path, "ym", per_day(calls)).collect()}
    assert second == {"2020-01": "kept", "2020-02": "recomputed", "2020-03": "kept", "2020-04": "removed"}
    assert calls[1:] == [["2020-02"]]
    out = {(str(r.ym), r.day.day): r["last"] for r in MF.output(spark, path).collect()}
    assert len(out) == 15 and out["2020-02", 3] == "h3!" and out["2020-01", 3] == "h3"


def test_a_run_that_dies_is_repeated(spark):
    path, calls = scratch_path(spark, "refresh"), []
    MF.refresh(spark, corpus(spark), path, "ym", per_day(calls))

    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        MF.refresh(spark, corpus(spark, changed=(3,)), path, "ym", dies)
    assert MF.output(spark, path).filter("last like '%!'").isEmpty()
    again = {r.ym: r.status for r in MF.refresh(spark, corpus(spark, changed=(3,)), path, "ym", per_day(calls)).collect()}
    assert again["2020-03"] == "recomputed" and MF.output(spark, path).filter("last like '%!'").count() == 5
    with pytest.raises(FileNotFoundError):
        MF.output(spark, path + "-none")


def test_study_grows_by_its_missing_trials(spark):
    path = scratch_path(spark, "study")
    folds = spark.range(2).select(F.col("id").cast("int").alias("fold"))
    ran = spark.sparkContext.accumulator(0)

    def loss(pdf):
        ran.add(len(pdf))
        if (pdf["trial"] == 3).any():
            raise ValueError("no")
        return pdf["dropout"] + pdf["fold"]

    trials = lambda n: SR.sample_trials(spark, n, SR.REFERENCE_SPACE, seed=1)
    a = SR.resume_study(spark, path, trials(6), folds, loss).collect()
    assert len(a) == 12 and {r.trial for r in a if r.loss is None} == {3} and all("no" in r.error for r in a if r.trial == 3)
    b = SR.resume_study(spark, path, trials(9), folds, loss).collect()
    before = ran.value
    c = SR.resume_study(spark, path, trials(9), folds, loss).collect()
    assert ran.value == before and sorted(map(str, b)) == sorted(map(str, c)) and len(c) == 18
    whole = SR.evaluate_with(trials(9).filter("trial <> 3"), folds, loss).collect()
    assert {(r.trial, r.fold): r.loss for r in c if r.trial != 3} == {(r.trial, r.fold): r.loss for r in whole}
    # A run that died before its rename left nothing in the study; the same run again completes it.
    (spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/staging/batch=half"))
    assert SR.resume_study(spark, path, trials(9), folds, loss).count() == 18
    assert np.isfinite([r.loss for r in c if r.loss is not None]).all()
    assert SR.resume_study(spark, scratch_path(spark, "none"), trials(0), folds, loss).count() == 0
