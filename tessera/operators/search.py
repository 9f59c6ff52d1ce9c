"""Hyper-parameter search as Spark jobs: sampled trials, fold losses from sums,
trial records and the one-standard-error selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A distribution turns a uniform draw in [0, 1) into a value.

def log_uniform(lo: float, hi: float):
    return lambda u: F.exp(F.lit(float(np.log(lo))) + u * F.lit(float(np.log(hi) - np.log(lo))))


def uniform(lo: float, hi: float):
    return lambda u: F.lit(float(lo)) + u * F.lit(float(hi - lo))


def choice(*values):
    return lambda u: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


# The reference search space.
REFERENCE_SPACE = {
    "lr": log_uniform(1e-4, 5e-3),
    "weight_decay": log_uniform(1e-6, 1e-3),
    "hidden_size": choice(64, 128, 256),
    "d_model": choice(32, 64, 128),
    "dropout": uniform(0.1, 0.5),
    "w_t1": uniform(0.3, 0.8),
}

# Space of the ridge re-aim: penalty, number of the window's latest rows that count, weight of the first horizon.
RIDGE_SPACE = {
    "alpha": log_uniform(1e-3, 1e3),
    "n_lags": choice(1, 5, 10, 20, 30),
    "w_t1": uniform(0.3, 0.8),
}


def unit_uniform(seed: int, trial: Column, name: str, key: Column | None = None) -> Column:
    """Deterministic U[0, 1) from md5(seed[:key]:trial:name) (52 bits)."""
    parts = [F.lit(str(seed))] + ([key.cast("string")] if key is not None else []) + [trial.cast("string"), F.lit(name)]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def sample_trials(spark: SparkSession, n_trials: int, space: dict = RIDGE_SPACE, seed: int = 42,
                  start: int = 0, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``n_trials`` random configurations (trial ids start..start+n-1), per row of
    ``keys`` when given (random search replaces the sequential sampler; every
    draw is a hash, so the sample does not depend on partitioning or resumes).
    ``w_t5 = 1 - w_t1`` when the space has ``w_t1``."""
    d = spark.range(start, start + n_trials).withColumnRenamed("id", "trial")
    if keys is not None:
        d = keys.crossJoin(d)
    kc = F.col(key) if key else None
    for name, draw in space.items():
        d = d.withColumn(name, draw(unit_uniform(seed, F.col("trial"), name, kc)))
    if "w_t1" in space:
        d = d.withColumn("w_t5", F.lit(1.0) - F.col("w_t1"))
    return d


def trial_records(trials: DataFrame, trial: str = "trial", loss: str = "loss",
                  params: Sequence[str] = ()) -> DataFrame:
    """Per trial: mean loss (null when a fold failed), SE = std(ddof 1)/sqrt(k) (0 if k < 2), k."""
    k = F.count(F.lit(1))
    complete = F.count(loss) == k
    finite = complete & ~F.max(F.isnan(F.col(loss)) | (F.abs(F.col(loss)) == float("inf"))).cast("boolean")
    se = F.when(k < 2, F.lit(0.0)).otherwise(F.stddev_samp(loss) / F.sqrt(k))
    return trials.groupBy(trial, *params).agg(
        F.when(finite, F.avg(loss)).alias("mean_loss"), F.when(finite, se).alias("se"), k.alias("k"))


def select_one_se(records: DataFrame, parsimony: Sequence[Column], trial: str = "trial",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Trials within one SE of the best mean; the simplest by ``parsimony`` (then trial id).

    Per group of ``keys`` (e.g. symbol, outer fold); a group without any finite
    mean selects nothing (``enforce_selection`` raises then).
    """
    keys = list(keys)
    valid = records.filter(F.col("mean_loss").isNotNull())
    best = valid.groupBy(*keys).agg(
        F.min_by(F.struct("mean_loss", "se"), F.struct(F.col("mean_loss"), F.col(trial))).alias("_b"))
    cand = (valid.join(best, keys, "inner") if keys else valid.crossJoin(F.broadcast(best)))
    cand = cand.filter(F.col("mean_loss") <= F.col("_b.mean_loss") + F.col("_b.se"))
    pick = cand.groupBy(*keys).agg(F.min_by(F.col(trial), F.struct(*parsimony, F.col(trial))).alias("_t"))
    pick = pick.select(*[F.col(k).alias(f"_pk_{k}") for k in keys], "_t")
    cond = [F.col(k) == F.col(f"_pk_{k}") for k in keys] + [F.col(trial) == F.col("_t")]
    out = records.join(F.broadcast(pick) if not keys else pick, cond, "inner")
    return out.drop("_t", *[f"_pk_{k}" for k in keys])


def evaluate_with(trials: DataFrame, folds: DataFrame, fn) -> DataFrame:
    """Injected evaluator: ``fn(pandas frame of one trial's rows) -> losses``, over the (trial x fold) frame.

    Adds ``loss`` and ``error``.  A batch goes to ``fn`` whole; if it raises, its rows are tried one by one, so only
    the failing ones get a null loss and the message of their exception.
    """
    frame = trials.crossJoin(folds) if folds is not None else trials
    from pyspark.sql import types as T
    out_schema = T.StructType(frame.schema.fields + [T.StructField("loss", T.DoubleType()), T.StructField("error", T.StringType())])

    def judged(pdf):
        try:
            loss = pd.Series(np.asarray(fn(pdf.copy()), dtype=float), index=pdf.index)
            return pdf.assign(loss=loss.astype(object).where(loss.notna(), None), error=None)
        except Exception as e:          # a failing evaluation must not abort the search
            if len(pdf) > 1:
                return pd.concat([judged(pdf.iloc[[k]]) for k in range(len(pdf))])
            return pdf.assign(loss=None, error=f"{type(e).__name__}: {e}")

    def run(batches):
        for pdf in batches:
            yield judged(pdf) if len(pdf) else pdf.assign(loss=None, error=None)

    return frame.mapInPandas(run, out_schema)


def resume_study(spark: SparkSession, path: str, trials: DataFrame, folds: DataFrame, fn, trial: str = "trial") -> DataFrame:
    """The study at ``path`` with all of ``trials`` evaluated: only trials that it lacks run, and join the same table.

    A run's records are written aside and become part of the study by one rename, under a name that follows from the trials
    in it; so a run that dies leaves the study as it was, and a repeated run adds nothing.  Failing evaluations are records
    too (null loss, the message in ``error``).  Returns all records of the study.
    """
    from ..session import stage
    from ..sources.sinks import _exists, _rename

    log = f"{path.rstrip('/')}/records"
    have = spark.read.parquet(log).drop("batch") if _exists(spark, log) else None
    missing = trials if have is None else trials.join(have.select(trial).distinct(), trial, "left_anti")
    new = stage(evaluate_with(missing, folds, fn), "study-run")
    mark = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(trial).cast("decimal(38,0)")).alias("h")).first()
    if mark["n"]:
        name = f"batch={mark['n']}-{abs(int(mark['h'])):x}"
        aside = f"{path.rstrip('/')}/staging/{name}"
        new.write.mode("overwrite").parquet(aside)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(log)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        if not _exists(spark, f"{log}/{name}") and not _rename(spark, aside, f"{log}/{name}"):
            raise RuntimeError(f"could not commit {aside}")
    elif have is None:
        return new
    return spark.read.parquet(log).drop("batch")


def enforce_selection(selected: DataFrame, records: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The selection, if there is one for every key of ``records`` (one at all without keys); else ValueError."""
    if selected.isEmpty():
        raise ValueError("no valid trial among the results")
    if keys and records is not None:
        missing = records.select(*keys).distinct().join(selected.select(*keys), list(keys), "left_anti")
        if not missing.isEmpty():
            raise ValueError(f"no valid trial for {missing.limit(5).collect()}")
    return selected
