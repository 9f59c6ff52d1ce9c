"""Chronological splits as *range tables*, never index lists.

A fold table has one row per (key, fold, role) with ``[lo, hi)`` positions;
samples get their role by a join on the key plus ``lo <= i < hi``.  The fold
table has (keys x folds) rows; AQE broadcasts it at run time when its
measured size is under the threshold, else the join stays sort-merge with
skew splitting.  Integer arithmetic follows the reference exactly (q3: the
remainder is divided by ``n_splits + 1``; the last block is never used).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _floor_frac(n: Column, frac: float) -> Column:
    return F.floor(n.cast("double") * F.lit(float(frac))).cast("long")


def counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def walk_forward(n_table: DataFrame, keys: Sequence[str], n_splits: int = 5,
                 train_min_frac: float = 0.6, n: str = "n", offset: str | None = None,
                 embargo: int = 0) -> DataFrame:
    """``(keys, fold, train_lo, train_hi, val_lo, val_hi)`` per key.

    min_train = floor(n * frac); val = (n - min_train) div (n_splits + 1);
    fold k trains on [0, min_train + k val) and validates the next ``val``
    positions; folds running past ``n`` are dropped.  ``offset`` (a column)
    shifts all positions (for splits inside a train range).  ``embargo``
    removes that many training positions before each validation block (the
    reference has none, q4: its 5-day targets of the last training rows
    overlap the validation rows; ``embargo=5`` removes the overlap).
    """
    nn = F.col(n)
    d = (n_table.withColumn("_mt", _floor_frac(nn, train_min_frac))
                .withColumn("_vs", F.floor((nn - F.col("_mt")) / (n_splits + 1)).cast("long"))
                .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))))
    off = F.col(offset) if offset else F.lit(0)
    d = (d.withColumn("_te", F.col("_mt") + F.col("fold") * F.col("_vs"))
          .withColumn("_ve", F.col("_te") + F.col("_vs"))
          .filter(F.col("_ve") <= nn))
    return d.select(*keys, "fold", off.cast("long").alias("train_lo"),
                    (off + F.greatest(F.col("_te") - F.lit(embargo), F.lit(0))).alias("train_hi"),
                    (off + F.col("_te")).alias("val_lo"), (off + F.col("_ve")).alias("val_hi"))


def final_test_start(n: Column, test_frac: float = 0.15) -> Column:
    """int(n * (1 - test_frac)), with 1 - test_frac computed in double like Python."""
    return _floor_frac(n, 1.0 - test_frac)


def nested(n_table: DataFrame, keys: Sequence[str], n_outer: int = 5, n_inner: int = 3,
           train_min_frac: float = 0.6, test_frac: float | None = None, n: str = "n") -> DataFrame:
    """Two-level range table ``(keys, outer_fold, inner_fold, role, lo, hi)``.

    Outer folds split ``[0, test_start)`` (``test_start = n`` if ``test_frac``
    is None); inner folds split each outer training range the same way, with
    positions mapped into it.  ``inner_fold`` is null on outer rows.
    """
    base = n_table
    if test_frac is not None:
        base = base.withColumn(n, final_test_start(F.col(n), test_frac))
    outer = walk_forward(base, keys, n_outer, train_min_frac, n=n).withColumnRenamed("fold", "outer_fold")
    inner_in = outer.select(*keys, "outer_fold", (F.col("train_hi") - F.col("train_lo")).alias("_m"),
                            F.col("train_lo").alias("_off"))
    inner = (walk_forward(inner_in, [*keys, "outer_fold"], n_inner, train_min_frac, n="_m", offset="_off")
             .withColumnRenamed("fold", "inner_fold"))

    def rows(df, inner_col):
        return df.select(*keys, "outer_fold", inner_col.alias("inner_fold"),
                         F.explode(F.array(
                             F.struct(F.lit("train").alias("role"), F.col("train_lo").alias("lo"),
                                      F.col("train_hi").alias("hi")),
                             F.struct(F.lit("val").alias("role"), F.col("val_lo").alias("lo"),
                                      F.col("val_hi").alias("hi")))).alias("_r")).select(
            *keys, "outer_fold", "inner_fold", "_r.role", "_r.lo", "_r.hi")

    return rows(outer, F.lit(None).cast("int")).unionByName(rows(inner, F.col("inner_fold").cast("int")))


def static_roles(i: Column, n: Column, train: float = 0.70, val: float = 0.85, offset: int = 1) -> Column:
    """70/15/15 by rows; a sample at position i is train if i < floor(.7 n) - offset, etc."""
    te = _floor_frac(n, train) - offset
    ve = _floor_frac(n, val) - offset
    return F.when(i < te, F.lit("train")).when(i < ve, F.lit("val")).otherwise(F.lit("test"))


def assign(samples: DataFrame, folds: DataFrame, keys: Sequence[str], i: str = "i") -> DataFrame:
    """Samples x fold ranges on the key with ``lo <= i < hi`` (each sample meets
    at most one range per fold and role)."""
    rest = [c for c in folds.columns if c not in keys and c not in ("lo", "hi")]
    f = folds.select(*[F.col(k).alias(f"_fk_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                     *rest)
    cond = [F.col(k) == F.col(f"_fk_{k}") for k in keys] + [F.col(i) >= F.col("_lo"), F.col(i) < F.col("_hi")]
    j = samples.join(f, cond, "inner")
    return j.select(*samples.columns, *rest)
