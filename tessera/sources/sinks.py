"""Sinks: month-partitioned corpus, samples, wide embeddings, reports, guarded publish."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_news_by_month(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Corpus partitioned by ``ym`` and sorted by day inside each file.

    Range partitioning on (ym, day) spreads a heavy month over several tasks
    (unlike a hash on ym alone); readers prune on ``ym``.
    """
    (df.withColumn("ym", F.date_format("day", "yyyy-MM"))
       .repartitionByRange("ym", "day")
       .sortWithinPartitions("day", "row_no")
       .write.mode(mode).partitionBy("ym").parquet(path))


def sink_samples(df: DataFrame, path: str, key: str = "symbol", mode: str = "overwrite") -> None:
    """Samples / feature panel by symbol, sorted by day inside files.

    Range partitioning on (symbol, day) gives each symbol a few files instead of one from every task that held some of
    its rows, and spreads a symbol with many rows over several tasks.
    """
    df.repartitionByRange(key, "day").sortWithinPartitions(key, "day").write.mode(mode).partitionBy(key).parquet(path)


def wide_embeddings(df: DataFrame, dim: int, key: str = "day", col: str = "emb") -> DataFrame:
    """``key, emb`` -> ``key, emb_0..emb_{dim-1}``."""
    return df.select(key, *[F.col(col)[k].alias(f"emb_{k}") for k in range(dim)])


def sink_wide_embeddings(df: DataFrame, path: str, dim: int, key: str = "day", fmt: str = "csv") -> None:
    out = wide_embeddings(df, dim, key)
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def sink_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Small aggregated report frames; one file."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.option("header", True).csv(path))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    jvm = spark.sparkContext._jvm
    s, d = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = s.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.rename(s, d)


def publish_if_valid(spark: SparkSession, df: DataFrame, path: str,
                     validate: Callable[[DataFrame], None], fmt: str = "parquet") -> str:
    """Write to ``path + '.staging'``, validate the written data, then rename.

    An existing output is revalidated and reused (skip); a failing staging
    output is left unpublished and the error propagates.
    Returns "reused" or "published".
    """
    if _exists(spark, path):
        validate(spark.read.format(fmt).load(path))
        return "reused"
    staging = path.rstrip("/") + ".staging"
    df.write.mode("overwrite").format(fmt).save(staging)
    validate(spark.read.format(fmt).load(staging))
    if not _rename(spark, staging, path):
        raise RuntimeError(f"could not publish {staging} to {path}")
    return "published"
