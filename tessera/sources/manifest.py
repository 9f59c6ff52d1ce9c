"""Partitioned outputs that know which input they were computed from.

Beside the output lies a manifest: per partition the row count and content fingerprint of the input it was computed from.
``refresh`` compares it with the input of today, recomputes the partitions that differ and leaves the others alone.  The
new manifest is committed by a rename after the data, so a run that dies half-way is repeated by the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.guards import row_hash
from ..session import stage
from .sinks import _exists, _rename


def fingerprints(df: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    """(part, n_rows, hash_sum): count and order-free sum of row hashes per partition, one partial aggregate."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(cols)).cast("string").alias("hash_sum"))


def _latest(spark: SparkSession, path: str) -> int:
    """Number of the last committed manifest, 0 if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    n = _latest(spark, path)
    return spark.read.parquet(f"{path}/manifest/{n}") if n else None


def refresh(spark: SparkSession, df: DataFrame, path: str, part: str, compute: Callable[[DataFrame], DataFrame],
            cols: Sequence[str] | None = None) -> DataFrame:
    """Bring the output at ``path`` up to the input ``df``; (part, n_rows, hash_sum, status) of every partition.

    ``compute`` maps input rows of some partitions to output rows that carry ``part``; status is ``kept``, ``recomputed``
    or ``removed`` (the partition has no input any more; its output goes).  Partitions are compared by content, so touching
    files without changing a row recomputes nothing.
    """
    now = fingerprints(df, part, list(cols or [c for c in df.columns if c != part]))
    before = stored(spark, path)
    if before is None:
        report = now.withColumn("status", F.lit("recomputed"))
    else:
        old = before.select(part, F.col("n_rows").alias("_n"), F.col("hash_sum").alias("_h"))
        same = F.col("n_rows").eqNullSafe(F.col("_n")) & F.col("hash_sum").eqNullSafe(F.col("_h"))
        report = (now.join(old, part, "full").withColumn("status", F.when(F.col("n_rows").isNull(), "removed").when(same, "kept").otherwise("recomputed"))
                  .select(part, "n_rows", "hash_sum", "status"))
    report = stage(report, "manifest-report")
    changed = report.filter("status = 'recomputed'").select(part)
    data = f"{path}/data"
    if not changed.isEmpty():
        (compute(df.join(changed, part, "left_semi")).repartitionByRange(part).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(data))
    jvm = spark.sparkContext._jvm
    for r in report.filter("status = 'removed'").select(part).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{data}/{part}={r[0]}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    n = _latest(spark, path) + 1
    staging = f"{path}/manifest/staging-{n}"
    report.filter("status <> 'removed'").drop("status").write.mode("overwrite").parquet(staging)
    if not _rename(spark, staging, f"{path}/manifest/{n}"):
        raise RuntimeError(f"could not commit {staging}")
    return report


def output(spark: SparkSession, path: str) -> DataFrame:
    """The computed rows; only a committed output is read."""
    if not _latest(spark, path) or not _exists(spark, f"{path}/data"):
        raise FileNotFoundError(f"no committed output at {path}")
    return spark.read.parquet(f"{path}/data")
