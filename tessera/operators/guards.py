"""Data-quality guards.  Each returns a small report DataFrame; ``enforce``
variants collect that report (a handful of rows) and raise on failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds that must equal the reference's for the same verdicts.
MIN_ALIGNMENT = 0.95          # share of samples that must find their embedding
MAX_MONTHS_WITHOUT_NEWS = 3   # tolerated gap between expected end and last news day
DAYS_PER_MONTH = 30.44
VOLUME_WARN_ROWS = 3_000_000


class GuardError(RuntimeError):
    pass


def coverage_end(df: DataFrame, expected_end: str, max_months: float = MAX_MONTHS_WITHOUT_NEWS,
                 override: bool = False) -> DataFrame:
    """(expected end - max day) / 30.44 months; ok when within ``max_months`` or overridden."""
    gap = F.datediff(F.lit(expected_end).cast("date"), F.max("day")) / F.lit(DAYS_PER_MONTH)
    return (df.select("day").agg(F.max("day").alias("max_day"), gap.alias("months_missing"))
              .withColumn("ok", F.lit(override) | (F.col("months_missing") <= max_months)))


def alignment_report(joined: DataFrame, key: str | None = None, flag: str = "matched") -> DataFrame:
    keys = [key] if key else []
    rep = joined.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("coverage"),
                                    F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return rep.withColumn("ok", F.col("coverage") >= MIN_ALIGNMENT)


def target_scale(samples: DataFrame, keys=()) -> DataFrame:
    """std(y_t5) >= 1.5 std(y_t1) expected for cumulative 5-day targets."""
    rep = samples.groupBy(*keys).agg(F.stddev_pop("y_t1").alias("std_t1"), F.stddev_pop("y_t5").alias("std_t5"))
    return rep.withColumn("ok", F.col("std_t5") >= 1.5 * F.col("std_t1"))


def non_empty(df: DataFrame) -> bool:
    return not df.isEmpty()


def volume(df: DataFrame, warn_rows: int = VOLUME_WARN_ROWS) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("warn", F.col("n_rows") > warn_rows)


def row_hash(cols) -> Column:
    """60-bit row hash: the first 15 hex digits of md5 over the fields joined by 0x1f
    (md5 is available in every engine, so stored fingerprints stay comparable)."""
    txt = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, cols=None) -> DataFrame:
    """Content fingerprint: row count and the (order-free) sum of 60-bit row hashes.

    Stricter than size + modification time: any changed, added or removed
    row changes it; computed as one partial aggregate."""
    cols = cols or df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(cols)).cast("string").alias("hash_sum"))


def enforce(report: DataFrame, what: str, flag: str = "ok") -> None:
    """Raise ``GuardError`` if any row of a (small) report has ``flag`` false."""
    bad = report.filter(~F.coalesce(F.col(flag), F.lit(False))).limit(20).collect()
    if bad:
        raise GuardError(f"{what} failed: {[r.asDict() for r in bad]}")
