"""Structured Streaming versions of the ingestion and daily aggregation chain.

Files landing in a folder are read with ``readStream`` (explicit schema), run
through the same column logic as the batch plans and written with
``writeStream`` to parquet with a checkpoint, so a restarted query continues
where it stopped (``trigger(availableNow=True)`` processes what is there and
stops).  Exact dedup keeps no keys in the state store: the first rows of a run's
batches are compared once with each other and with what their months already hold
(``run_dedup``); inside a watermark ``dropDuplicatesWithinWatermark`` does.  Daily
vector sums keep one vector a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import news as N

NEWS_SCHEMA = "source string, src_rank int, row_no long, day date, headline string, body string"


def land(df: DataFrame, folder: str, batch: str) -> str:
    """Write one batch of files into a landing folder (what an upstream job would do)."""
    path = f"{folder}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_news_stream(spark: SparkSession, folder: str, schema: str = NEWS_SCHEMA,
                     max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  fmt: str = "parquet"):
    """Process everything available, then stop; returns the finished query (for progress)."""
    q = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def ingest_news(stream: DataFrame) -> DataFrame:
    """The batch cleaning plan applied to a stream (stateless)."""
    return N.clean_news(stream)


def dedup_within(stream: DataFrame, keys, ts: str, watermark: str) -> DataFrame:
    """First row seen of each key inside the watermark (repeats later than it may pass)."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def run_dedup(stream: DataFrame, out: str, checkpoint: str, keys=("day", "headline"), month_of: str = "day"):
    """Exact dedup of all available rows, month by month, without keys in the state store; returns the finished query.

    A batch keeps its first rows per key (by source rank and row number) beside the checkpoint, whatever was published
    before, so its cost follows its own size.  When the stream has no more to read, ``publish_first`` compares all batches of
    the run with each other and with the published months at once.
    """
    keys, arrived = list(keys), f"{checkpoint}/arrived"

    def keep(batch: DataFrame, number: int) -> None:
        N.dedup_news(batch, keys).write.mode("overwrite").parquet(f"{arrived}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    publish_first(stream.sparkSession, arrived, stream.schema, out, keys, month_of)
    return q


def publish_first(spark: SparkSession, arrived: str, schema: T.StructType, out: str, keys: list[str], month_of: str) -> None:
    """Publish of each key of ``arrived/batch=N`` the row of the earliest batch, unless ``out`` has the key already.

    The rows go to ``out/batch=N/ym=YYYY-MM`` with the number of the last batch; then the arrived rows are deleted.  Only the
    months of the arrived rows are read back.  A run that failed on the way is made good by the next one: it replaces the
    output of its own number and leaves out what other numbers hold, so a key is published once.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(arrived)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return
    rows = (spark.read.schema(schema.add("batch", "long")).parquet(arrived)
            .withColumn("ym", F.date_format(month_of, "yyyy-MM")))
    last = max(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder))
    first = N.dedup_news(rows, keys, order=("batch",)).drop("batch")
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)):
        months = [r["ym"] for r in rows.select("ym").distinct().collect()]
        published = (spark.read.schema(schema.add("ym", "string").add("batch", "long")).parquet(out)
                     .filter((F.col("batch") != last) & (F.col("ym").isin([m for m in months if m]) | F.col("ym").isNull())))
        theirs = published.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        first = first.join(theirs, same, "left_anti")
    first.write.mode("overwrite").partitionBy("ym").parquet(f"{out}/batch={last}")
    fs.delete(folder, True)


def _day_end_ms(day) -> int:
    import calendar

    return (calendar.timegm(day.timetuple()) + 86_400) * 1000


def daily_vector_sums(vectors: DataFrame, ts: str = "ts", col: str = "emb", watermark: str = "1 day") -> DataFrame:
    """(day, n, s): row count and vector sum of each day, emitted once the watermark has passed the day's end.

    Rows are added up per day inside each Arrow batch first; the state of a day is its count and one vector and is purged
    when the day is emitted.  Rows of a day that the watermark has passed are dropped.
    """
    import numpy as np
    import pandas as pd

    def partial(batches):
        for pdf in batches:
            pdf = pdf[pdf[ts].notna() & pdf[col].notna()]
            for day, g in pdf.groupby(pdf[ts].dt.date):
                total = np.sum(np.stack([np.asarray(v, dtype=float) for v in g[col]]), axis=0)
                yield pd.DataFrame([{"ts": g[ts].max(), "day": day, "n": len(g), "s": total.tolist()}])

    def accumulate(key, frames, state):
        (day,) = key
        if state.hasTimedOut:
            n, s = state.get
            state.remove()
            yield pd.DataFrame([{"day": day, "n": n, "s": list(s)}])
            return
        passed, end = state.getCurrentWatermarkMs(), _day_end_ms(day)
        n, s = state.get if state.exists else (0, None)
        for pdf in frames:
            if passed >= end:
                continue
            n += int(pdf["n"].sum())
            add = np.sum(np.stack([np.asarray(v, dtype=float) for v in pdf["s"]]), axis=0)
            s = add if s is None else np.asarray(s) + add
        if s is not None and passed < end:
            state.update((n, [float(x) for x in s]))
            state.setTimeoutTimestamp(max(end - 1, passed + 1))
        yield from ()

    parts = vectors.select(F.col(ts), F.col(col)).mapInPandas(partial, "ts timestamp, day date, n long, s array<double>")
    return parts.withWatermark("ts", watermark).groupBy("day").applyInPandasWithState(
        accumulate, "day date, n long, s array<double>", "n long, s array<double>", "append", "EventTimeTimeout")


def daily_counts(events: DataFrame, ts: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Rows per 1-day tumbling window; a day is emitted once, when the watermark has passed its end."""
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_events")).select(F.to_date("w.start").alias("day"), "n_events")
