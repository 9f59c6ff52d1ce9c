"""Shared pieces of the text operators: staged tables, Arrow batch maps, label folds.

Conventions of every operator in this package

* A null text counts as an empty text; other null columns pass through.
* Input columns whose name an operator also returns are replaced by the operator's column.
* Rows are never dropped unless dropping them is the operator's decision; repeated rows stay repeated.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path

# Folds of the classifiers: one row in FOLDS, by crc32 of the id as text, is held out from label learning.
FOLDS = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a cut in the lineage that outlives executors.

    Spark drops the shuffle files of the write as it ends, whether or not a plan still refers to them.
    """
    path = scratch_path(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def clear_before(docs: DataFrame) -> None:
    """Delete all tables staged so far that ``docs`` does not read: for stages whose predecessors' results are written.

    What the driver still holds of their plans goes too.
    """
    spark = docs.sparkSession
    read_now = "\n".join(docs.inputFiles())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = []
    for p in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        if p.rsplit("/", 1)[1] in read_now:
            kept.append(p)
            continue
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    _WRITTEN[spark.sparkContext.applicationId] = kept
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table made by ``staged`` once no plan reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the plans that run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Plans that run inside hand at most so many rows at once to Python: for tables whose rows are megabytes."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers for the next tasks, also those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField],
                   drop: tuple[str, ...] = (), step_bytes: int | None = None) -> DataFrame:
    """Map Arrow batches row by row: ``make()`` runs once per task, its result once per batch.

    The result gives one Python list or Arrow array per new field.  Input columns pass through, except those
    named in ``drop`` and those that a new field replaces.  With ``step_bytes`` a batch is handed on in parts of about
    that size and freed memory goes back to the system after each batch; after a task it always does.
    """
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    schema = T.StructType(kept + fields)

    def run(batches):
        yield from rows_of(batches)
        give_back()

    def rows_of(batches):
        arrow = to_arrow_schema(schema)
        step = make()
        for whole in batches:
            rows = whole.num_rows
            at_once = max(1, rows * step_bytes // max(1, whole.nbytes)) if step_bytes else max(1, rows)
            for lo in range(0, rows, at_once):
                batch = whole.slice(lo, at_once)
                made = step(batch)
                columns = [batch.column(f.name) for f in kept]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(f.name).type)
                            for f, x in zip(fields, made)]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)
            if step_bytes:
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column, without a detour over Python strings."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose labels may not be learned from; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int,
             id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], dict[int, int]]:
    """A bounded sample of labelled rows for fitting, and the number of labelled rows of each class.

    Per class the ``per_class`` labelled ids of the smallest hash in the learning folds, and of those the texts of at
    most ``max_chars`` characters; so the driver gets 2 * per_class * max_chars characters at most.
    """
    marked = (labels.select(F.col(id_col), F.col(label).cast("int").alias("y"))
              .filter(F.col(id_col).isNotNull() & F.col("y").isin(0, 1) & ~held_out(id_col))
              .groupBy(id_col).agg(F.max("y").alias("y")))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # The rows are picked by id alone; a broadcast of the picked ids (2 * per_class at most) then finds their texts.
    order = (F.xxhash64(id_col), F.col(id_col))
    picked = marked.filter("y = 0").orderBy(*order).limit(per_class).union(marked.filter("y = 1").orderBy(*order).limit(per_class))
    found = (docs.select(id_col, F.col(text_col).alias("text")).filter(F.length("text") <= max_chars)
             .join(F.broadcast(picked), id_col).groupBy(id_col, "y").agg(F.min("text").alias("text")).orderBy("y", *order).collect())
    return [r["text"] for r in found], [r["y"] for r in found], counts


def logistic(x, y, weight, ridge: float = 1e-2, steps: int = 50):
    """Ridge logistic regression by Newton steps on a bounded fit sample; returns weights, the intercept last.

    Columns are scaled to unit variance for the penalty and scaled back in the result.
    """
    import numpy as np

    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    if not len(x):
        return np.zeros(x.shape[1] + 1)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    y, weight = np.asarray(y, dtype=float), np.asarray(weight, dtype=float)
    penalty = np.diag([ridge * weight.sum()] * x.shape[1] + [1e-6 * weight.sum() + 1e-9])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty @ b
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        d = np.linalg.solve(h, g)
        b -= d * min(1.0, 5.0 / max(1e-12, float(abs(d).max())))
        if abs(d).max() < 1e-8:
            break
    w = b[:-1] / scale
    return np.append(w, b[-1] - w @ centre)
