"""Session helpers: one place for the configuration every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings the operators assume: UTC day boundaries, AQE for runtime
# re-planning (coalescing, skew joins, broadcast of small runtime sides).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tessera", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with ``BASE_CONF``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    b = b.master(master or os.environ.get("TESSERA_MASTER", "local[*]"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    b = b.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Uses ``spark.checkpoint.dir`` as configured by the cluster.  Only a local
    session without one (tests, laptops) gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint folder for staged outputs."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df, name: str = "stage"):
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Cuts the lineage where a plan joins a table with an aggregate of itself
    (two-level scans), so later steps do not recompute it, and survives
    executor loss (the files are on shared storage, unlike a local
    checkpoint).  The read-back table carries real size statistics for AQE.
    Disabled with ``spark.conf.set("tessera.stage", "false")``.
    """
    spark = df.sparkSession
    if spark.conf.get("tessera.stage", "true") != "true":
        return df
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


_STAGED: dict[str, list[str]] = {}


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables this application staged (call when its results are consumed)."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
    return len(paths)
