"""Session construction for tests and the bench, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_written: list = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidewell") -> SparkSession:
    """A local session tuned for small test data (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWELL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder and is used as is.  Only a
    local test session without the setting gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tidewell-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df, label: str):
    """``df`` written once as Parquet below the checkpoint folder and read back: smaller than a
    checkpoint, and later readers prune columns.  Deleted when Python ends."""
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):  # Parquet has no such type
        return cut_lineage(df)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_later(spark, path: str) -> None:
    """``path`` is deleted when Python ends."""
    _written.append((spark, path))


def _remove_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            continue


atexit.register(_remove_written)
