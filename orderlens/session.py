"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "orderlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are designed for; `conf` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_base: list[str] = []


def _base(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; executors must all see it, so a machine-local folder, which
    goes when the process ends, is used only when the session is local and names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_base:
        _local_base.append(tempfile.mkdtemp(prefix="orderlens-"))
        atexit.register(shutil.rmtree, _local_base[0], ignore_errors=True)
    return _local_base[0]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, under a folder of this application."""
    return os.path.join(_base(spark), f"app-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder that keeps its name, for results that later runs go on with."""
    return os.path.join(_base(spark), "kept", name)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small input out to all cores; a larger one is returned as it is.

    A table in one small file, or one row group, would keep a single task busy. A large one has
    splits enough, and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
