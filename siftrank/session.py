"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session, used by the tests and by ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftrank")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.lru_cache(maxsize=1)
def _single_machine_scratch() -> str:
    return tempfile.mkdtemp(prefix="siftrank-", dir="/tmp")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder stands in only for a ``local[...]`` master with the
    setting absent; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _single_machine_scratch()
    return f"{base.rstrip('/')}/siftrank/{label}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go at its end, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_reload(
    df: DataFrame, label: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one result feeds several branches. Unlike a cached copy it
    outlives executors, and the reader knows its size when it picks a join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for it goes once it is written
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)
