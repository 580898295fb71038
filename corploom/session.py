"""Session helpers: one place for the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corploom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("CORPLOOM_DRIVER_MEMORY", "8g"),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, else spark.checkpoint.dir, else (local mode only) a new one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spark-corploom-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast, after a check of its size: more than ``most`` rows are an error."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a table to broadcast has more than {most} rows")
    return F.broadcast(df)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
