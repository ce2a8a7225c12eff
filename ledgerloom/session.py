"""Sessions and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    defaults = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "8", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that the session names.

    The session's ``spark.checkpoint.dir`` is used where it is set. Where it is unset, a session in
    one process takes a folder of its own; a cluster, whose hosts would each write to theirs, is refused.
    """
    working_root(df.sparkSession)
    return df.checkpoint(eager=True)


def working_root(spark: SparkSession) -> str:
    """The shared folder of checkpoints, set for the session if it isn't yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def working_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for tables of one computation."""
    return f"{working_root(spark)}/{name}-{uuid4().hex}"
