"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine keeps its checkpoints; removed at the end of the process.
LOCAL_CHECKPOINTS = os.path.join(tempfile.gettempdir(), f"recallgrid-checkpoint-{os.getpid()}")


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "recallgrid") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    atexit.register(shutil.rmtree, LOCAL_CHECKPOINTS, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RECALLGRID_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent, a master on this one machine gets a folder that is removed when the process ends; on a
    cluster its absence is an error, as no folder of one machine is seen by the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            atexit.register(shutil.rmtree, LOCAL_CHECKPOINTS, ignore_errors=True)
        sc.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes df once, cuts its lineage, and survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
