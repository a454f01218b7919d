"""Session settings for tests and the benchmark, and the checkpoint folder.

On a cluster the session comes from the platform; jobs here only read
``spark.checkpoint.dir`` from it, and fail when it is unset. Local runs and
tests get a scratch folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). Only a local master without that setting
    gets a scratch folder, removed when Python exits; elsewhere each executor
    would write to its own disk, so a missing setting is an error. Works on
    Spark Connect too, where only the session conf is reachable."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if sc is None or not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_root(spark: SparkSession) -> str:
    """The run's own folder in the shared checkpoint folder: all written
    intermediates go there."""
    try:
        run = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        run = spark.conf.get("spark.app.id", "session")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerloom-{run}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the run's folder."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes the run's intermediates; results that were not written
    elsewhere can't be read after it."""
    from ledgerloom.sources import files

    files.remove(spark, scratch_root(spark))
