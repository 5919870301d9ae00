"""SparkSession factory with the settings that tests and the benchmark use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session: adaptive execution on, UTC, shuffle partitions near the number of cores."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codestrata")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see, deleted when the application ends: below spark.checkpoint.dir, or a local one
    where that is unset and the session is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="codestrata-queries-")
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(of)
    return path
