"""The folder for files that outlive a task: shared by the driver and all executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; without it a temporary folder in local mode, and an error on a cluster, whose machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='motifgrid-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
