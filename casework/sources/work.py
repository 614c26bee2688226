"""New folders in the one folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Own setting, read where ``spark.checkpoint.dir`` is unset.
WORK_DIR = "spark.casework.workDir"


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder name in the folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_DIR, None)
    if not shared:
        raise ValueError(f"spark.checkpoint.dir (or {WORK_DIR}) must name a shared folder")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
