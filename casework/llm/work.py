"""Tables written between the steps of an operator.

They lie in the folder that ``spark.checkpoint.dir`` names, which all executors
share, so a lost executor costs nothing that was finished.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Own setting, read where ``spark.checkpoint.dir`` is unset.
WORK_DIR = "spark.casework.workDir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on this machine alone may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_DIR, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="casework-")
        spark.conf.set(WORK_DIR, folder)
    return folder.rstrip("/")


def small(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows of the driver as a table.

    They go as Arrow: a list of rows would start a daemon and workers of its own kind on every executor, beside
    those of the functions on Arrow batches, and these stay for a while.
    """
    return spark.createDataFrame(pa.table(columns))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: their lineage ends here."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stored_at(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`stored`, with the path, for tables that are dropped before the operator ends."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`stored_at` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
