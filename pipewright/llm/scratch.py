"""Intermediate tables in the folder that all executors share.

A table that several later steps read is written once as Parquet under
``spark.checkpoint.dir`` and read back: that cuts lineage, so a lost executor
costs only its own running tasks. Where the setting is absent (tests on one
machine), one temporary folder is made. Results are read from these tables, so they stay after a run;
``sweep`` deletes those of runs that began long ago.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []  # the temporary folder of a local session


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local sessions without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="pipewright-"))
    return _made[0]


#: Deletes a job's shuffle files when it ends instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RUNS = "pipewright-runs"


class Scratch:
    """The intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{RUNS}/{int(time.time())}-{name}-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, hours: float, folder: str | None = None) -> int:
    """Delete the tables of runs in the shared folder that began more than ``hours`` ago; results that still read them are lost. How many runs went."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder or shared_dir(spark)}/{RUNS}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if int(s.getPath().getName().split("-")[0]) < time.time() - 3600 * hours] if fs.exists(root) else []
    for path in old:
        fs.delete(path, True)
    return len(old)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
