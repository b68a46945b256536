"""Intermediate tables in the shared folder that the cluster names.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: every executor and the driver
reach it, lost executors lose nothing, and the reread table has statistics for the optimizer.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it is unset, a folder of our own on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/tessera-shared"
    return folder.rstrip("/")


#: Rows that a Python worker is sent at once while a table is written: texts may be long, and memory is bounded.
BATCH_ROWS = 1_000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Generated methods of more bytes are interpreted by HotSpot for good; with this limit Spark runs such plans in small methods instead.
METHOD_SETTING, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8_000


class Workspace:
    """A folder of intermediate tables that belongs to one call of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        #: Settings that hold while a table is written.
        self.settings: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table once and return it reread, without its lineage."""
        return self.spark.read.schema(df.schema).parquet(self.write(df, name))

    def write(self, df: DataFrame, name: str) -> str:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        rows = int(self.spark.conf.get(ROWS_SETTING))
        settings = {ROWS_SETTING: str(min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS)} | self.settings
        before = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return path

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
                at = jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(conf).delete(at, True)

    def sweep(self) -> None:
        """Have Spark remove the shuffle files of plans that are done: it does so once their objects are collected."""
        gc.collect()
        self.spark._jvm.System.gc()
