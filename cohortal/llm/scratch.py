"""Tables in the shared scratch folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where none is set and the master is local (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


class Scratch:
    """Writes intermediate tables of one operator and removes them when they are no longer read."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{owner}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str, wait: bool = False) -> DataFrame:
        """df written as a Parquet table and read back; shuffle files of its plan may then go.

        wait: after a large shuffle, gives Spark's cleaner the time to remove them before the next one begins.
        """
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        del df
        self.release(wait)
        return self.spark.read.schema(schema).parquet(path)

    @contextmanager
    def batches(self, rows: int) -> Iterator[None]:
        """Inside, Python tasks of tables that are written get so many rows at once: for rows that are whole blocks."""
        old = self.spark.conf.get(BATCH_ROWS)
        self.spark.conf.set(BATCH_ROWS, rows)
        try:
            yield
        finally:
            self.spark.conf.set(BATCH_ROWS, old)

    def numbered(self, df: DataFrame, keys: list[str], name: str, number: str) -> DataFrame:
        """df, written as a table, with the place (from 0) of each row among the rows of its keys.

        Rows are counted file by file, and files of one key add up: no task holds a whole key. Keys are not null.
        """
        self.table(df, name)
        rows = self.spark.read.schema(df.schema).parquet(self.path(name)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        files = rows.groupBy("_file", *keys).agg(F.count("*").alias("_many"))
        before = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
        files = files.select("_file", *keys, F.coalesce(before, F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy("_file", *keys).orderBy("_at")) - 1
        return rows.withColumn(number, own).join(files.hint("merge"), ["_file", *keys]).withColumn(number, F.col(number) + F.col("_before")).drop("_file", "_at", "_before")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self, wait: bool = False) -> None:
        """Spark's cleaner removes the shuffle files of plans that nothing refers to any more."""
        for _ in range(1 + 2 * wait):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5 * wait)
