"""A labelling sink whose batches are written once, however often a run dies and starts again.

    path/results/attempt=A/batch=N   rows of a batch, overwritten by a rerun
    path/commits/attempt=A/batch=N   one row, written when the batch is whole

Only rows of committed batches are results. A batch is made of the same rows whenever it is run: a table's rows are dealt by a
hash of their keys, and a stream's checkpoint fixes which rows a batch has. Keys must not be null; of rows that repeat a
key the least item is labelled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortal.operators.enrich import enrich_pending
from cohortal.operators.prep import pending_rows

MOST_COMMITS = 100_000  # rows of the table of commits that a join broadcasts


def open_sink(manifest: DataFrame, path: str, keys: list[str]) -> None:
    """The folders of a sink for the keys and items of a manifest; one that is there stays as it is."""
    spark, kinds = manifest.sparkSession, dict(manifest.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys([*keys, "item"]))
    for name, schema in (("results", f"{columns}, status string, value double, message string"), ("commits", "rows long")):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/attempt=0/batch=-1")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/commits").select("attempt", "batch", "rows")


def results(spark: SparkSession, path: str) -> DataFrame:
    """(*keys, item, status, value, message, attempt, batch) of all committed batches."""
    done, rows = _commits(spark, path), spark.read.parquet(f"{path}/results")
    few = done.limit(MOST_COMMITS + 1).count() <= MOST_COMMITS
    done = done.select("attempt", "batch")
    return rows.join(F.broadcast(done) if few else done.hint("merge"), ["attempt", "batch"], "left_semi").select(*(c for c in rows.columns if c not in ("attempt", "batch")), "attempt", "batch")


def _commit(spark: SparkSession, path: str, attempt: int, batch: int) -> None:
    """The mark of a batch, with the number of rows that were written."""
    n = spark.read.parquet(f"{path}/results/attempt={attempt}/batch={batch}").count()
    spark.createDataFrame([(n,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/attempt={attempt}/batch={batch}")


def _write(rows: DataFrame, path: str, evaluate: Callable[[object], float], keys: list[str], attempt: int, batch: int, retry: bool) -> None:
    spark = rows.sparkSession
    if _commits(spark, path).where((F.col("attempt") == attempt) & (F.col("batch") == batch)).limit(1).count():
        return
    one = rows.groupBy(*keys).agg(F.min("item").alias("item")) if "item" not in keys else rows.select(*keys).distinct()
    new = enrich_pending(one, results(spark, path), evaluate, keys, attempt, retry=retry, partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    new.drop("attempt").write.mode("overwrite").parquet(f"{path}/results/attempt={attempt}/batch={batch}")
    _commit(spark, path, attempt, batch)


def label_table(manifest: DataFrame, path: str, evaluate: Callable[[object], float], keys: list[str], attempt: int = 1, batches: int = 16, retry: bool = False) -> DataFrame:
    """Labels what has no result yet (to retry: no success), a batch at a time; returns results(). A rerun goes on where one ended.

    batches must be the same in all runs of an attempt, and attempts count from 1.
    """
    open_sink(manifest, path, keys)
    dealt = F.pmod(F.xxhash64(*keys), F.lit(batches))
    for k in range(batches):
        _write(manifest.where(dealt == k), path, evaluate, keys, attempt, k, retry)
    return results(manifest.sparkSession, path)


def dry_run(manifest: DataFrame, path: str, keys: list[str], retry: bool = False) -> DataFrame:
    """The manifest's rows that a run would label; nothing is written but the folders."""
    open_sink(manifest, path, keys)
    return pending_rows(manifest, results(manifest.sparkSession, path), keys, retry)


def label_arrivals(manifest: DataFrame, path: str, evaluate: Callable[[object], float], keys: list[str], attempt: int = 1) -> StreamingQuery:
    """label_table for a stream: each micro-batch is a batch of the sink. The stream's checkpoint lies in path/stream.

    A batch that died before its mark is written again, one that died after it is not.
    """
    open_sink(manifest, path, keys)
    put = lambda rows, number: _write(rows, path, evaluate, keys, attempt, number, False)
    return manifest.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/stream/attempt-{attempt}").trigger(availableNow=True).start()
