"""Iterations whose lineage is cut by reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROUNDS = 100
MOST_LOCAL = 5_000_000  # rows of a key that one task takes
IN_PLACE = "spark.sql.requireAllClusterKeysForCoPartition"
MOST_SMALL = 20_000  # rows of a table that is broadcast


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in spark.checkpoint.dir; where none is set and the master is local (tests), in a local folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


def with_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = MOST_SMALL) -> DataFrame:
    """left joined with right, which is broadcast where a count shows that it has at most `most` rows; else both are shuffled."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def joined_in_place(spark: SparkSession, keys: list[str], *frames: DataFrame) -> Iterator[list[DataFrame]]:
    """frames dealt by keys, and, inside, joins and groupings by these and further columns that leave rows where they are.

    Where one key has over MOST_LOCAL rows the frames stay as they are, and rows are dealt by all columns of a join.
    """
    many = [f.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0 for f in frames] if keys else []
    if not keys or max(many) > MOST_LOCAL:
        yield list(frames)
        return
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    old = spark.conf.get(IN_PLACE, "true")
    spark.conf.set(IN_PLACE, "false")
    try:
        yield [f.repartition(n, *keys) for f in frames]
    finally:
        spark.conf.set(IN_PLACE, old)


def settle(nodes: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, comp): the least node that can be reached over steps(*keys, a, b), which hold both directions.

    Labels take the least of their neighbours' labels, and then the label of their label, until nothing
    changes.
    """
    spark = nodes.sparkSession
    nodes, steps = nodes.select(*keys, "node"), checkpointed(steps.select(*keys, "a", "b").distinct())
    with joined_in_place(spark, keys, nodes, steps) as (nodes, steps):
        steps = checkpointed(steps)
        labels = checkpointed(nodes.select(*keys, "node", F.col("node").alias("comp")))
        for _ in range(MOST_ROUNDS):
            near = steps.join(labels.select(*keys, F.col("node").alias("b"), "comp").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("comp").alias("near"))
            step = labels.join(near.hint("merge"), [*keys, "node"], "left").select(*keys, "node", F.least("comp", F.coalesce("near", "comp")).alias("next"), "comp")
            up = step.select(*keys, F.col("node").alias("next"), F.col("next").alias("top"))
            labels = checkpointed(step.join(up.hint("merge"), [*keys, "next"], "left").select(*keys, "node", F.least("next", F.coalesce("top", "next")).alias("comp"), F.col("comp").alias("old")))
            if not labels.where("comp <> old").limit(1).count():
                return labels.drop("old")
            labels = labels.drop("old")
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
