"""Connected components of a table of links, as Spark joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.scratch import Scratch

MOST_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, comp) for every node of links(a, b): comp is the smallest node that can be reached.

    Each round gives a node the least label among its own and its neighbours' labels, and then the label of that
    label (pointer jumping), until no label changes. A node with very many links is only ever pre-aggregated
    and joined, which Spark may split.
    """
    spark = scratch.spark
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, f"{name}-links")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        near = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        step = scratch.table(step, f"{name}-{k}a")
        up = step.select(F.col("node").alias("top"), F.col("comp").alias("top_comp"))
        jump = step.join(up.hint("merge"), F.col("comp") == F.col("top"), "left").select("node", F.least("comp", F.coalesce("top_comp", "comp")).alias("comp"), "old")
        labels = scratch.table(jump, f"{name}-{k}")
        changed = labels.where("comp <> old").limit(1).count()
        for old in (f"{name}-{k}a", f"{name}-{k - 1}"):
            scratch.drop(old)
        labels = labels.select("node", "comp")
        if not changed:
            scratch.drop(f"{name}-links")
            return labels
    raise RuntimeError(f"components: labels still change after {MOST_ROUNDS} rounds")
