"""Running sums, ranks and exact quantiles over sorted rows, however few and large the groups are.

Where every group has few enough rows for a task, which is counted, sums run in a window of the group. Else rows are
dealt by range and sorted once; sums run inside a range, and the ranges of a group add up as one row each, so that no
task holds a whole group. Equal values are one row with a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortal.operators.loops import MOST_SMALL, checkpointed

MOST_LOCAL = 1_000_000  # rows of a group that a window sums up


def same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on columns of equal name, nulls being equal; right's copies go."""
    renamed = right.select(*(F.col(c).alias(f"_j_{c}") if c in names else F.col(c) for c in right.columns))
    condition = F.lit(True)
    for c in names:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(renamed.hint("merge"), condition, how).drop(*(f"_j_{c}" for c in names))


def same_small(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """same(), with right broadcast where a count shows that it has few rows, so that rows of few keys are not shuffled by them."""
    if right.limit(MOST_SMALL + 1).count() > MOST_SMALL:
        return same(left, right, names)
    renamed = right.select(*(F.col(c).alias(f"_j_{c}") if c in names else F.col(c) for c in right.columns))
    condition = F.lit(True)
    for c in names:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(F.broadcast(renamed), condition).drop(*(f"_j_{c}" for c in names))


def largest(df: DataFrame, keys: list[str]) -> int:
    """The number of rows of the largest group; tasks count before rows are shuffled."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (name, column) of sums, the sum of the column over the rows of the same keys that come before.

    order must tell apart the rows of a key.
    """
    if keys and largest(df, keys) <= MOST_LOCAL:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()))
    columns = [F.col(c) for c in (*keys, *order)]
    placed = checkpointed(df.repartitionByRange(*columns).sortWithinPartitions(*columns)).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = placed.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    parts = parts.select("_part", *keys, *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in sums))
    local = placed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    out = same_small(local, checkpointed(parts), ["_part", *keys])
    return out.select(*df.columns, *((F.col(n) + F.col(f"_e_{n}")).alias(n) for n in sums))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, many, before): the different values, how often each stands and how many rows are less."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("many"))
    return running(counts, keys, [value], {"before": "many"})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the one-based rank of a value among the rows of its keys; equal values share the mean of their places."""
    ranks = value_counts(df, keys, value).select(*keys, value, (F.col("before") + (F.col("many") + 1) / 2).alias(name))
    return same(df, ranks, [*keys, value], "left")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(*by, a column a share): exact quantiles with linear interpolation; nulls do not count."""
    keys = list(by)
    counts = value_counts(df, keys, value)
    size = checkpointed(counts.groupBy(*keys).agg(F.sum("many").alias("_n")))
    placed = same_small(counts, size, keys) if keys else counts.crossJoin(F.broadcast(size))
    at = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in shares.items()}
    held = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("many"))
    ends = [F.max(F.when(held(end(place)), F.col(value))).alias(f"_{side}_{name}") for name, place in at.items() for side, end in (("lo", F.floor), ("hi", F.ceil))]
    found = placed.groupBy(*keys, "_n").agg(*ends)
    part = lambda name: at[name] - F.floor(at[name])
    return found.select(*keys, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(n)).alias(n) for n in shares))


def with_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the mean of a column over the rows of its keys: in a window where groups fit into a task, else joined."""
    if largest(df, keys) <= MOST_LOCAL:
        return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys)))
    return same(df, df.groupBy(*keys).agg(F.avg(value).alias(name)), keys)
