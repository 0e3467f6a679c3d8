"""Resumable enrichment of a manifest, pinned inputs, release checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators.ordering import quantiles, same
from cohortal.operators.prep import pending_rows, upsert


def enrich_pending(manifest: DataFrame, finished: DataFrame, evaluate: Callable[[object], float], keys: list[str], attempt: int, limit: int | None = None, retry: bool = False, partitions: int = 32) -> DataFrame:
    """New result rows (*keys, item, status, value, message, attempt) for what has none yet.

    A failure of one item is a row of its own, not of the task. limit takes the first items by key.
    """
    todo = pending_rows(manifest, finished, keys, retry)
    if limit is not None:
        todo = todo.orderBy(*keys).limit(limit)
    kinds = {c: t for c, t in todo.dtypes}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in dict.fromkeys([*keys, "item"])), "status string", "value double", "message string", "attempt int"])

    def one(item):
        try:
            return "success", float(evaluate(item)), None
        except Exception as error:  # noqa: BLE001  any failure of the user's function becomes a row
            return "worker_error", None, str(error)[:200]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(x) for x in frame["item"]]
            yield frame.assign(status=[f[0] for f in found], value=[f[1] for f in found], message=[f[2] for f in found], attempt=attempt)

    columns = list(dict.fromkeys([*keys, "item"]))
    return todo.select(*columns).repartition(partitions).mapInPandas(run, schema)


def merge_results(finished: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upsert(finished.unionByName(new, allowMissingColumns=True), keys, "attempt")


def derive_status(value: Column, error: Column, warnings: Column, unsupported: Column | None = None) -> Column:
    """worker_error, unsupported, missing_energy, partial (there are warnings) or success, the first that holds."""
    outside = F.coalesce(unsupported, F.lit(False)) if unsupported is not None else F.lit(False)
    return F.when(error.isNotNull(), "worker_error").when(outside, "unsupported").when(value.isNull() | F.isnan(value), "missing_energy").when(F.size(warnings) > 0, "partial").otherwise("success")


def pin(meta: DataFrame, current: dict[str, str]) -> None:
    """Fails unless each stored value of meta(key, value) is the current one."""
    stored = {r["key"]: r["value"] for r in meta.where(F.col("key").isin(list(current))).collect()}
    if wrong := [k for k, v in current.items() if k in stored and stored[k] != v]:
        raise ValueError(f"pinned inputs have changed: {', '.join(sorted(wrong))}")


def pin_states(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(key, state) of each key of current(key, value): same, changed, or new where stored has none."""
    j = current.join(stored.select("key", F.col("value").alias("_stored")).hint("merge"), "key", "left")
    return j.select("key", F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") == F.col("value"), "same").otherwise("changed").alias("state"))


def release_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual, ok) of two tables (name, value), and the row `all`."""
    e, a = expected.select("name", F.col("value").alias("expected")), actual.select("name", F.col("value").alias("actual"))
    each = e.join(a, "name", "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))
    return each.unionByName(each.agg(F.bool_and("ok").alias("ok")).select(F.lit("all").alias("name"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"), "ok"))


def same_weights(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: terms on either side, and how many differ (missing ones included)."""
    j = left.select("name", F.col("weight").alias("l")).join(right.select("name", F.col("weight").alias("r")), "name", "full_outer")
    return j.agg(F.count("l").alias("left_terms"), F.count("r").alias("right_terms"), F.sum((~F.col("l").eqNullSafe(F.col("r"))).cast("int")).alias("different"))


def failures(df: DataFrame, value: str) -> DataFrame:
    """(selected, scored, coverage)"""
    return df.agg(F.count("*").alias("selected"), F.count(value).alias("scored"), (F.count(value) / F.count("*")).alias("coverage"))


def subset_runtime(items: DataFrame, requested: DataFrame, timed: DataFrame) -> DataFrame:
    """items that are requested and were timed with success and a positive time; requested ids must be unique."""
    if requested.count() != requested.select("item").distinct().count():
        raise ValueError("requested items repeat")
    good = timed.where("status = 'success' and seconds > 0").select("item").distinct()
    return items.join(requested.select("item"), "item", "left_semi").join(good, "item", "left_semi")


def throughput(timed: DataFrame, *by: str) -> DataFrame:
    """n, mean, sample deviation, median, p95 and items a second of timed(seconds)."""
    cuts = quantiles(timed, "seconds", {"median": 0.5, "p95": 0.95}, *by)
    out = timed.groupBy(*by).agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("std"), (F.count("*") / F.sum("seconds")).alias("rate"))
    return same(out, cuts, list(by), "left").select(*by, "n", "mean", "std", "median", "p95", "rate")
