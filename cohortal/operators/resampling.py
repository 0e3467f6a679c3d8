"""Bootstrap intervals and permutation nulls whose draws hang on keys and a seed, not on partitions.

No table is copied for each replicate: sums over a replicate's draw are made in tasks, and one row for each block and
replicate leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed
from cohortal.operators.metrics import safe_corr
from cohortal.operators.ordering import average_ranks, running, same

BLOCK = 65_536  # groups of a block on average
WHOLE = 100_000  # rows of a group that is permuted in one task
CELLS = 4_000_000  # of a matrix of permuted places


def split_draws(n: int, sizes: list[int], rep: int, seed: int) -> np.ndarray:
    """How many of a replicate's n draws fall into each block: one multinomial draw, the same wherever it is made."""
    share = np.asarray(sizes, dtype=float) / max(1, sum(sizes))
    return np.random.default_rng([seed, rep]).multinomial(n, share / share.sum())


def block_draws(many: int, size: int, block: int, rep: int, seed: int) -> np.ndarray:
    """How often each of a block's rows is drawn, in the order of their keys."""
    return np.random.default_rng([seed, rep, block, 1]).multinomial(many, np.full(size, 1.0 / size))


def bootstrap_sums(groups: DataFrame, columns: list[str], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(rep, *columns): each column's sum over as many draws of rows of groups(grp, *columns) as there are rows.

    Rows are dealt to blocks by a hash of grp. A replicate's draws are split over the blocks once, and each block draws
    inside itself; a row for each block and replicate leaves the tasks. Nulls count as 0.
    """
    n = groups.count()
    many = max(1, n // block)
    held = groups.select("grp", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)).withColumn("_block", F.pmod(F.xxhash64("grp"), F.lit(many)).cast("int"))
    counts = {r["_block"]: r["n"] for r in held.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # a row a block
    sizes = [counts.get(k, 0) for k in range(many)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("grp", *columns)])
        values = np.column_stack([table.column(c).to_numpy() for c in columns])
        sums = np.array([block_draws(int(split_draws(n, sizes, rep, seed)[at]), len(values), at, rep, seed) @ values for rep in range(replicates)])
        return pa.Table.from_arrays([pa.array(np.arange(replicates), pa.int32()), *(pa.array(sums[:, k]) for k in range(len(columns)))], names=["rep", *columns])

    parts = held.groupBy("_block").applyInArrow(run, "rep int, " + ", ".join(f"`{c}` double" for c in columns))
    return parts.groupBy("rep").agg(*(F.sum(c).alias(c) for c in columns))


def bootstrap_ci(groups: DataFrame, value: str, replicates: int = 200, seed: int = 7, weight: str | None = None, level: float = 0.95, root: bool = False, versus: str | None = None) -> DataFrame:
    """(estimate, low, high, replicates): percentile interval of the mean of `value` over resampled groups(grp, value[, weight]).

    With a weight the statistic is the ratio of the resampled sums of value and of weight, as it must be for a mean
    over rows; with root its square root, as for an RMSE from sums of squares. versus: a second column of values, whose statistic
    over the same draws is taken off (paired). Groups without a value take no part.
    """
    rows = groups.where(F.col(value).isNotNull()).select("grp", F.col(value).alias("v"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), (F.col(versus) if versus else F.lit(0.0)).alias("o"))
    rows = checkpointed(rows)

    def stat(df: DataFrame, *by: str) -> DataFrame:
        one = lambda c: F.sqrt(F.sum(c) / F.sum("w")) if root else F.sum(c) / F.sum("w")
        return df.groupBy(*by).agg((one("v") - one("o") if versus else one("v")).alias("stat"))

    per = stat(bootstrap_sums(rows, ["v", "w", "o"], replicates, seed), "rep")
    low = (1 - level) / 2
    ends = per.agg(F.count("*").alias("replicates"), F.percentile("stat", F.array(F.lit(low), F.lit(1 - low))).alias("e"))
    return ends.crossJoin(F.broadcast(stat(rows))).select(F.col("stat").alias("estimate"), F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "replicates")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def replicate_hashes(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(reps, keys) hashes from the rows' own 64-bit hashes; the order of a replicate's hashes is its permutation."""
    salt = mixed((reps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(keys.view(np.uint64)[None, :] ^ salt[:, None])


def ranks(x: np.ndarray) -> np.ndarray:
    """One-based ranks; equal values share the mean of their places."""
    _, at, many = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(many) - (many - 1) / 2)[at]


def group_nulls(label: np.ndarray, prediction: np.ndarray, keys: np.ndarray, replicates: int) -> np.ndarray:
    """(2, replicates + 1): Pearson and Spearman of a group's rows as they are, then with labels permuted by each replicate;
    NaN where undefined. Rows are in the order of their items."""
    out = np.full((2, replicates + 1), np.nan)
    n = len(label)
    pairs = []
    for k, (y, p) in enumerate(((label, prediction), (ranks(label), ranks(prediction)))):
        y, p = y - y.mean(), p - p.mean()
        norm = float(np.sqrt((y @ y) * (p @ p)))
        if norm > 0 and len(np.unique(y)) > 1 and len(np.unique(p)) > 1:
            out[k, 0] = y @ p / norm
            pairs.append((k, y / norm, p))
    step = max(1, CELLS // max(1, n))
    for start in range(0, replicates if pairs else 0, step):
        reps = np.arange(start, min(replicates, start + step))
        order = np.argsort(replicate_hashes(keys, reps), axis=1, kind="stable")
        for k, y, p in pairs:
            out[k, reps + 1] = y[order] @ p
    return out


def permutation_null(df: DataFrame, replicates: int = 50, seed: int = 11, whole: int = WHOLE) -> DataFrame:
    """(correlation, observed, mean, low, high, max, p), a row each for pearson and spearman: labels of (grp, item, label,
    prediction) permuted inside groups; the mean correlation over groups of each replicate, its range and maximum, and the add-one p.

    A replicate's permutation is the order of hashes of the items. Groups of at most `whole` rows are permuted in the task
    that holds them, all replicates as one matrix of places; rows of larger groups are ranked by range. Groups
    without a correlation do not count. Rows without a label or a prediction take no part.
    """
    rows = df.where("label is not null and prediction is not null").select("grp", "item", F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), F.xxhash64(F.lit(seed), "item").alias("h"))
    size = rows.groupBy("grp").agg(F.count("*").alias("_n"))
    large = checkpointed(size.where(F.col("_n") > whole).select("grp"))  # as many as fit into the rows over `whole`
    any_large = large.limit(1).count() > 0
    small = rows.join(large.hint("merge"), rows["grp"].eqNullSafe(large["grp"]), "left_anti") if any_large else rows
    parts = _small_groups(small, replicates)
    if any_large:
        parts = parts.unionByName(_large_groups(rows.join(large.hint("merge"), rows["grp"].eqNullSafe(large["grp"]), "left_semi"), replicates))
    per = parts.groupBy("rep").agg(*(F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in ("pearson", "spearman")))
    kinds = F.array(*(F.struct(F.lit(c).alias("correlation"), F.lit(k).alias("k"), F.col(c).alias("r")) for k, c in enumerate(("pearson", "spearman"))))
    long = checkpointed(per.select("rep", F.explode(kinds).alias("x")).select("rep", "x.*"))
    seen = long.where("rep < 0").select("correlation", F.col("r").alias("observed"))
    found = long.where("rep >= 0").join(F.broadcast(seen), "correlation").groupBy("k", "correlation", "observed").agg(F.avg("r").alias("mean"), F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("e"), F.max("r").alias("max"), ((F.sum((F.col("r") >= F.col("observed")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return found.orderBy("k").select("correlation", "observed", "mean", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "max", "p")


SUMS = "rep int, pearson_sum double, pearson_n long, spearman_sum double, spearman_n long"


def _small_groups(rows: DataFrame, replicates: int) -> DataFrame:
    """SUMS, rep -1 for the labels as they are: a row for each task and replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((2, replicates + 1)), np.zeros((2, replicates + 1), dtype=np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        current: object = None

        def done() -> None:
            if held:
                found = group_nulls(*(np.concatenate(x) for x in zip(*held, strict=True)), replicates)
                fine = ~np.isnan(found)
                total[fine] += found[fine]
                many[:] += fine
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)]
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            index = codes.indices.to_numpy()
            names = codes.dictionary.to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)]
            for a, b in zip(edges, edges[1:], strict=False):
                name = (names[index[a]],)
                if name != current:
                    done()
                    current = name
                held.append(tuple(c[a:b] for c in columns))
        done()
        columns = [pa.array(np.arange(-1, replicates), pa.int32())]
        for k in range(2):
            columns += [pa.array(total[k]), pa.array(many[k])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUMS.split(", ")])

    return rows.select("grp", "item", "label", "prediction", "h").repartition("grp").sortWithinPartitions("grp", "item").mapInArrow(run, SUMS)


def _large_groups(rows: DataFrame, replicates: int) -> DataFrame:
    """SUMS of groups that no task holds: places in the order of the items and of each replicate's hashes, by range."""
    ranked = average_ranks(average_ranks(rows, ["grp"], "label", "rl"), ["grp"], "prediction", "rp")
    placed = checkpointed(running(ranked.withColumn("_one", F.lit(1)), ["grp"], ["item"], {"at": "_one"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // 10 // max(1, replicates))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                hashes = replicate_hashes(part.column(part.schema.get_field_index("h")).to_numpy(), np.arange(replicates))
                order = np.repeat(np.arange(part.num_rows), replicates)
                taken = part.take(pa.array(order))
                # an unsigned order in signed numbers
                signed = (hashes.T.ravel() ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.tile(np.arange(replicates), part.num_rows), pa.int32()), pa.array(signed)], names=[*part.schema.names, "rep", "order"])

    kept = placed.select("grp", "item", "label", "rl", "h", "_one")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    many = kept.mapInArrow(run, f"{fields}, rep int, order long")
    moved = running(many, ["rep", "grp"], ["order", "item"], {"at": "_one"}).select("rep", "grp", "at", F.col("label").alias("y"), F.col("rl").alias("ry"))
    joined = same(moved, placed.select("grp", "at", "prediction", "rp"), ["grp", "at"])
    as_is = placed.select(F.lit(-1).alias("rep"), "grp", F.col("label").alias("y"), F.col("rl").alias("ry"), "prediction", "rp")
    per = joined.select(*as_is.columns).unionByName(as_is).groupBy("rep", "grp").agg(safe_corr("y", "prediction").alias("p"), safe_corr("ry", "rp").alias("s"))
    return per.groupBy("rep").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("pearson_sum"), F.count("p").alias("pearson_n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("spearman_sum"), F.count("s").alias("spearman_n"))
