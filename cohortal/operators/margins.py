"""Exact quantile bins over the differences of all pairs inside groups, without making the pairs.

In the order of predictions the rows before a row whose difference from it is at most t are a run that ends at the row; its
lower end is a count of smaller values. So the pairs within t are a sum of counts, and order statistics are found by
selection: counts at a few differences narrow the interval that holds each of them, until the pairs left in it are
few enough to be listed. Counts come from running sums over rows and probes, for groups of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed
from cohortal.operators.metrics import _bit, _digits
from cohortal.operators.ordering import running, same

SAMPLE = 20_000  # pairs drawn from an interval to choose where to count next
LISTED = 1_000_000  # pairs of an interval that are listed
SPREAD = 4.0  # standard errors around a sampled quantile
ROUNDS = 100


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, and back again (its own inverse)."""
    return np.where(x < 0, np.int64(-(2**63)) - x, x)


def cutoffs(values: np.ndarray, differences: list[float]) -> np.ndarray:
    """(values, differences): the least x whose difference from the value, as it is rounded, is at most t; by bisection over doubles."""
    t = np.broadcast_to(np.asarray(differences, dtype=np.float64)[None, :], (len(values), len(differences)))
    v = np.broadcast_to(np.asarray(values, dtype=np.float64)[:, None], t.shape)
    below = v - t - 1e-14 * (np.abs(v) + t) - 1e-300  # too far by more than rounding
    low, high = (_ordered(np.ascontiguousarray(x + 0.0).view(np.int64)) for x in (below, v))
    while (open_ := high > low + 1).any():
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        fits = v - _ordered(middle).view(np.float64) <= t
        high, low = np.where(open_ & fits, middle, high), np.where(open_ & ~fits, middle, low)
    return _ordered(high).view(np.float64)


def placed_rows(df: DataFrame) -> DataFrame:
    """(grp, item, label, prediction, at): the rows of both values, numbered in a group by prediction."""
    rows = df.where("label is not null and prediction is not null").select("grp", "item", F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"))
    return checkpointed(running(rows.withColumn("_one", F.lit(1)), ["grp"], ["prediction", "item"], {"at": "_one"}).drop("_one"))


def lower_ends(placed: DataFrame, differences: list[float]) -> DataFrame:
    """(grp, item, label, prediction, at, k, low, sum): for each row and difference k, how many rows of its group are further below, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.num_rows, len(differences)
            x = cutoffs(batch.column(3).to_numpy(), differences)
            taken = batch.take(pa.array(np.repeat(np.arange(n), m)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.tile(np.arange(m), n), pa.int32()), pa.array(x.ravel())], names=[*batch.schema.names, "k", "edge"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    probes = placed.mapInArrow(run, f"{fields}, k int, edge double").withColumn("_point", F.lit(0)).withColumn("_value", F.lit(0.0))
    points = placed.select("*", F.lit(-1).alias("k"), F.col("prediction").alias("edge"), F.lit(1).alias("_point"), F.col("prediction").alias("_value"))
    found = running(probes.unionByName(points), ["grp"], ["edge", "_point", "at", "k"], {"low": "_point", "sum": "_value"})
    return found.where("k >= 0").drop("edge", "_point", "_value")


class Interval:
    """Where an order statistic lies: above `low`, below which and at which `before` pairs lie, and at most `high`."""

    def __init__(self, rank: int, high: float, total: int):
        self.rank, self.low, self.before, self.high, self.upto, self.value = rank, -1.0, 0, high, total, None

    def open(self) -> bool:
        return self.value is None and self.upto - self.before > LISTED

    def counted(self, t: float, n: int) -> None:
        if n < self.rank and t > self.low:
            self.low, self.before = t, n
        elif n >= self.rank and t < self.high:
            self.high, self.upto = t, n
        if np.nextafter(max(self.low, 0.0) if self.low >= 0 else -np.inf, np.inf) >= self.high >= 0 and self.low >= 0 or self.high == 0.0:
            self.value = self.high

    def asks(self, drawn: np.ndarray, weight: np.ndarray) -> list[float]:
        """Differences to count at: sampled quantiles around the rank, and middles where the sample says nothing."""
        out = {(max(self.low, 0.0) + self.high) / 2}
        if len(drawn):
            order = np.argsort(drawn)
            share = np.cumsum(weight[order]) / weight.sum()
            at = (self.rank - self.before) / max(1, self.upto - self.before)
            error = SPREAD * math.sqrt(max(at * (1 - at), 1e-4) / len(drawn)) + 1 / len(drawn)
            out |= {float(drawn[order][min(len(drawn) - 1, int(np.searchsorted(share, min(1.0, max(0.0, x)))))]) for x in (at - error, at, at + error)}
        return sorted(t for t in out | {float(np.nextafter(t, -np.inf)) for t in out} if max(self.low, -0.0) <= t < self.high and t >= 0)


def _sample(ends: DataFrame, placed: DataFrame, low: int, high: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences of pairs between two counted ones, k = low and high, drawn by hash, and their weights; about SAMPLE of them."""
    one = lambda k, name: F.max(F.when(F.col("k") == k, F.col("low"))).alias(name)
    rows = ends.groupBy("grp", "at", "prediction").agg(one(low, "_to"), one(high, "_from"))
    rows = rows.withColumn("_to", F.coalesce("_to", "at")).withColumn("_from", F.coalesce("_from", F.lit(0))).withColumn("_n", F.col("_to") - F.col("_from")).where("_n > 0")
    chance = F.least(F.lit(1.0), F.col("_n") * (SAMPLE / max(1, total)))
    h = lambda s: F.pmod(F.xxhash64("grp", "at", F.lit(seed + s)), F.lit(2**31))
    drawn = rows.where(h(0) < chance * 2**31).withColumn("_other", F.col("_from") + F.pmod(h(1), F.col("_n"))).withColumn("_weight", F.col("_n") / chance)
    other = placed.select(F.col("grp").alias("_g"), F.col("at").alias("_other"), F.col("prediction").alias("_p"))
    met = drawn.join(other.hint("merge"), F.col("grp").eqNullSafe(F.col("_g")) & (drawn["_other"] == other["_other"]))
    found = met.select((F.col("prediction") - F.col("_p")).alias("d"), "_weight").limit(4 * SAMPLE).toArrow()
    return found.column("d").to_numpy(), found.column("_weight").to_numpy()


def _listed(placed: DataFrame, interval: Interval) -> np.ndarray:
    """The differences in an interval of few pairs, sorted."""
    ends = lower_ends(placed, [interval.low, interval.high] if interval.low >= 0 else [interval.high])
    last = len([interval.low] if interval.low >= 0 else [])
    rows = ends.groupBy("grp", "at", "prediction").agg(*(F.max(F.when(F.col("k") == k, F.col("low"))).alias(n) for k, n in ((0 if last else -1, "_to"), (last, "_from"))))
    rows = rows.withColumn("_to", F.coalesce("_to", "at")).where("_to > _from")
    each = rows.select("grp", "prediction", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_other"))  # LISTED at most
    other = placed.select(F.col("grp").alias("_g"), F.col("at").alias("_at"), F.col("prediction").alias("_p"))
    met = each.join(other.hint("merge"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_other") == F.col("_at")))
    return np.sort(met.select((F.col("prediction") - F.col("_p")).alias("d")).toArrow().column("d").to_numpy())


def order_statistics(placed: DataFrame, ranks: list[int], most: float, total: int) -> dict[int, float]:
    """The pair differences of these ranks, from 1, among all pairs of a group of placed_rows(); most is the largest difference."""
    intervals = [Interval(r, most, total) for r in sorted(set(ranks))]
    for turn in range(ROUNDS):
        open_ = [i for i in intervals if i.open()]
        if not open_:
            break
        # each interval's ends come first, so that pairs between them can be drawn
        ends = sorted({t for i in open_ for t in (i.low, i.high) if t >= 0})
        known = checkpointed(lower_ends(placed, ends))
        asked = set()
        for a, b in sorted({(i.low, i.high) for i in open_}):
            own = [i for i in open_ if (i.low, i.high) == (a, b)]
            drawn = _sample(known, placed, ends.index(a) if a >= 0 else -1, ends.index(b), own[0].upto - own[0].before, 31 * turn)
            asked |= {t for i in own for t in i.asks(*drawn)}
        listed = sorted(asked)
        counts = {r["k"]: r["n"] for r in lower_ends(placed, listed).groupBy("k").agg(F.sum(F.col("at") - F.col("low")).alias("n")).collect()}
        for k, t in enumerate(listed):
            for i in open_:
                i.counted(t, counts[k])
    else:
        raise RuntimeError(f"order statistics are still open after {ROUNDS} rounds")
    seen: dict[tuple[float, float], np.ndarray] = {}
    for i in intervals:
        if i.value is None:
            key = (i.low, i.high)
            if key not in seen:
                seen[key] = _listed(placed, i)
            i.value = float(seen[key][i.rank - i.before - 1])
    return {i.rank: i.value for i in intervals}


def margin_bins(df: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, lower, upper, n, mean_margin, correctness): all pairs inside groups of df(grp, item, label, prediction), cut at exact
    quantiles of the absolute difference of predictions.

    A pair is right (1) if both orders agree and 1/2 if labels or predictions are equal. Bins are half-open but for the
    last; a bin without a pair has no row. Rows without a label or a prediction take no part; items tell the rows of a group apart.
    """
    spark = df.sparkSession
    placed = placed_rows(df)
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n"), (F.max("prediction") - F.min("prediction")).alias("w"))
    total, most = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long"), F.max("w")).first()
    schema = "bin int, lower double, upper double, n long, mean_margin double, correctness double"
    if not total:
        return spark.createDataFrame([], schema)
    at = [k / bins * (total - 1) for k in range(bins + 1)]
    found = order_statistics(placed, [r for x in at for r in (math.floor(x) + 1, math.ceil(x) + 1)], float(most), total)
    low, high = ([found[int(f(x)) + 1] for x in at] for f in (math.floor, math.ceil))
    edges = [a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, at, strict=True)]
    cuts = [float(np.nextafter(e, -np.inf)) for e in edges[1:-1]] + [float(most)]
    cuts = [t if t >= 0 else -1.0 for t in cuts]
    sums = _sums(placed, sorted({t for t in cuts if t >= 0})) | {-1.0: (0, 0.0, 0.0)}
    before, rows = (0, 0.0, 0.0), []
    for k, t in enumerate(cuts):
        now = sums[t]
        n, margin, right = (a - b for a, b in zip(now, before, strict=True))
        if n:
            rows.append((k, edges[k], edges[k + 1], n, margin / n, right / n))
        before = now
    return spark.createDataFrame(rows, schema)


def _sums(placed: DataFrame, differences: list[float]) -> dict[float, tuple[int, float, float]]:
    """For each difference: the number of pairs within it, the sum of their margins, and of their correctness."""
    numbered = running(placed.groupBy("grp", "label").agg(F.count("*").alias("_c")), ["grp"], ["label"], {"lb": "_c"}).select("grp", "label", "lb")
    placed = checkpointed(same(placed, numbered, ["grp", "label"]))
    ends = lower_ends(placed, differences)
    # the rows of equal prediction, before a row: as if within a difference below 0
    strictly = running(placed.groupBy("grp", "prediction").agg(F.count("*").alias("_c")), ["grp"], ["prediction"], {"pb": "_c"}).select("grp", "prediction", "pb")
    ends = checkpointed(same(ends, strictly, ["grp", "prediction"]))
    own = running(placed.withColumn("_v", F.col("prediction")), ["grp"], ["at"], {"_upto": "_v"}).select("grp", "at", "_upto")
    plain = same(ends, own, ["grp", "at"]).groupBy("k").agg(
        F.sum(F.col("at") - F.col("low")).alias("n"),
        F.sum((F.col("at") - F.col("low")) * F.col("prediction") - (F.col("_upto") - F.col("sum"))).alias("margin"),
        F.sum(F.col("at") - F.col("pb")).alias("tied"),
    )
    counts = {r["k"]: r for r in plain.collect()}
    right = {r["k"]: r for r in _dominated(placed, ends).collect()}
    equal = {r["k"]: r for r in _equal_labels(placed, ends).collect()}
    return {t: (counts[k]["n"], float(counts[k]["margin"]), float(right[k]["n"] or 0) + 0.5 * ((equal[k]["n"] or 0) + counts[k]["tied"])) for k, t in enumerate(differences)}


def _queries(ends: DataFrame) -> DataFrame:
    """The two places of each row and difference between which its window of smaller predictions lies: sign 1 and -1."""
    sides = F.array(F.struct(F.col("pb").alias("x"), F.lit(1).alias("sign")), F.struct(F.least("low", "pb").alias("x"), F.lit(-1).alias("sign")))
    return ends.select("grp", "lb", "k", "at", F.explode(sides).alias("s")).select("grp", "lb", "k", "at", "s.x", "s.sign")


def _dominated(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """(k, n): pairs within a difference in which the row of smaller prediction has the smaller label."""
    top = placed.groupBy("grp").agg(F.max("lb").alias("_top"))
    asked = _queries(ends).withColumn("_point", F.lit(0))
    points = placed.select("grp", "lb", F.lit(-1).alias("k"), "at", F.col("at").alias("x"), F.lit(0).alias("sign"), F.lit(1).alias("_point"))
    every = same(asked.unionByName(points), top, ["grp"]).withColumn("digit", F.explode(_digits(F.col("_top"))))
    bit, head = _bit(F.col("lb"), F.col("digit"))
    every = every.withColumn("head", head).withColumn("_zero", ((bit == 0) & (F.col("_point") == 1)).cast("long"))
    every = every.where((F.col("_zero") == 1) | ((bit == 1) & (F.col("_point") == 0)))
    found = running(every.select("grp", "digit", "head", "x", "_point", "at", "k", "sign", "_zero"), ["grp", "digit", "head"], ["x", "_point", "at", "k", "sign"], {"below": "_zero"})
    return _each_k(found, ends)


def _equal_labels(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """(k, n): pairs within a difference of equal labels and different predictions."""
    asked = _queries(ends).withColumn("_point", F.lit(0))
    points = placed.select("grp", "lb", F.lit(-1).alias("k"), "at", F.col("at").alias("x"), F.lit(0).alias("sign"), F.lit(1).alias("_point"))
    found = running(asked.unionByName(points), ["grp", "lb"], ["x", "_point", "at", "k", "sign"], {"below": "_point"})
    return _each_k(found, ends)


def _each_k(found: DataFrame, ends: DataFrame) -> DataFrame:
    sums = found.where("k >= 0").groupBy("k").agg(F.sum(F.col("sign") * F.col("below")).alias("n"))
    return ends.select("k").distinct().join(sums.hint("merge"), "k", "left")
