"""Linear scoring over long features, group centring, ranking, and fits.

Features are rows (item, grp, name, value); a missing row is a zero. Fits aggregate the Gram matrix in Spark;
only the p x p system, bounded by the number of selected names, is solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.scalars import finite
from cohortal.operators import gram as tiles
from cohortal.operators.cohort import fold_of
from cohortal.operators.loops import checkpointed, with_small
from cohortal.operators.metrics import composite, rank_metrics, summarize_groups
from cohortal.operators.ordering import quantiles, running, same, with_mean

MOST_TERMS = 4000  # of a system that is solved on the driver
ZERO = 1e-12


def score_linear(items: DataFrame, features: DataFrame, weights: DataFrame, intercept: float = 0.0) -> DataFrame:
    """items with `prediction`: the sum of weight times value; items without a known feature score the intercept."""
    found = with_small(features.select("item", "name", "value"), weights.select("name", "weight"), "name").groupBy("item").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return items.join(found.hint("merge"), "item", "left").withColumn("prediction", F.coalesce("s", F.lit(0.0)) + F.lit(intercept)).drop("s")


def contributions(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, name, value): signed contributions, without those that are practically zero."""
    each = with_small(features.select("item", "name", "value"), weights.select("name", "weight"), "name").select("item", "name", (F.col("weight") * F.col("value")).alias("value"))
    return each.where(F.abs("value") > ZERO)


def top_contributions(parts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.abs("value").desc(), "name")
    return parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def rank_group(scored: DataFrame) -> DataFrame:
    """scored(grp, item, prediction) with rank (ties in the order of the items) and the distance to the best."""
    placed = running(scored.withColumn("_one", F.lit(1)), ["grp"], ["prediction", "item"], {"_before": "_one"})
    best = scored.groupBy("grp").agg(F.min("prediction").alias("_best"))
    found = same(placed, best, ["grp"])
    return found.select(*scored.columns, (F.col("_before") + 1).cast("int").alias("rank"), (F.col("prediction") - F.col("_best")).alias("delta"))


def center_labels(items: DataFrame) -> DataFrame:
    return with_mean(items, ["grp"], "label", "_mean").withColumn("centered", F.col("label") - F.col("_mean")).drop("_mean")


def group_means(items: DataFrame, features: DataFrame) -> DataFrame:
    """(grp, name, mean) of the features that a group has, over all its items; an absent value is 0."""
    size = items.groupBy("grp").agg(F.count("*").alias("size"))
    sums = features.groupBy("grp", "name").agg(F.sum("value").alias("s"))
    return sums.join(size.hint("merge"), "grp").select("grp", "name", (F.col("s") / F.col("size")).alias("mean"))


def center_features(items: DataFrame, features: DataFrame) -> DataFrame:
    """(item, grp, name, value) less the group's mean over all its items; items whose value was 0 get their row too.

    A name that no item of a group has stays absent there: its mean is 0. The result is as long as items times the
    names of their group; fits, scores and distances below use group sums instead and stay as sparse as the features.
    """
    grid = items.select("item", "grp").join(group_means(items, features).hint("merge"), "grp")
    return grid.join(features.select("item", "name", "value").hint("merge"), ["item", "name"], "left").select("item", "grp", "name", (F.coalesce("value", F.lit(0.0)) - F.col("mean")).alias("value"))


def feature_moments(items: DataFrame, features: DataFrame) -> DataFrame:
    """(name, mean, scale, support) over all items, zeros included; a scale of 0 becomes 1."""
    n = items.agg(F.count("*").alias("n"))
    per = features.groupBy("name").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.countDistinct("item").alias("support")).crossJoin(F.broadcast(n))
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    std = F.sqrt(F.greatest(F.lit(0.0), variance))
    return per.select("name", (F.col("s") / F.col("n")).alias("mean"), F.when(std > ZERO, std).otherwise(1.0).alias("scale"), "support")


def support_counts(features: DataFrame) -> DataFrame:
    return features.where("value <> 0").groupBy("name").agg(F.countDistinct("item").alias("items"))


def gram(features: DataFrame) -> DataFrame:
    """(a, b, s), a <= b: sums of products over items."""
    right = features.select("item", F.col("name").alias("b"), F.col("value").alias("w"))
    return features.select("item", F.col("name").alias("a"), "value").join(right.hint("merge"), "item").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("value") * F.col("w")).alias("s"))


def moments_with(features: DataFrame, items: DataFrame, label: str) -> DataFrame:
    """(name, s): sums of value times label."""
    return features.join(items.select("item", F.col(label).alias("_y")).hint("merge"), "item").groupBy("name").agg(F.sum(F.col("value") * F.col("_y")).alias("s"))


def term_names(features: DataFrame) -> list[str]:
    """The names in order; over MOST_TERMS are an error."""
    names = sorted(r["name"] for r in features.select("name").distinct().limit(MOST_TERMS + 1).collect())
    if len(names) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms; select before")
    return names


def numbered(features: DataFrame, names: list[str]) -> DataFrame:
    """(item, k, value) of the features, each by the place of its name."""
    at = F.broadcast(features.sparkSession.createDataFrame(list(enumerate(names)), "k int, name string"))
    return features.select("item", "name", "value").join(at, "name").select("item", "k", F.col("value").cast("double").alias("value"))


def dot(weights: Column) -> Column:
    """The sum of the products of a row's values with the weights at their places, in the order of the places."""
    return F.coalesce(F.aggregate(F.zip_with("places", "values", lambda p, x: x * F.get(weights, p)), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def _rooted(sums: DataFrame, p: int) -> DataFrame:
    """(fold, places, values) of sums(grp, fold, k, value) over the root of the group's size, which stands at place p + 1; what is taken
    off the products of a fold stands under twice its number and one."""
    size = F.get("values", (F.array_position("places", p + 1) - 1).cast("int"))
    rows = tiles.item_rows(sums, "grp", "fold").withColumn("_root", F.sqrt(size))
    return rows.select((F.col("fold") * 2 + 1).cast("long").alias("fold"), "places", F.transform("values", lambda x: x / F.col("_root")).alias("values"))


class System:
    """A Gram matrix and right-hand side on the driver, names in order; square is the sum of squared labels, sums and
    label_sum are those of the raw columns and labels."""

    def __init__(self, names: list[str], matrix: np.ndarray, right: np.ndarray, n: int, square: float = 0.0, sums: np.ndarray | None = None, label_sum: float = 0.0):
        self.names, self.matrix, self.right, self.n, self.square = names, matrix, right, n, square
        self.sums, self.label_sum = np.zeros(len(names)) if sums is None else sums, label_sum

    @classmethod
    def of(cls, features: DataFrame, items: DataFrame, label: str) -> System:
        return cls.by_fold(features, items.withColumn("fold", F.lit(0)), label).get(0) or cls([], np.zeros((0, 0)), np.zeros(0), 0)

    @classmethod
    def in_groups(cls, features: DataFrame, items: DataFrame, label: str) -> System:
        """The system of values and labels less their group's means; see by_fold()."""
        return cls.by_fold(features, items.withColumn("fold", F.lit(0)), label, True).get(0) or cls([], np.zeros((0, 0)), np.zeros(0), 0)

    @classmethod
    def by_fold(cls, features: DataFrame, items: DataFrame, label: str, centred: bool = False) -> dict[int, System]:
        """A system of each fold's rows, from one pass. Names are those of all folds; items(item, grp, fold, label) has an item once
        for each fold that it lies in, and items without a label take no part.

        Every item is one sparse row, with its label and a one as two further places; tasks add up products of rows as
        tiles (see gram.py). centred: values and labels less the means of their group, which lies in one fold: products of
        the raw rows less those of the group's sums over the root of its size. No centred zero is ever
        written out, and no group has to be in one task.
        """
        names = term_names(features)
        p = len(names)
        values = numbered(features, names)
        known = items.where(F.col(label).isNotNull()).select("item", F.col("grp") if centred else F.lit(None).cast("string").alias("grp"), F.col("fold").cast("long").alias("fold"), F.col(label).cast("double").alias("y"))
        held = known.join(tiles.item_rows(values).hint("merge"), "item", "left")
        none = F.array().cast("array<int>"), F.array().cast("array<double>")
        rows = held.select("grp", (F.col("fold") * 2).alias("fold"), F.concat(F.coalesce("places", none[0]), F.array(F.lit(p), F.lit(p + 1))).alias("places"), F.concat(F.coalesce("values", none[1]), F.array(F.col("y"), F.lit(1.0))).alias("values"))
        every = rows
        if centred:
            rows = checkpointed(rows)
            cells = rows.select("grp", "fold", F.explode(F.arrays_zip("places", "values")).alias("c")).groupBy("grp", "fold", F.col("c.places").alias("k")).agg(F.sum("c.values").alias("value"))
            every = rows.drop("grp").unionByName(_rooted(cells.withColumn("fold", F.col("fold") / 2), p))
        return cls._of_products(every, names, centred)

    @classmethod
    def of_cells(cls, cells: DataFrame, names: list[str], centred: bool = True) -> dict[int, System]:
        """The systems of by_fold() from cells(grp, fold, places, values, n, y, rest): n items of a group with the same values, whose
        labels sum up to y, with the sum of squares `rest` about their mean. A cell's products are those of one row times the
        root of n, and of its rest."""
        p, n = len(names), F.col("n").cast("double")
        ends, root = F.array(F.lit(p), F.lit(p + 1)), F.sqrt(n)
        raw = cells.select((F.col("fold") * 2).alias("fold"), F.concat("places", ends).alias("places"), F.concat(F.transform("values", lambda x: x * root), F.array(F.col("y") / root, root)).alias("values"))
        rest = cells.where("rest > 0").select((F.col("fold") * 2).alias("fold"), F.array(F.lit(p)).alias("places"), F.array(F.sqrt("rest")).alias("values"))
        if not centred:
            return cls._of_products(raw.unionByName(rest), names, False)
        whole = F.arrays_zip(F.concat("places", ends).alias("places"), F.concat(F.transform("values", lambda x: x * n), F.array(F.col("y"), n)).alias("values"))
        sums = cells.select("grp", "fold", F.explode(whole).alias("c")).groupBy("grp", "fold", F.col("c.places").alias("k")).agg(F.sum("c.values").alias("value"))
        return cls._of_products(raw.unionByName(rest).unionByName(_rooted(sums, p)), names, True)

    @classmethod
    def _of_products(cls, rows: DataFrame, names: list[str], centred: bool) -> dict[int, System]:
        """Systems from rows(fold, places, values), those of a fold under twice its number, those to take off under one more."""
        p = len(names)
        found = tiles.squares(tiles.added(tiles.tiles(rows, p + 2)), p + 2)
        out = {}
        for fold in sorted(k // 2 for k in found if k % 2 == 0):
            raw = found[2 * fold]
            m = raw - found[2 * fold + 1] if centred else raw
            out[fold] = cls(names, m[:p, :p], m[:p, p], round(raw[p + 1, p + 1]), float(m[p, p]), raw[:p, p + 1], float(raw[p, p + 1]))
        return out

    def centred(self) -> System:
        """The system of columns and labels less their means over all rows."""
        n = max(1, self.n)
        return System(self.names, self.matrix - np.outer(self.sums, self.sums) / n, self.right - self.sums * self.label_sum / n, self.n, self.square - self.label_sum**2 / n, self.sums, self.label_sum)

    def only(self, names: set[str]) -> System:
        """The system of some of the columns."""
        on = [k for k, name in enumerate(self.names) if name in names]
        return System([self.names[k] for k in on], self.matrix[np.ix_(on, on)], self.right[on], self.n, self.square, self.sums[on], self.label_sum)

    def rmse(self, weights: dict[str, float]) -> float:
        """Root of the mean squared residual of the system's own rows."""
        w = np.array([weights.get(name, 0.0) for name in self.names])
        return float(np.sqrt(max(0.0, self.square - 2 * w @ self.right + w @ self.matrix @ w) / max(1, self.n)))

    def plus(self, other: System) -> System:
        return System(self.names, self.matrix + other.matrix, self.right + other.right, self.n + other.n, self.square + other.square, self.sums + other.sums, self.label_sum + other.label_sum)

    def less(self, other: System) -> System:
        """This system without the rows of another one."""
        matrix, right, sums = self.matrix.copy(), self.right.copy(), self.sums.copy()
        at = {n: k for k, n in enumerate(self.names)}
        own = [at[n] for n in other.names if n in at]
        theirs = [k for k, n in enumerate(other.names) if n in at]
        matrix[np.ix_(own, own)] -= other.matrix[np.ix_(theirs, theirs)]
        right[own] -= other.right[theirs]
        sums[own] -= other.sums[theirs]
        return System(self.names, matrix, right, self.n - other.n, self.square - other.square, sums, self.label_sum - other.label_sum)

    def ridge(self, alpha: float) -> dict[str, float]:
        """Weights of the unscaled columns; the penalty is on columns of unit deviation (zero columns get 0)."""
        scale = np.sqrt(np.maximum(np.diag(self.matrix) / max(1, self.n), 0.0))
        on = np.flatnonzero(scale > ZERO)
        if not len(on):
            return dict.fromkeys(self.names, 0.0)
        m = self.matrix[np.ix_(on, on)] / np.outer(scale[on], scale[on])
        w = np.linalg.solve(m + alpha * np.eye(len(on)), self.right[on] / scale[on]) if alpha else np.linalg.lstsq(m, self.right[on] / scale[on], rcond=None)[0]
        out = dict.fromkeys(self.names, 0.0)
        out |= {self.names[k]: float(x / scale[k]) for k, x in zip(on, w, strict=True)}
        return out

    def lasso(self, alpha: float, rounds: int = 2000, tolerance: float = 1e-10) -> dict[str, float]:
        """Coordinate descent on half the mean square plus alpha times the absolute weights, on columns of unit deviation."""
        scale = np.sqrt(np.maximum(np.diag(self.matrix) / max(1, self.n), 0.0))
        on = np.flatnonzero(scale > ZERO)
        m = self.matrix[np.ix_(on, on)] / np.outer(scale[on], scale[on]) / self.n
        r = self.right[on] / scale[on] / self.n
        w = np.zeros(len(on))
        for _ in range(rounds):
            old = w.copy()
            for k in range(len(on)):
                rest = r[k] - m[k] @ w + m[k, k] * w[k]
                w[k] = np.sign(rest) * max(0.0, abs(rest) - alpha) / m[k, k]
            if np.abs(w - old).max(initial=0.0) < tolerance:
                break
        return {self.names[k]: float(x / scale[k]) for k, x in zip(on, w, strict=True) if abs(x) > 1e-10}


def largest_weights(weights: DataFrame, n: int) -> DataFrame:
    """The n weights of largest absolute value, ties by name."""
    return weights.orderBy(F.abs("weight").desc(), "name").limit(n)


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(weights.items()), "name string, weight double")


def in_several(items: DataFrame) -> DataFrame:
    """The items of groups of two or more; a group of one has no centred label or value."""
    many = items.groupBy("grp").agg(F.count("*").alias("n")).where("n >= 2").select("grp")
    return with_small(items, many, "grp", "left_semi")


def fit_group_ridge(items: DataFrame, features: DataFrame, alpha: float) -> dict[str, float]:
    """Ridge on labels and features centred in their groups of two items or more; group offsets play no part."""
    return System.in_groups(features, in_several(items), "label").ridge(alpha)


def score_centred(items: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """items with the prediction from centred features: the score less its mean over the group, which is the same."""
    scored = score_linear(items, features, weights)
    return with_mean(scored, ["grp"], "prediction", "_mean").withColumn("prediction", F.col("prediction") - F.col("_mean")).drop("_mean")


def predict_group_ridge(items: DataFrame, features: DataFrame, weights: DataFrame, scales: DataFrame) -> DataFrame:
    """items with the centred prediction and the distance: root of the mean square of scaled centred features."""
    scored = score_centred(items, features, weights)
    far = sparse_group_distance(items, features, scales)
    return scored.join(far.hint("merge"), "item", "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def group_distance(centered: DataFrame, scales: DataFrame) -> DataFrame:
    """(item, distance) over all terms of scales(name, scale); absent values count as 0."""
    n = scales.agg(F.count("*").alias("terms"))
    z = with_small(centered, scales.select("name", "scale"), "name")
    per = z.groupBy("item").agg(F.sum(F.pow(F.col("value") / F.col("scale"), F.lit(2.0))).alias("s"))
    return per.crossJoin(F.broadcast(n)).select("item", F.sqrt(F.col("s") / F.col("terms")).alias("distance"))


def sparse_group_distance(items: DataFrame, features: DataFrame, scales: DataFrame) -> DataFrame:
    """group_distance() of the centred features, from the raw ones: the group's own square, and what an item's values change."""
    n = scales.agg(F.count("*").alias("terms"))
    means = with_small(group_means(items, features), scales.select("name", "scale"), "name")
    base = means.groupBy("grp").agg(F.sum(F.pow(F.col("mean") / F.col("scale"), F.lit(2.0))).alias("base"))
    near = features.select("item", "grp", "name", "value").join(means.hint("merge"), ["grp", "name"])
    square = (F.pow(F.col("value") - F.col("mean"), F.lit(2.0)) - F.pow("mean", F.lit(2.0))) / F.pow("scale", F.lit(2.0))
    gain = near.groupBy("item").agg(F.sum(square).alias("gain"))
    j = items.select("item", "grp").join(base.hint("merge"), "grp", "left").join(gain.hint("merge"), "item", "left").crossJoin(F.broadcast(n))
    total = F.coalesce("base", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    return j.select("item", F.sqrt(F.greatest(F.lit(0.0), total) / F.col("terms")).alias("distance"))


def mean_distance(items: DataFrame, features: DataFrame, moments: DataFrame) -> DataFrame:
    """(item, distance) from the training means: root of the mean of z^2 over all terms, zeros included."""
    base = moments.agg(F.sum(F.pow(F.col("mean") / F.col("scale"), F.lit(2.0))).alias("base"), F.count("*").alias("terms"))
    z = with_small(features, moments.select("name", "mean", "scale"), "name")
    gain = F.pow((F.col("value") - F.col("mean")) / F.col("scale"), F.lit(2.0)) - F.pow(F.col("mean") / F.col("scale"), F.lit(2.0))
    per = z.groupBy("item").agg(F.sum(gain).alias("s"))
    return items.select("item").join(per.hint("merge"), "item", "left").crossJoin(F.broadcast(base)).select("item", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0)) + F.col("base")) / F.col("terms")).alias("distance"))


def distance_q99(distances: DataFrame) -> DataFrame:
    return quantiles(distances, "distance", {"q99": 0.99})


def predict(items: DataFrame, counts: DataFrame, features: DataFrame, card: dict, count_weights: DataFrame, term_weights: DataFrame, moments: DataFrame, ranges: DataFrame) -> DataFrame:
    """items with composition, connectivity, prediction, distance and warnings. counts(item, element, n)."""
    composition = with_small(counts, count_weights, "element").groupBy("item").agg(F.sum(F.col("weight") * F.col("n")).alias("composition"))
    out = with_small(counts, ranges, "element").groupBy("item").agg(F.bool_or((F.col("n") < F.col("lo")) | (F.col("n") > F.col("hi"))).alias("outside"))
    terms = score_linear(items, features, term_weights).select("item", F.col("prediction").alias("connectivity"))
    j = items.join(composition.hint("merge"), "item", "left").join(terms.hint("merge"), "item").join(mean_distance(items, features, moments).hint("merge"), "item").join(out.hint("merge"), "item", "left")
    j = j.withColumn("composition", F.coalesce("composition", F.lit(0.0)) + F.lit(card["intercept"]))
    codes = F.array_compact(F.array(F.when(F.col("distance") > card["q99"], F.lit("DISTANCE_OUTSIDE_Q99")), F.when(F.coalesce("outside", F.lit(False)), F.lit("COMPOSITION_OUTSIDE_RANGE"))))
    return j.withColumn("prediction", F.col("composition") + F.col("connectivity")).withColumn("warnings", codes).drop("outside")


def composition_ranges(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(element, lo, hi) over all items; an item without the element counts 0."""
    n = items.agg(F.count("*").alias("total"))
    per = counts.groupBy("element").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("have"))
    return per.crossJoin(F.broadcast(n)).select("element", F.when(F.col("have") < F.col("total"), F.least("lo", F.lit(0))).otherwise(F.col("lo")).alias("lo"), "hi")


def widen_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("element").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def fit_composition(items: DataFrame, counts: DataFrame) -> dict[str, float]:
    """Least squares of the label on element counts with an intercept (named '1'); singular systems get the least norm."""
    ones = items.select("item", F.lit("1").alias("name"), F.lit(1.0).alias("value"))
    long = ones.unionByName(counts.select("item", F.col("element").alias("name"), F.col("n").cast("double").alias("value")))
    s = System.of(long, items, "label")
    w = np.linalg.lstsq(s.matrix, s.right, rcond=None)[0]
    return dict(zip(s.names, map(float, w), strict=True))


def fit_ridge(items: DataFrame, features: DataFrame, alpha: float) -> tuple[float, dict[str, float], float]:
    """(intercept, weights, residual RMSE): standardised ridge, the intercept without a penalty. One pass over the rows."""
    raw = System.of(features, items, "label")
    system = raw.centred()
    weights = system.ridge(alpha)
    mean = dict(zip(raw.names, raw.sums / max(1, raw.n), strict=True))
    return float(raw.label_sum / max(1, raw.n) - sum(w * mean[k] for k, w in weights.items())), weights, system.rmse(weights)


def refine(items: DataFrame, design: DataFrame, residual: str, alpha: float, scales: DataFrame | None = None) -> dict[str, float]:
    """Anchored corrections: least |r - Z d|^2 + alpha |d|^2 over columns over their scale; alpha 0 gives the least norm.

    design(item, name, value); scales(name, scale) has 1 for the intercept, the larger of 1 and the deviation for counts, and
    stored scales for terms; a name without one has 1. Corrections are those of the unscaled columns, and the base is not changed.
    """
    if items.count() < 2 or items.select("item").distinct().count() != items.count():
        raise ValueError("refinement needs two items at least, each once")
    if items.where(~finite(F.col(residual))).limit(1).count():
        raise ValueError("residuals must be finite")
    if scales is not None:
        design = with_small(design, scales, "name", "left").select("item", "name", (F.col("value") / F.coalesce("scale", F.lit(1.0))).alias("value"))
    s = System.of(design, items, residual)
    if alpha:
        w = np.linalg.solve(s.matrix + alpha * np.eye(len(s.names)), s.right)
    else:
        w = np.linalg.lstsq(s.matrix, s.right, rcond=None)[0]
    own = {r["name"]: r["scale"] for r in scales.where(F.col("name").isin(s.names)).collect()} if scales is not None else {}  # as many as terms
    return {n: float(x) / own.get(n, 1.0) for n, x in zip(s.names, w, strict=True)}


def count_scales(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, scale) of count columns over all items: their deviation, 1 at least."""
    moments = feature_moments(items, counts.select("item", F.col("element").alias("name"), F.col("n").cast("double").alias("value")))
    return moments.select("name", F.greatest(F.col("scale"), F.lit(1.0)).alias("scale"))


def tune_ridge(items: DataFrame, features: DataFrame, alphas: list[float], folds: int = 3, outer: int | None = None, preferred: float = 0.0) -> DataFrame:
    """(alpha, pearson, spearman, composite): pooled out-of-fold group metrics.

    One system a fold: all rows less the fold's; every alpha is solved from it on the driver.
    """
    spark = items.sparkSession
    features = checkpointed(features.withColumn("fold", fold_of(F.col("grp"), folds, outer)))
    rows = checkpointed(items.withColumn("fold", fold_of(F.col("grp"), folds, outer)))
    parts = System.by_fold(features, rows, "label", True)
    whole = total(parts)
    listed = [(alpha, fold, name, w) for fold, part in parts.items() for alpha in alphas for name, w in whole.less(part).ridge(alpha).items()]
    weights = F.broadcast(spark.createDataFrame(listed, "alpha double, fold int, name string, weight double"))  # terms x folds x alphas
    scored = features.join(weights, ["fold", "name"]).groupBy("alpha", "item").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    # the group's mean, which centring takes off, changes no rank and no correlation in the group; absent items score 0
    every = rows.select("item", "grp", "label").crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in alphas], "alpha double")))
    pooled = every.join(scored.hint("merge"), ["alpha", "item"], "left").select("alpha", "item", "label", F.coalesce("s", F.lit(0.0)).alias("prediction"), F.concat_ws("@", F.col("alpha").cast("string"), "grp").alias("grp"))
    metrics = rank_metrics(pooled).withColumn("alpha", F.element_at(F.split("grp", "@"), 1).cast("double"))
    return composite(summarize_groups(metrics, "alpha")).select("alpha", "pearson", "spearman", "composite")


def total(parts: dict[int, System]) -> System:
    out = None
    for part in parts.values():
        out = part if out is None else out.plus(part)
    return out


def best_alpha(tuned: DataFrame, preferred: float = 0.0) -> DataFrame:
    """The alpha of highest composite; a tie goes to the one whose logarithm is nearest to the preferred one."""
    near = -F.abs(F.log10("alpha") - F.lit(preferred))
    return tuned.agg(F.max_by(F.struct("alpha", "composite"), F.struct("composite", near, "alpha")).alias("b")).select("b.alpha", "b.composite")


def ensemble_predict(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, prediction, distance) of members(member, item, prediction, distance): weighted sums, the largest distance."""
    w = weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("total")))).select("member", (F.col("weight") / F.col("total")).alias("w"))
    return with_small(members, w, "member").groupBy("item").agg(F.sum(F.col("w") * F.col("prediction")).alias("prediction"), F.max("distance").alias("distance"))
