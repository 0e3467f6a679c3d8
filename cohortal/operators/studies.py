"""Whole experiments as compositions: support tuning, final fits, baselines, ablations, comparators, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.functions.scalars import feature_family
from cohortal.operators import cohort, linear, metrics, prep
from cohortal.operators.gram import item_rows
from cohortal.operators.loops import checkpointed, with_small
from cohortal.operators.ordering import average_ranks

#: The penalty of the joint ridge, and the squares of the ladder.
JOINT_ALPHA = 100.0
SIZES = ("#atoms", "#heavy")
CONSTANT = 1e-12  # share of a column's sum of squares, up to which what is about its mean is rounding


def fold_supports(items: DataFrame, features: DataFrame, alpha: float, folds: int = 3) -> dict[int, set[str]]:
    """The lasso support of each fold's training rows, from one system less the fold's."""
    parts = linear.System.by_fold(features, items.withColumn("fold", cohort.fold_of(F.col("grp"), folds)), "label", True)
    whole = linear.total(parts)
    return {k: set(whole.less(part).lasso(alpha)) for k, part in parts.items()}


def tune_support(items: DataFrame, features: DataFrame, lassos: list[float], ridges: list[float], folds: int = 3) -> DataFrame:
    """(lasso, alpha, terms, composite): the terms that every fold selects, and the pooled score of ridges on them; without a term
    all predictions of a group are equal, and the score is what that gives."""
    if not lassos:
        raise ValueError("no penalty is given")
    out = None
    for value in lassos:
        names = set.intersection(*fold_supports(items, features, value, folds).values())
        tuned = linear.tune_ridge(items, of_names(features, names), ridges, folds)
        now = tuned.select(F.lit(float(value)).alias("lasso"), "alpha", F.lit(len(names)).alias("terms"), "composite")
        out = now if out is None else out.unionByName(now)
    return out


def of_names(features: DataFrame, names: set[str]) -> DataFrame:
    return features.where(F.col("name").isin(sorted(names)) if names else F.lit(False))


def fit_final(items: DataFrame, features: DataFrame, lasso: float, alpha: float, folds: int = 3) -> tuple[DataFrame, float | None]:
    """(weights, q99): ridge on the stable support; the 99th percentile of the training distances. Where no term is selected by every
    fold, there are no weights, and q99 is None."""
    spark = items.sparkSession
    names = set.intersection(*fold_supports(items, features, lasso, folds).values())
    kept = of_names(features, names)
    if not names:
        return linear.weights_frame(spark, {}).join(linear.feature_moments(items, kept).select("name", "mean", "scale").hint("merge"), "name"), None
    weights = linear.weights_frame(spark, linear.fit_group_ridge(items, kept, alpha))
    moments = linear.feature_moments(items, kept).select("name", "mean", "scale")
    q99 = linear.distance_q99(linear.mean_distance(items, kept, moments)).first()["q99"]
    return weights.join(moments.hint("merge"), "name"), q99


def with_composition(items: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """items with the least-squares composition of `column` added to its prediction."""
    spark = items.sparkSession
    target = items.select("item", F.col(column).alias("label"))
    w = linear.fit_composition(target, counts)
    part = linear.score_linear(items.select("item"), counts.select("item", F.col("element").alias("name"), F.col("n").alias("value")), linear.weights_frame(spark, {k: v for k, v in w.items() if k != "1"}), w["1"])
    return items.join(part.select("item", F.col("prediction").alias("composition")), "item")


def baseline_ladder(items: DataFrame, counts: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, metrics...): mean only, composition, composition and size, connectivity as it is, both, on the rows of the fit themselves.

    held_out_ladder() is the whole ladder, with a joint ridge, a constant beside the frozen weights, and rows that no fit has seen.
    """
    spark = items.sparkSession
    n = F.col("n").cast("double")
    size = counts.groupBy("item").agg(F.sum(n).alias("n")).select("item", F.lit("#size").alias("name"), (n * n).alias("value"))
    known = linear.with_small(features.select("item", "name", "value"), weights, "name").where("value is not null")
    term = known.select("item", F.concat(F.lit("="), "name").alias("name"), "value", "weight")
    long = counts.select("item", F.concat(F.lit("+"), "element").alias("name"), n.alias("value")).unionByName(size).unionByName(term.select("item", "name", "value"))
    names = linear.term_names(long)
    frozen = {f"={r['name']}": r["weight"] for r in weights.where(F.concat(F.lit("="), "name").isin(names)).collect()}  # terms at most
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    ranked = average_ranks(items.select("item", "label"), [], "label", "label_rank")
    held = ranked.join(item_rows(linear.numbered(long, names)).hint("merge"), "item", "left")
    held = checkpointed(held.select("label", "label_rank", F.coalesce("places", none[0]).alias("places"), F.coalesce("values", none[1]).alias("values")))
    # items with the same values are one row: all fits come from one system, whose column of ones are the sums
    cells = held.where("label is not null").groupBy("places", "values").agg(F.count("*").alias("n"), F.sum("label").alias("y"), (F.var_pop("label") * F.count("*")).alias("rest"))
    system = linear.System.of_cells(cells.withColumn("fold", F.lit(0).cast("long")), names, centred=False).get(0)
    if system is None:
        system = linear.System(names, np.zeros((len(names),) * 2), np.zeros(len(names)), 0)
    matrix = np.block([[system.matrix, system.sums[:, None]], [system.sums[None, :], np.array([[system.n]])]])
    right = np.append(system.right, system.label_sum)
    base = np.array([frozen.get(x, 0.0) for x in names] + [0.0])

    def composed(size: bool, target: np.ndarray) -> np.ndarray:
        """Least squares on the elements and a one, of least norm where they are singular."""
        on = [k for k, x in enumerate(names) if x.startswith("+") or (size and x == "#size")] + [len(names)]
        out = np.zeros(len(names) + 1)
        out[on] = np.linalg.lstsq(matrix[np.ix_(on, on)], target[on], rcond=None)[0]
        return out

    mean = np.append(np.zeros(len(names)), system.label_sum / system.n if system.n else np.nan)
    steps = {"mean": mean, "composition": composed(False, right), "composition_size": composed(True, right), "connectivity": base, "full": base + composed(False, right - matrix @ base)}
    table = [([w[:-1].tolist() for w in steps.values()], [float(w[-1]) for w in steps.values()])]
    at = F.broadcast(spark.createDataFrame(table, "_w array<array<double>>, _one array<double>"))
    each = F.array(*(F.struct(F.lit(m).alias("model"), (linear.dot(F.get("_w", F.lit(k))) + F.get("_one", F.lit(k))).alias("prediction")) for k, m in enumerate(steps)))
    rows = held.crossJoin(at).select("label", "label_rank", F.explode(each).alias("p"))
    return metrics.regression_metrics(rows.select("p.model", "label", "label_rank", "p.prediction"), "model")


def held_out_ladder(items: DataFrame, counts: DataFrame, features: DataFrame, weights: DataFrame, alpha: float = JOINT_ALPHA) -> DataFrame:
    """(model, split, metrics...) of models that are fitted on the items of the split `training` alone. mean; composition: least squares on
    counts of elements, hydrogens among them; composition_size: and the squares of all and of heavy atoms; connectivity: the frozen
    weights and a constant; full: the frozen weights and least squares of what they leave on the counts; joint_ridge: one ridge on the
    scaled counts and frozen terms together.

    Atoms, heavy atoms and electrons are sums of counts, and as further columns would change no prediction. items(item, grp, label,
    split): a group lies in one split, and outside training one with an element that training lacks goes. counts(item, element, n).
    """
    spark = items.sparkSession
    known = linear.with_small(features.select("item", "name", "value"), weights.select("name").distinct(), "name").where("value is not null")
    number = counts.select("item", "element", F.concat(F.lit("+"), "element").alias("name"), F.col("n").cast("double").alias("value"))
    names = [*SIZES, *linear.term_names(number), *sorted(f"={r['name']}" for r in weights.select("name").distinct().collect())]  # terms at most
    at = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k int, name string"))
    squared = lambda c: F.struct(F.lit(names.index(c)).alias("k"), (F.col(c) * F.col(c)).alias("value"))
    own = number.join(at, "name").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("_kv"), F.sum("value").alias(SIZES[0]), F.sum(F.when(F.col("element") == "H", 0.0).otherwise(F.col("value"))).alias(SIZES[1]))
    own = own.select("item", F.concat(F.array(*(squared(c) for c in SIZES)), "_kv").alias("own"))
    terms = known.select("item", F.concat(F.lit("="), "name").alias("name"), F.col("value").cast("double").alias("value")).join(at, "name")
    terms = terms.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("terms"))
    held = items.select("item", "grp", "label", "split").join(own.hint("merge"), "item", "left").join(terms.hint("merge"), "item", "left")
    none = F.array().cast("array<struct<k:int,value:double>>")
    held = held.withColumn("_kv", F.concat(F.coalesce("own", none), F.coalesce("terms", none)))  # in the order of the places
    held = checkpointed(held.select("grp", "label", "split", F.col("_kv.k").alias("places"), F.col("_kv.value").alias("values")))
    # items with the same values are one row: all fits come from one system, whose column of ones are the sums
    cells = held.where("split = 'training' and label is not null").groupBy("places", "values").agg(F.count("*").alias("n"), F.sum("label").alias("y"), (F.var_pop("label") * F.count("*")).alias("rest"))
    system = linear.System.of_cells(cells.withColumn("fold", F.lit(0).cast("long")), names, centred=False).get(0)
    if system is None:
        raise ValueError("no labelled item lies in training")
    steps = ladder_weights(system, {f"={r['name']}": r["weight"] for r in weights.collect()}, alpha)
    seen = checkpointed(held.where("split = 'training'").select(F.explode("places").alias("k")).distinct())
    strange = held.where("split <> 'training'").select("grp", F.explode("places").alias("k")).where(F.col("k").isin([k for k, x in enumerate(names) if x.startswith("+")]))
    unseen = checkpointed(strange.distinct().join(F.broadcast(seen), "k", "left_anti").select("grp").distinct())  # few: elements that are known nowhere else
    kept = held.join(unseen.hint("merge"), "grp", "left_anti") if unseen.limit(1).count() else held
    table = [([w[:-1].tolist() for w in steps.values()], [float(w[-1]) for w in steps.values()])]
    weighed = F.broadcast(spark.createDataFrame(table, "_w array<array<double>>, _one array<double>"))
    each = F.array(*(linear.dot(F.get("_w", F.lit(k))) + F.get("_one", F.lit(k)) for k in range(len(steps))))
    scored = checkpointed(average_ranks(kept.crossJoin(weighed).select("split", "label", each.alias("p")), ["split"], "label", "label_rank"))
    rows = scored.select("split", "label", "label_rank", F.posexplode("p").alias("_k", "prediction"))
    model = F.element_at(F.array(*map(F.lit, steps)), F.col("_k") + 1)
    return metrics.regression_metrics(rows.select(model.alias("model"), "split", "label", "label_rank", "prediction"), "model", "split")


def ladder_weights(system: linear.System, frozen: dict[str, float], alpha: float) -> dict[str, np.ndarray]:
    """The weights of each model of the ladder by the system's names, and its constant, from the raw sums of the fitted rows."""
    names, n = system.names, system.n
    matrix = np.block([[system.matrix, system.sums[:, None]], [system.sums[None, :], np.array([[n]])]])
    right = np.append(system.right, system.label_sum)
    base = np.array([frozen.get(x, 0.0) for x in names] + [0.0])
    elements = [k for k, x in enumerate(names) if x.startswith("+")]
    one = np.eye(len(names) + 1)[-1]

    def least_squares(on: list[int], target: np.ndarray) -> np.ndarray:
        """On these columns and a one, of least norm where they are singular; columns of other sizes are brought to one."""
        on, out = [*on, len(names)], np.zeros(len(names) + 1)
        scale = np.sqrt(np.maximum(np.diag(matrix)[on], 0))
        scale[scale == 0] = 1
        out[on] = np.linalg.lstsq(matrix[np.ix_(on, on)] / np.outer(scale, scale), target[on] / scale, rcond=None)[0] / scale
        return out

    centred = system.centred()
    vary = np.diag(centred.matrix) > CONSTANT * np.diag(system.matrix)
    ridge = centred.only({x for k, x in enumerate(names) if vary[k] and x[0] in "+="}).ridge(alpha)
    joint = np.array([ridge.get(x, 0.0) for x in names] + [0.0])
    return {
        "mean": one * system.label_sum / n,
        "composition": least_squares(elements, right),
        "composition_size": least_squares([*(names.index(c) for c in SIZES), *elements], right),
        "connectivity": base + one * (system.label_sum - base[:-1] @ system.sums) / n,
        "full": base + least_squares(elements, right - matrix @ base),
        "joint_ridge": joint + one * (system.label_sum - joint[:-1] @ system.sums) / n,
    }


def ablate_blocks(items: DataFrame, counts: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(block, metrics...): one family of terms left out, the composition fitted again."""
    blocks = [r["family"] for r in weights.select(feature_family(F.col("name")).alias("family")).distinct().orderBy("family").collect()]  # at most as many as feature_family() names
    out = None
    for block in blocks:
        rest = weights.where(feature_family(F.col("name")) != block)
        scored = linear.score_linear(items, features, rest)
        full = with_composition(scored.withColumn("rest", F.col("label") - F.col("prediction")), counts, "rest")
        now = full.select(F.lit(block).alias("block"), "item", "label", (F.col("prediction") + F.col("composition")).alias("prediction"))
        out = now if out is None else out.unionByName(now)
    return metrics.regression_metrics(out, "block")


def fit_bits(items: DataFrame, bits: DataFrame, alphas: list[float]) -> DataFrame:
    """items with the prediction of a tuned group ridge on bits(item, grp, bit), which are features of value 1."""
    spark = items.sparkSession
    features = bits.select("item", "grp", F.concat(F.lit("bit_"), F.col("bit").cast("string")).alias("name"), F.lit(1.0).alias("value")).distinct()
    best = linear.best_alpha(linear.tune_ridge(items, features, alphas)).first()["alpha"]
    return linear.score_linear(items, features, linear.weights_frame(spark, linear.fit_group_ridge(items, features, best)))


def external_scores(items: DataFrame, features: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(item, grp, label, split, prediction) of k items of each external group that shares nothing with training.

    What the firewall leaves and what is sampled are kept, as later steps count them; only features of sampled items are summed.
    """
    split = items.withColumn("split", cohort.split_of(F.col("grp")))
    training, external = split.where("split = 'training'"), split.where("split = 'external'")
    clean = checkpointed(prep.apply_firewall(prep.rankable_groups(external), training, "item", by_group_first=True))
    sampled = prep.rankable_groups(checkpointed(cohort.sample_group(prep.rankable_groups(clean), "evaluation", k).drop("place")))
    own = with_small(features, sampled.select("item").distinct(), "item", "left_semi")
    return checkpointed(linear.score_linear(sampled, own, weights))


def evaluate_external(items: DataFrame, features: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(gate, passed) of an evaluation: split, firewall, sample, score, group metrics, summary, gates."""
    summary = metrics.summarize_groups(metrics.rank_metrics(external_scores(items, features, weights, k)))
    return metrics.gates(summary, {"has_groups": F.col("groups") > 0, "positive_pearson": F.col("pearson") > 0, "beats_chance": F.col("top1") > F.col("chance_top1")})
