"""Nested cross-validation of three models from one cube of Gram matrices.

Every group lies in one outer fold and, for each other outer fold, in one inner fold of that fold's pool. Labels are ranked once, and
items of a group with the same values become one row of sums. One pass deals these to their copies and adds up a system for
each (outer, inner) cell; pools are sums of cells, and the training system of an inner split is its pool less the cell. One pass scores all
inner splits with all candidates, and one the outer folds with what they chose. So the number of passes over the rows does not
hang on the number of folds or penalties.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators import metrics, resampling
from cohortal.operators.cohort import fold_of
from cohortal.operators.gram import item_rows
from cohortal.operators.linear import System, dot, in_several, numbered, term_names, total
from cohortal.operators.loops import checkpointed, with_small
from cohortal.operators.ordering import average_ranks

MODELS = ("baseline", "fixed", "expanded")
#: Where ties between penalties go, and the least gains of the gates.
PREFERRED_LASSO, PREFERRED_RIDGE = 0.003, 100.0
LEAST_SPEARMAN_GAIN, LEAST_PEARSON_GAIN = 0.005, -0.002


def inner_copies(rows: DataFrame, outer: int, inner: int) -> DataFrame:
    """rows once for each outer fold but their group's own, with fold: that outer fold's number times `inner`, plus the inner fold there."""
    own = fold_of(F.col("grp"), outer)
    cells = F.array_compact(F.array(*(F.when(F.col("_own") != o, (F.lit(o * inner) + fold_of(F.col("grp"), inner, o)).cast("long")) for o in range(outer))))
    return rows.withColumn("_own", own).withColumn("fold", F.explode(cells)).drop("_own")


def scored_by(rows: DataFrame, names: list[str], weights: dict[int, list[dict[str, float]]], many: int) -> DataFrame:
    """rows(fold, places, values, ...) with scores, an array of `many` numbers: those of the fold's weights, added in the order of the places."""
    listed = [(fold, [[w.get(n, 0.0) for n in names] for w in each]) for fold, each in weights.items()]
    at = F.broadcast(rows.sparkSession.createDataFrame(listed, "fold long, _w array<array<double>>"))  # terms times folds
    return rows.join(at, "fold", "left").withColumn("scores", F.array(*(dot(F.get("_w", F.lit(k))) for k in range(many)))).drop("_w")


class Study:
    """predictions(model, item, grp, label, prediction, fold) out of fold, and the choices of each outer fold."""

    def __init__(self, predictions: DataFrame, choices: list[dict]):
        self.predictions, self.choices = predictions, choices

    def choice_frame(self) -> DataFrame:
        return self.predictions.sparkSession.createDataFrame([(c["outer"], c["fixed_alpha"], c["lasso"], c["ridge"], len(c["terms"]), c["sha256"], c["composite"]) for c in self.choices], "outer int, fixed_alpha double, lasso double, ridge double, terms int, sha256 string, composite double")


def nested_study(items: DataFrame, features: DataFrame, frozen: dict[str, float], lassos: list[float], ridges: list[float], outer: int = 5, inner: int = 3, mode: str = "drop_undefined") -> Study:
    """Three models out of fold. baseline: the frozen weights as they are. fixed: the frozen terms refitted, the penalty
    tuned inside each outer pool. expanded: for each lasso and ridge penalty the terms that each inner split selects, scored
    on its held-out part; the best pair's terms common to all splits are refitted on the pool. Without such a term the expanded
    model has none, and its choice no penalties.

    Candidates are compared by the mean of Pearson and Spearman over groups; ties go to the penalties nearest to the preferred
    ones. items(item, grp, label); groups of one item and items without a label take no part.
    """
    base = checkpointed(in_several(items.where("label is not null")).select("item", "grp", "label"))
    names = term_names(features)
    rows = item_rows(numbered(features.where("value is not null"), names))
    size = base.groupBy("grp").agg(F.count("*").alias("_n"), F.avg("label").alias("_mean"))
    ranked = with_small(average_ranks(base, ["grp"], "label", "_rank"), size, "grp")
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    held = ranked.join(rows.hint("merge"), "item", "left").select("item", "grp", "label", (F.col("label") - F.col("_mean")).alias("c"), (F.col("_rank") - (F.col("_n") + 1) / 2).alias("r"), F.coalesce("places", none[0]).alias("places"), F.coalesce("values", none[1]).alias("values"))
    held = checkpointed(held)
    # items of a group with the same values are one cell: whatever the weights, they have the same prediction
    square = lambda x: F.sum(F.col(x) * F.col(x))
    same_values = checkpointed(held.groupBy("grp", "places", "values").agg(F.count("*").alias("n"), F.sum("label").alias("y"), (F.var_pop("label") * F.count("*")).alias("rest"), F.sum("c").alias("c"), square("c").alias("q"), F.sum("r").alias("r"), square("r").alias("s")))
    copies = checkpointed(inner_copies(same_values, outer, inner))
    cells = System.of_cells(copies, names)
    pools = {o: total({i: cells[o * inner + i] for i in range(inner) if o * inner + i in cells}) for o in range(outer)}
    pools = {o: p for o, p in pools.items() if p is not None}
    terms = set(frozen)
    candidates = [("fixed", 0.0, r) for r in ridges] + [("expanded", x, r) for x in lassos for r in ridges]
    supports: dict[tuple[int, float], list[set[str]]] = {}
    weights: dict[int, list[dict[str, float]]] = {}
    for cell, part in cells.items():
        train = pools[cell // inner].less(part)
        known = train.only(terms)
        own = [known.ridge(r) for r in ridges]
        for x in lassos:
            selected = set(train.lasso(x))
            supports.setdefault((cell // inner, x), []).append(selected)
            kept = train.only(selected)
            own += [kept.ridge(r) for r in ridges]
        weights[cell] = own
    each = scored_by(copies, names, weights, len(candidates)).select(F.floor(F.col("fold") / inner).cast("int").alias("_outer"), "grp", F.posexplode("scores").alias("_k", "prediction"), "n", "c", "q", "r", "s")
    per = metrics.cell_correlations(each, ["_outer", "_k", "grp"])
    if mode == "drop_undefined":
        per = per.where("pearson is not null and spearman is not null")
    summary = metrics.composite(per.groupBy("_outer", "_k").agg(F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman")))
    found = {(r["_outer"], r["_k"]): r["composite"] for r in summary.select("_outer", "_k", "composite").collect()}  # a row an outer fold and candidate

    choices, chosen = [], {}
    for o, pool in sorted(pools.items()):
        near = lambda x, preferred: -abs(math.log10(x) - math.log10(preferred)) if x else 0.0
        rank = lambda k: (found.get((o, k)) if found.get((o, k)) is not None else -math.inf, near(candidates[k][1], PREFERRED_LASSO), near(candidates[k][2], PREFERRED_RIDGE))  # noqa: B023, E731
        fixed = max((k for k, c in enumerate(candidates) if c[0] == "fixed"), key=rank)
        stable = {x: set.intersection(*supports[o, x]) for x in lassos}
        able = [k for k, c in enumerate(candidates) if c[0] == "expanded" and stable[c[1]]]
        best = max(able, key=rank) if able else None
        kept = stable[candidates[best][1]] if best is not None else set()
        expanded = pool.only(kept).ridge(candidates[best][2]) if best is not None else {}
        chosen[o] = [dict(frozen), pool.only(terms).ridge(candidates[fixed][2]), expanded]
        choices.append({"outer": o, "fixed_alpha": candidates[fixed][2], "lasso": candidates[best][1] if best is not None else None, "ridge": candidates[best][2] if best is not None else None, "terms": sorted(kept), "sha256": hashlib.sha256("\n".join(sorted(kept)).encode()).hexdigest(), "composite": found.get((o, best if best is not None else fixed))})
    in_fold = lambda df: scored_by(df.withColumn("fold", fold_of(F.col("grp"), outer).cast("long")), names, chosen, len(MODELS))
    means = in_fold(same_values).groupBy("grp").agg(F.array(*(F.sum(F.col("n") * F.get("scores", F.lit(k))) / F.sum("n") for k in range(len(MODELS)))).alias("_means"))
    out = with_small(in_fold(held.select("item", "grp", "label", "places", "values")), checkpointed(means), "grp")
    models = MODELS if lassos else MODELS[:2]
    rows = F.array(*(F.struct(F.lit(m).alias("model"), (F.get("scores", F.lit(k)) - F.get("_means", F.lit(k))).alias("prediction")) for k, m in enumerate(models)))
    out = out.select("item", "grp", "label", F.col("fold").cast("int").alias("fold"), F.explode(rows).alias("p"))
    return Study(out.select("p.model", "item", "grp", "label", "p.prediction", "fold"), choices)


def model_metrics(predictions: DataFrame, *models: str) -> DataFrame:
    """(model, grp, size, pearson, spearman, concordance, top1): the metrics of each model's groups, from one pass."""
    key = F.concat_ws("@", "model", F.col("grp").cast("string"))
    chosen = predictions.where(F.col("model").isin(*models)).select("item", "label", "prediction", key.alias("grp"))
    per = metrics.rank_metrics(chosen, "drop_undefined")
    cut = F.split("grp", "@", 2)
    return per.withColumn("model", F.get(cut, F.lit(0))).withColumn("grp", F.get(cut, F.lit(1)))


def model_deltas(predictions: DataFrame, left: str, right: str, replicates: int = 200, seed: int = 7, per: DataFrame | None = None) -> DataFrame:
    """One row: for each metric the mean paired difference left less right over groups with both, and for the correlations its bootstrap
    interval. per: the model_metrics(), where several differences need them."""
    names = ("pearson", "spearman", "concordance", "top1")
    per = model_metrics(predictions, left, right) if per is None else per
    own = lambda m: per.where(F.col("model") == m)
    delta = checkpointed(metrics.paired_delta(own(left), own(right), *names))
    out = delta.agg(F.count("*").alias("groups"), *(F.avg(n).alias(f"{n}_delta") for n in names))
    for n in names[:2]:
        ends = resampling.bootstrap_ci(delta, n, replicates, seed).select(F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high"))
        out = out.crossJoin(F.broadcast(ends))
    return out


def choice_gates() -> dict[str, Column]:
    """Whether the expanded model is to be taken instead of the fixed one; conditions on model_deltas()."""
    c = F.col
    return {
        "spearman_gain": c("spearman_delta") >= LEAST_SPEARMAN_GAIN,
        "pearson_gain": c("pearson_delta") >= LEAST_PEARSON_GAIN,
        "no_interval_entirely_negative": (c("pearson_high") >= 0) & (c("spearman_high") >= 0),
        "concordance_or_top1_nondecreasing": (c("concordance_delta") >= 0) | (c("top1_delta") >= 0),
    }


def advancement_gates() -> dict[str, Column]:
    """Whether the chosen model goes beyond the baseline; conditions on model_deltas()."""
    c = F.col
    return {
        "nonnegative_pearson": c("pearson_delta") >= 0,
        "nonnegative_spearman": c("spearman_delta") >= 0,
        "spearman_gain": c("spearman_delta") >= LEAST_SPEARMAN_GAIN,
        "an_interval_above_zero": (c("pearson_low") > 0) | (c("spearman_low") > 0),
        "concordance_or_top1_improves": (c("concordance_delta") > 0) | (c("top1_delta") > 0),
    }
