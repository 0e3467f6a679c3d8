"""Ranks, regression metrics, ranking metrics inside groups, and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed
from cohortal.operators.ordering import MOST_LOCAL, average_ranks, largest, quantiles, running, same, value_counts

TIE = 1e-12
MOST_OF_A_BLOCK = 2000  # rows of a group that meet as one block


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null where it is undefined."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def avg_rank(value: str, *by: str) -> Column:
    """The one-based rank of a value; equal values share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def profile(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation, minimum, exact quantiles, maximum."""
    cuts = quantiles(df, value, {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, *by)
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return same(out, cuts, list(by), "left").select(*by, "n", "mean", "std", "min", "q05", "q25", "median", "q75", "q95", "max")


def regression_metrics(df: DataFrame, *by: str) -> DataFrame:
    """n, MAE, RMSE, median absolute error, R2, Pearson, Spearman and mean signed error of (label, prediction).

    A column label_rank, where there is one, holds the labels' ranks among the rows of the same keys.
    """
    given = [c for c in ("label_rank",) if c in df.columns]
    rows = df.select(*by, "label", "prediction", *given, (F.col("prediction") - F.col("label")).alias("_e")).withColumn("_a", F.abs("_e"))
    square = F.sum(F.col("_e") * F.col("_e"))
    differ = (F.min("label") < F.max("label")) & (F.min("prediction") < F.max("prediction"))
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("_a").alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (1 - F.try_divide(square, F.var_pop("label") * F.count("*"))).alias("r2"),
        F.when(differ, safe_corr("label", "prediction")).alias("pearson"),  # partial deviations of equal values may add up to more than 0
        F.avg("_e").alias("mean_signed_error"),
        (F.count(F.when(F.col("label").isNull() | F.col("prediction").isNull(), 1)) == 0).alias("_whole"),
    )
    found = checkpointed(found)
    if found.where("not _whole").limit(1).count():  # each column is ranked among the rows that have it
        ranked = average_ranks(average_ranks(rows, list(by), "label", "_rl"), list(by), "prediction", "_rp")
        ranks = ranked.groupBy(*by).agg(safe_corr("_rl", "_rp").alias("spearman"))
    else:
        ranks = _spearman(rows if given else average_ranks(rows, list(by), "label", "label_rank"), list(by))
    found = same(found, ranks, list(by), "left")
    middle = quantiles(rows, "_a", {"median_abs_error": 0.5}, *by)
    return same(found, middle, list(by), "left").select(*by, "n", "mae", "rmse", "median_abs_error", "r2", "pearson", "spearman", "mean_signed_error")


def _spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, spearman) of rows(*keys, label_rank, prediction): rows of one prediction share its rank and are one row of sums."""
    rank = F.col("label_rank")
    cells = rows.groupBy(*keys, "prediction").agg(F.count("*").alias("n"), F.sum(rank).alias("r"), F.sum(rank * rank).alias("q"), F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    own, n = F.col("before") + (F.col("n") + 1) / 2, F.sum("n")
    middle = n * (n + 1) / 2 * ((n + 1) / 2)  # the sum of squares of as many equal ranks
    differ = (F.min("lo") < F.max("hi")) & (F.min("prediction") < F.max("prediction"))
    value = (F.sum(own * F.col("r")) - middle) / F.sqrt((F.sum("q") - middle) * (F.sum(F.col("n") * own * own) - middle))
    return running(checkpointed(cells), keys, ["prediction"], {"before": "n"}).groupBy(*keys).agg(F.when(differ, value).alias("spearman"))


def pairs(df: DataFrame, group: str = "grp", item: str = "item", columns: tuple[str, ...] = ("label", "prediction"), block: int = MOST_OF_A_BLOCK) -> DataFrame:
    """All unordered pairs of a group, item_a < item_b. A group of over `block` rows is dealt into blocks by hash, and pairs of
    blocks meet, so that no task makes the pairs of a whole large group."""
    size = df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = same(df.select(group, item, *columns), size, [group]).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = dealt.select(group, F.col("_own").alias("_a"), others.alias("_b"), F.col(item).alias("item_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = dealt.select(group, others.alias("_a"), F.col("_own").alias("_b"), F.col(item).alias("item_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return same(left, right, [group, "_a", "_b"]).where("item_a < item_b").drop("_a", "_b")


def concordance(df: DataFrame) -> DataFrame:
    """(grp, concordance) of (grp, label, prediction): over all pairs of a group, 1 if both orders agree and 1/2 if labels or
    predictions are equal. Groups of one row have none.

    Pairs are counted, not made. Labels are numbered in their order; two numbers first differ at one binary digit, which
    makes a key of the digits above it; there, pairs of agreeing order are sums of rows with a 0 before each row
    with a 1 in the order of the predictions. So each row counts once a digit, in keys that are split by range.
    """
    cells = df.where("label is not null and prediction is not null").groupBy("grp", "label", "prediction").agg(F.count("*").alias("w"))
    return _agreement(same(same(cells, _places(df, "label", "rl"), ["grp", "label"]), _places(df, "prediction", "rp"), ["grp", "prediction"]))


def _places(df: DataFrame, value: str, name: str) -> DataFrame:
    return value_counts(df, ["grp"], value).select("grp", value, F.col("before").alias(name))


def _agreement(cells: DataFrame) -> DataFrame:
    """(grp, concordance) of cells(grp, rl, rp, w): numbers in the order of labels and predictions, and how often they stand together."""
    cells = checkpointed(cells.groupBy("grp", "rl", "rp").agg(F.sum("w").alias("w")))
    top = cells.groupBy("grp").agg(F.max("rl").alias("_top"), F.sum("w").alias("n"))
    each = cells.groupBy("grp", "rl").agg(F.sum("w").alias("c")).groupBy("grp").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("equal"))
    split = same(cells, top.where("_top > 0").select("grp", "_top"), ["grp"]).select("grp", "rl", "rp", "w", F.explode(_digits(F.col("_top"))).alias("digit"))
    bit, head = _bit(F.col("rl"), F.col("digit"))
    keyed = split.select("grp", "digit", head.alias("head"), "rp", F.when(bit == 0, F.col("w")).otherwise(0).alias("zero"), F.when(bit == 1, F.col("w")).otherwise(0).alias("one"))
    keyed = keyed.groupBy("grp", "digit", "head", "rp").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    placed = running(keyed, ["grp", "digit", "head"], ["rp"], {"before": "zero"})
    score = placed.groupBy("grp").agg(F.sum(F.col("one") * (F.col("before") + 0.5 * F.col("zero"))).alias("agree"))
    found = same(same(top, each, ["grp"]), score, ["grp"], "left").where("n > 1")
    return found.select("grp", ((F.coalesce("agree", F.lit(0.0)) + F.col("equal") / 4) / (F.col("n") * (F.col("n") - 1) / 2)).alias("concordance"))


def _digits(top: Column) -> Column:
    """Numbers of the binary digits of whole numbers up to top."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(top + 1.0)).cast("int"), F.lit(1)) - 1)


def _bit(number: Column, digit: Column) -> tuple[Column, Column]:
    """The digit of a number, and the number of the digits above it."""
    return F.call_function("shiftright", number, digit).bitwiseAND(F.lit(1)), F.call_function("shiftright", number, digit + 1)


def rank_metrics(df: DataFrame, mode: str = "tie_aware", most: int = MOST_LOCAL) -> DataFrame:
    """Per group of (grp, item, label, prediction): size, pearson, spearman, concordance, top1.

    Concordance is over all pairs of a group, 1 if both orders agree and 1/2 if labels or predictions are equal.
    drop_undefined: top1 is whether the first predicted minimum is the first least label, groups
    without a correlation go. tie_aware: top1 is the share of predicted minima (within 1e-12) that are least
    labels (within 1e-12). keep_ties: the same by exact equality. The last two keep every group.

    Labels and predictions are numbered once each; ranks, and the orders that concordance compares, are those numbers, and digits are
    those of the labels or of the predictions, whichever differ less. Where
    no group has over `most` rows, all of it happens where one shuffle has put the group; else rows are dealt by range.
    """
    near = 0.0 if mode == "keep_ties" else TIE
    rows = df.select("grp", "item", "label", "prediction")
    found = _local_metrics(rows, near, mode) if largest(rows, ["grp"]) <= most else _ranged_metrics(rows, near, mode)
    return found.where("pearson is not null and spearman is not null") if mode == "drop_undefined" else found


def cell_correlations(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, size, pearson, spearman) of cells(*keys, prediction, n, c, q, r, s): n rows of one prediction; c and q are the sums of their
    labels less the mean over the keys and of the squares, r and s those of the labels' ranks. Null where a correlation is undefined.
    """
    per = cells.groupBy(*keys, "prediction").agg(*(F.sum(x).alias(x) for x in ("n", "c", "q", "r", "s")))
    placed = running(checkpointed(per), keys, ["prediction"], {"before": "n"})
    p, n = F.col("prediction"), F.col("n")
    whole = placed.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(n * p) / F.sum("n")).alias("_p"), (F.min("prediction") < F.max("prediction")).alias("_differ"), F.sum("q").alias("_q"), F.sum("s").alias("_s"))
    away, rank = p - F.col("_p"), F.col("before") + (n + 1) / 2 - (F.col("_n") + 1) / 2
    found = same(placed, whole, keys).groupBy(*keys, "_n", "_differ", "_q", "_s").agg(F.sum(away * F.col("c")).alias("_pc"), F.sum(n * away * away).alias("_pp"), F.sum(rank * F.col("r")).alias("_rr"), F.sum(n * rank * rank).alias("_rs"))
    of = lambda xy, xx, yy: F.when(F.col("_differ") & (F.col("_s") > 0), F.try_divide(F.col(xy), F.sqrt(F.col(xx)) * F.sqrt(F.col(yy))))
    return found.select(*keys, F.col("_n").alias("size"), of("_pc", "_pp", "_q").alias("pearson"), of("_rr", "_rs", "_s").alias("spearman"))


def _top1(mode: str, each: Column) -> Column:
    """top1 over the rows for which `each` holds."""
    if mode == "drop_undefined":
        first = lambda c: F.min_by(F.when(each, F.col("item")), F.when(each, F.struct(c, "item")))
        return (first("prediction") == first("label")).cast("double")
    return F.sum((each & F.col("_bl") & F.col("_bp")).cast("double")) / F.sum((each & F.col("_bp")).cast("double"))


def _local_metrics(rows: DataFrame, near: float, mode: str) -> DataFrame:
    group = Window.partitionBy("grp")
    whole = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    for c, place, many in (("label", "rl", "cl"), ("prediction", "rp", "cp")):
        rows = rows.withColumn(place, F.rank().over(group.orderBy(c)) - 1).withColumn(many, F.count("*").over(Window.partitionBy("grp", c)))
        rows = rows.withColumn(f"_d{place}", F.dense_rank().over(group.orderBy(c)) - 1)
    # which of both is told apart by its digits makes no difference: the one with fewer different values has fewer
    tops = {c: F.max(c).over(group) for c in ("_drl", "_drp")}
    rows = rows.withColumns({"_tl": tops["_drl"], "_tp": tops["_drp"], "_bl": F.col("label") <= F.min("label").over(group) + near, "_bp": F.col("prediction") <= F.min("prediction").over(group) + near})
    fewer = F.col("_tl") <= F.col("_tp")
    rows = rows.withColumns({"_x": F.when(fewer, F.col("_drl")).otherwise(F.col("_drp")), "_y": F.when(fewer, F.col("_drp")).otherwise(F.col("_drl")), "_top": F.least("_tl", "_tp")})
    rows = rows.withColumn("_equal", F.sum(whole.cast("long")).over(Window.partitionBy("grp", "_x"))).drop("_drl", "_drp", "_tl", "_tp")
    split = rows.withColumn("digit", F.explode(_digits(F.col("_top"))))
    bit, head = _bit(F.col("_x"), F.col("digit"))
    split = split.withColumn("head", head).withColumn("_zero", (whole & (bit == 0)).cast("long")).withColumn("_one", whole & (bit == 1))
    place = Window.partitionBy("grp", "digit", "head")
    level = F.sum("_zero").over(Window.partitionBy("grp", "digit", "head", "_y"))
    split = split.withColumn("_upto", F.sum("_zero").over(place.orderBy("_y"))).withColumn("_level", level)  # with the rows of the same place
    split = split.withColumn("_agree", F.when(F.col("_one"), F.col("_upto") - 0.5 * F.col("_level")).otherwise(0.0))
    each = F.col("digit") == 0
    once = lambda c: F.when(each, c)
    rank = lambda c, place, many: once(F.when(F.col(c).isNotNull(), F.col(place) + (F.col(many) + 1) / 2))
    n = F.sum(once(whole.cast("long")))
    agree = F.sum("_agree") + F.sum(once(F.when(whole, F.col("_equal") - 1))) / 4
    return split.groupBy("grp").agg(
        F.count(once(F.lit(1))).alias("size"),
        safe_corr(once(F.col("label")), once(F.col("prediction"))).alias("pearson"),
        safe_corr(rank("label", "rl", "cl"), rank("prediction", "rp", "cp")).alias("spearman"),
        F.try_divide(agree, n * (n - 1) / 2).alias("concordance"),
        _top1(mode, each).alias("top1"),
    )


def _ranged_metrics(rows: DataFrame, near: float, mode: str) -> DataFrame:
    for c, place, many in (("label", "rl", "cl"), ("prediction", "rp", "cp")):
        numbers = checkpointed(value_counts(rows, ["grp"], c)).select("grp", c, F.col("before").alias(place), F.col("many").alias(many))
        rows = same(rows, numbers, ["grp", c], "left")
    least = rows.groupBy("grp").agg(F.min("label").alias("_ml"), F.min("prediction").alias("_mp"))
    rows = checkpointed(same(rows, least, ["grp"]).withColumn("_bl", F.col("label") <= F.col("_ml") + near).withColumn("_bp", F.col("prediction") <= F.col("_mp") + near))
    per = rows.groupBy("grp").agg(F.count("*").alias("size"), safe_corr("label", "prediction").alias("pearson"), safe_corr(F.col("rl") + (F.col("cl") + 1) / 2, F.col("rp") + (F.col("cp") + 1) / 2).alias("spearman"), _top1(mode, F.lit(True)).alias("top1"))
    cells = rows.where("rl is not null and rp is not null").select("grp", "rl", "rp", F.lit(1).alias("w"))
    return same(per, _agreement(cells), ["grp"], "left").select("grp", "size", "pearson", "spearman", "concordance", "top1")


def summarize_groups(metrics: DataFrame, *by: str) -> DataFrame:
    """Unweighted and size-weighted means over groups; correlations where they are defined."""
    weighted = lambda c: F.try_divide(F.sum(F.col("size") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("size"))))
    return metrics.groupBy(*by).agg(
        F.count("*").alias("groups"),
        F.sum("size").alias("items"),
        F.avg("pearson").alias("pearson"),
        weighted("pearson").alias("pearson_weighted"),
        F.avg((F.col("pearson") > 0).cast("double")).alias("pearson_positive"),
        F.avg("spearman").alias("spearman"),
        weighted("spearman").alias("spearman_weighted"),
        F.avg("concordance").alias("concordance"),
        F.avg("top1").alias("top1"),
        F.avg(1 / F.col("size")).alias("chance_top1"),
    )


def worst_groups(metrics: DataFrame, n: int, metric: str = "pearson") -> DataFrame:
    """(grp, metric): the n groups of lowest metric, ties by group; those without one do not count."""
    return metrics.where(F.col(metric).isNotNull()).select("grp", metric).orderBy(metric, "grp").limit(n)


def centred_most(df: DataFrame, value: str, group: str) -> DataFrame:
    """(centered_max_abs): the largest distance of a value from its group's mean; 0 where a group fixes the value."""
    means = df.groupBy(group).agg(F.avg(value).alias("_m"))
    return same(df.select(group, value), means, [group]).agg(F.max(F.abs(F.col(value) - F.col("_m"))).alias("centered_max_abs"))


def composite(summary: DataFrame) -> DataFrame:
    return summary.withColumn("composite", (F.col("pearson") + F.col("spearman")) / 2)


def stratify(df: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """df once for each stratum that a row belongs to, with the stratum's name; strata may overlap."""
    names = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in strata.items())))
    return df.withColumn("stratum", F.explode(names))


def size_strata(size: Column) -> dict[str, Column]:
    return {"size=3": size == 3, "size=4": size == 4, "size>=5": size >= 5}


def is_partition(df: DataFrame, key: str, strata: dict[str, Column]) -> DataFrame:
    """One row: whether each row of df lies in exactly one of the strata."""
    hits = sum((F.when(c, 1).otherwise(0) for c in strata.values()), F.lit(0))
    return df.agg(F.bool_and(hits == 1).alias("partitions"), F.count(key).alias("n"))


def long_metrics(df: DataFrame, model: str) -> DataFrame:
    """(model, metric, value) rows of a table with a row a model and a column a metric."""
    names = [c for c in df.columns if c != model]
    return df.select(F.col(model).alias("model"), F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("model", "m.metric", "m.value")


def reaggregate(groups: DataFrame, medians: DataFrame, old: DataFrame, far: float = 0.5, near: float = 0.7) -> DataFrame:
    """(stratum, groups, items, pearson): strata by similarity from stored groups(grp, size, pearson) and medians(grp, median), and
    the old strata that they do not replace. Each stored group must fall into one stratum."""
    stratum = F.when(F.col("median") <= far, "far").when(F.col("median") <= near, "mid").when(F.col("median").isNotNull(), "near")
    placed = groups.join(medians.hint("merge"), "grp", "left").withColumn("stratum", stratum)
    placed = placed.withColumn("stratum", F.coalesce("stratum", F.raise_error(F.concat(F.lit("no median for group "), F.col("grp").cast("string"))).cast("string")))
    new = placed.groupBy("stratum").agg(F.count("*").alias("groups"), F.sum("size").alias("items"), F.avg("pearson").alias("pearson"))
    return new.unionByName(old.where(~F.col("stratum").isin("far", "mid", "near")))


def paired_delta(left: DataFrame, right: DataFrame, *metrics: str) -> DataFrame:
    """Per group the difference left minus right of each metric; groups of both tables."""
    r = right.select("grp", *(F.col(m).alias(f"_{m}") for m in metrics))
    return left.join(r, "grp").select("grp", *((F.col(m) - F.col(f"_{m}")).alias(m) for m in metrics))


def gates(values: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(gate, passed) rows of a one-row frame, and `all`."""
    every = F.lit(True)
    for c in conditions.values():
        every = every & F.coalesce(c, F.lit(False))
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in conditions.items()), F.struct(F.lit("all").alias("gate"), every.alias("passed")))
    return values.select(F.explode(rows).alias("g")).select("g.gate", "g.passed")


def modal(df: DataFrame, value: str, preferred: float) -> DataFrame:
    """The most frequent value; a tie goes to the one nearest to `preferred` on a logarithmic scale."""
    per = df.groupBy(value).agg(F.count("*").alias("n"))
    far = F.abs(F.log10(F.col(value)) - F.log10(F.lit(preferred)))
    return per.agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -far, F.col(value))).alias("m")).select(f"m.{value}", "m.n")
