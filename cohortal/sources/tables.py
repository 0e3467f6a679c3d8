"""Scans and sinks: line lists, aliased and checked tables, files with digests, models, exports, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed
from cohortal.operators.ordering import running

STRUCTURE_ALIASES = ("SMILES", "smiles", "Canonical_SMILES", "mol")
LABEL_ALIASES = ("energy", "energy_eV")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ix, item): the first field of each line that is neither blank nor a comment; ix keeps the order."""
    lines = spark.read.text(paths).select(F.monotonically_increasing_id().alias("ix"), F.trim("value").alias("line"))
    return lines.where("line <> '' and not startswith(line, '#')").select("ix", F.element_at(F.split("line", "\\s+"), 1).alias("item"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def aliased(df: DataFrame, name: str, aliases: tuple[str, ...]) -> DataFrame:
    """df with the first alias that it has renamed to `name`."""
    found = next((a for a in aliases if a in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(aliases)}")
    return df.withColumnRenamed(found, name)


def read_items(spark: SparkSession, path: str, aliases: tuple[str, ...] = STRUCTURE_ALIASES) -> DataFrame:
    read = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.csv(path, header=True)
    return aliased(read, "item", aliases)


def read_manifest(df: DataFrame, split: str) -> DataFrame:
    """df, failing when a row is read whose split is another one."""
    wrong = F.raise_error(F.concat(F.lit(f"expected split {split}, found "), F.coalesce("split", F.lit("none")))).cast("string")
    return df.withColumn("split", F.when(F.col("split").eqNullSafe(split), F.col("split")).otherwise(wrong))


def scan_files(spark: SparkSession, path: str, pattern: str, expected: int | None = None, exclude: str | None = None) -> DataFrame:
    """(path, length, sha256) of the files below a folder, without derived ones, whose paths match `exclude`; their number must be
    the expected one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.col("path").rlike(exclude)) if exclude else files
    files = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    if expected is not None and (n := files.count()) != expected:
        raise ValueError(f"{n} files match {pattern}; {expected} expected")
    return files


def dataset_digest(df: DataFrame, key: str, fan: int = 1024) -> DataFrame:
    """One row: the root of a tree of digests over the rows in the order of key, `fan` to a node. Keys must differ; a null in a
    row counts as \\N. No task sees more than `fan` digests."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\\\N")) for c in df.columns)), 256)
    level = running(df.select(F.col(key).alias("k"), row.alias("h"), F.lit(1).alias("one")), [], ["k"], {"at": "one"}).select("at", "h")
    if not level.limit(1).count():
        return df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("sha256"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda r: r["h"]), "")
        level = checkpointed(level.groupBy(F.floor(F.col("at") / fan).alias("up")).agg(F.sha2(joined, 256).alias("h")).select(F.col("up").alias("at"), "h"))
        if level.count() == 1:
            return level.select(F.col("h").alias("sha256"))


def load_model(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(card, weights(name, weight, mean, scale)) of a model file; a wrong version, unequal keys or bad numbers fail."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "schema_version int, card struct<intercept:double,q99:double>, weights map<string,double>, means map<string,double>, scales map<string,double>").alias("m")).select("m.*").first()
    if raw is None or raw["schema_version"] != 1:
        raise ValueError("schema_version must be 1")
    maps = {k: raw[k] or {} for k in ("weights", "means", "scales")}
    if len({frozenset(m) for m in maps.values()}) != 1:
        raise ValueError("weights, means and scales must have the same names")
    if any(x is None or x != x or abs(x) == float("inf") for m in maps.values() for x in m.values()) or any(x <= 0 for x in maps["scales"].values()):
        raise ValueError("values must be finite, scales above 0")
    rows = [(n, maps["weights"][n], maps["means"][n], maps["scales"][n]) for n in sorted(maps["weights"])]
    return raw["card"].asDict(), spark.createDataFrame(rows, "name string, weight double, mean double, scale double")


def save_model(card: dict, weights: DataFrame, path: str) -> None:
    """The same layout back, names in order."""
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", c))))
    one = weights.agg(as_map("weight").alias("weights"), as_map("mean").alias("means"), as_map("scale").alias("scales"))
    head = F.struct(*(F.lit(float(v)).alias(k) for k, v in card.items()))
    one.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), head.alias("card"), "weights", "means", "scales")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_ensemble(spark: SparkSession, manifest: str) -> DataFrame:
    """(member, name, weight, mean, scale, share) of the models that a manifest names, by paths relative to it.

    The manifest is JSON with `members` and, if they are not alike, `weights`; shares are weights over their sum.
    """
    found = spark.read.text(manifest, wholetext=True).select(F.from_json("value", "members array<string>, weights array<double>").alias("m")).select("m.*").first()
    if found is None or not found["members"]:
        raise ValueError("the manifest names no member")
    weights = found["weights"] or [1.0] * len(found["members"])
    if len(weights) != len(found["members"]) or min(weights) < 0 or not sum(weights) > 0:
        raise ValueError("weights must be as many as members, not negative, and not all 0")
    base, out = manifest.rstrip("/").rsplit("/", 1)[0], None
    for member, weight in zip(found["members"], weights, strict=True):
        now = load_model(spark, f"{base}/{member}")[1].select(F.lit(member).alias("member"), "*", F.lit(weight / sum(weights)).alias("share"))
        out = now if out is None else out.unionByName(now)
    return out


def export_table(df: DataFrame, path: str, order: list[str], form: str = "parquet") -> None:
    """A sorted table; the commit protocol replaces the old one as a whole."""
    writer = df.orderBy(*order).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def write_scores(df: DataFrame, path: str, form: str = "csv") -> None:
    """df(item, prediction, warnings, error, ...) as path/predictions and, where error is set, path/failures.

    CSV joins warnings by ';'; JSON lines keep the list.
    """
    good = df.where("error is null").drop("error")
    bad = df.where("error is not null").select("item", "error")
    if form == "json":
        good.write.mode("overwrite").json(f"{path}/predictions")
        bad.write.mode("overwrite").json(f"{path}/failures")
    else:
        good.withColumn("warnings", F.array_join("warnings", ";")).write.mode("overwrite").csv(f"{path}/predictions", header=True)
        bad.write.mode("overwrite").csv(f"{path}/failures", header=True)


def audit(df: DataFrame, stage: str, counters: dict[str, Column], rules: list[str] | None = None, hashes: dict[str, Column] | None = None) -> DataFrame:
    """One row for a caller to write as JSON: stage, counters (aggregates of df), the rules in words, and hashes of what was read."""
    one = df.agg(F.struct(*(c.cast("long").alias(n) for n, c in counters.items())).alias("counters"))
    kept = F.struct(*(c.alias(n) for n, c in hashes.items())) if hashes else F.lit(None).cast("struct<none:string>")
    return one.select(F.lit(stage).alias("stage"), "counters", F.array(*map(F.lit, rules or [])).cast("array<string>").alias("rules"), kept.alias("hashes"))


#: The columns of the comparison tables.
GLOBAL_METRICS = ("mae", "rmse", "median_abs_error", "r2", "pearson", "spearman")
LOCAL_METRICS = ("mean_pearson", "mean_spearman", "mean_concordance", "top1")


def summary_tables(whole: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparison tables of models from long metrics (model, metric, value): a row a model, fixed columns, null where unknown."""

    def table(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        return df.groupBy("model").pivot("metric", list(names)).agg(F.first("value")).select("model", *names)

    return table(whole, GLOBAL_METRICS), table(local, LOCAL_METRICS)


def export_training(items: DataFrame, fold: int, path: str, folds: int = 5) -> None:
    """CSV (item, centered, part): group-centred labels; the fold's groups are `val`, the others `train`."""
    from cohortal.operators.cohort import fold_of
    from cohortal.operators.linear import center_labels

    part = F.when(fold_of(F.col("grp"), folds) == fold, "val").otherwise("train")
    center_labels(items).select("item", "centered", part.alias("part")).write.mode("overwrite").csv(path, header=True)


def import_predictions(requested: DataFrame, predictions: DataFrame) -> DataFrame:
    """(item, prediction): means over folds; items must be those that were asked for."""
    per = predictions.groupBy("item").agg(F.avg("prediction").alias("prediction"))
    per = checkpointed(per)
    if per.join(requested.hint("merge"), "item", "left_anti").limit(1).count() or requested.join(per.hint("merge"), "item", "left_anti").limit(1).count():
        raise ValueError("predicted items are not the requested ones")
    return per
