"""Registered queries of the scans and sinks: what a sink wrote is read back by its scan. And of the small column functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cohortal.functions import scalars as S
from cohortal.operators import enrich, linear, metrics, prep, reactions
from cohortal.operators.loops import shared_folder
from cohortal.plans import bindings as B
from cohortal.plans.queries import _CORR, _RANKED, R, query, rounded
from cohortal.sources import labelling
from cohortal.sources import tables as T
from cohortal.streaming import scoring


# ---------------------------------------------------------------- scans
@query("read_lines", "SELECT split_part(p_brand, ' ', 1) AS item, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1")
def read_lines(spark, d):
    path = shared_folder(spark, "lines")
    p = B.read(spark, d, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_brand", F.lit("\t"), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("# "), "p_name")).otherwise(F.lit("   "))
    p.select(line.alias("value")).write.text(path)
    return T.read_lines(spark, path).groupBy("item").agg(F.count("*").alias("n"))


@query("read_items", "SELECT p_brand AS item, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def read_items(spark, d):
    path = shared_folder(spark, "items")
    T.export_table(B.read(spark, d, "part").select(F.col("p_brand").alias("smiles"), "p_size"), path, ["smiles"], "csv")
    return T.read_items(spark, path).groupBy("item").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("size"))


@query("checked_columns", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def checked_columns(spark, d):
    return T.require_columns(B.read(spark, d, "customer"), ["c_custkey", "c_mktsegment"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("read_manifest", "SELECT c_custkey AS item, 'training' AS split FROM customer WHERE c_nationkey < 20")
def read_manifest(spark, d):
    path = shared_folder(spark, "manifest")
    T.export_table(B.read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("item"), F.lit("training").alias("split")), path, ["item"])
    return T.read_manifest(spark.read.parquet(path), "training")


@query("scan_files", "SELECT CAST(n_regionkey AS INT) AS region, CAST(sum(length(n_name) + 1) AS BIGINT) AS length, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha256 FROM nation GROUP BY 1")
def scan_files(spark, d):
    path = shared_folder(spark, "files")
    n = B.read(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("value"))
    regions = n.select("n_regionkey").distinct().count()
    n.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    n.where("n_regionkey = 0").coalesce(1).select("value").write.text(f"{path}/n_regionkey=0/derived")
    found = T.scan_files(spark, path, "*.txt", regions, exclude="/derived/")
    return found.select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int").alias("region"), "length", "sha256")


@query("dataset_digest", """WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, sha256(concat_ws('|', c_custkey, c_mktsegment, c_nationkey)) AS h FROM customer), a AS (SELECT pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY r.pos)) AS h FROM r GROUP BY pos // 1024), b AS (SELECT pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY a.pos)) AS h FROM a GROUP BY pos // 1024)
SELECT CASE WHEN (SELECT count(*) FROM a) = 1 THEN (SELECT max(h) FROM a) ELSE (SELECT max(h) FROM b) END AS sha256""")
def dataset_digest(spark, d):
    return T.dataset_digest(B.read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")


_RECORDS = "SELECT o_orderkey AS reaction_id, concat('c', o_custkey % 50) AS reagent, concat('o', o_orderkey % 7) AS product, concat('a', o_custkey % 9, '.', 'b', '>', '>', 'p', o_orderkey % 5, ' |x|') AS identifier FROM orders"


@query("flatten_reactions", f"WITH r AS ({_RECORDS}) SELECT reagent AS component, reaction_id, 'input:m:0' AS location FROM r UNION ALL SELECT 'solvent', reaction_id, 'input:m:1' FROM r UNION ALL SELECT product, reaction_id, 'outcome:0:product:0' FROM r UNION ALL SELECT split_part(split_part(identifier, '>', 1), '.', 1), reaction_id, 'reaction_smiles_reactant' FROM r UNION ALL SELECT 'b', reaction_id, 'reaction_smiles_reactant' FROM r UNION ALL SELECT split_part(split_part(identifier, '>', 3), ' ', 1), reaction_id, 'reaction_smiles_product' FROM r")
def flatten_reactions(spark, d):
    o = B.read(spark, d, "orders")
    text = F.concat(F.lit("a"), (F.col("o_custkey") % 9).cast("string"), F.lit(".b>>p"), (F.col("o_orderkey") % 5).cast("string"), F.lit(" |x|"))
    nested = o.select(F.col("o_orderkey").alias("reaction_id"), F.create_map(F.lit("m"), F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")), F.lit("solvent"))).alias("inputs"), F.array(F.array(F.concat(F.lit("o"), (F.col("o_orderkey") % 7).cast("string")))).alias("outcomes"), text.alias("identifier"))
    return prep.flatten_reactions(nested)


# ---------------------------------------------------------------- models
def _supplier_model(spark, d, shift=0):
    s = B.read(spark, d, "supplier")
    return s.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("name"), (F.round("s_acctbal", 2) + shift).alias("weight"), (F.col("s_suppkey") % 5).cast("double").alias("mean"), (F.col("s_suppkey") % 3 + 1).cast("double").alias("scale"))


_MODEL = "SELECT concat('t', s_suppkey) AS name, round(s_acctbal, 2) AS weight, CAST(s_suppkey % 5 AS DOUBLE) AS mean, CAST(s_suppkey % 3 + 1 AS DOUBLE) AS scale FROM supplier"


@query("model_round_trip", f"SELECT name, round(weight, {R}) AS weight, mean, scale, 1.5::DOUBLE AS intercept FROM ({_MODEL})")
def model_round_trip(spark, d):
    path = shared_folder(spark, "model")
    T.save_model({"intercept": 1.5, "q99": 2.0}, _supplier_model(spark, d), path)
    card, weights = T.load_model(spark, path)
    return rounded(weights, "weight").withColumn("intercept", F.lit(card["intercept"]))


@query("load_ensemble", f"SELECT 'first' AS member, name, round(weight, {R}) AS weight, 0.25::DOUBLE AS share FROM ({_MODEL}) UNION ALL SELECT 'second', name, round(weight + 2, {R}), 0.75 FROM ({_MODEL})")
def load_ensemble(spark, d):
    path = shared_folder(spark, "ensemble")
    for shift, member in ((0, "first"), (2, "second")):
        T.save_model({"intercept": 0.0, "q99": 1.0}, _supplier_model(spark, d, shift), f"{path}/{member}")
    spark.createDataFrame([(json.dumps({"members": ["first", "second"], "weights": [1.0, 3.0]}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return rounded(T.load_ensemble(spark, f"{path}/manifest"), "weight").select("member", "name", "weight", "share")


# ---------------------------------------------------------------- sinks
@query("export_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def export_table(spark, d):
    path = shared_folder(spark, "export")
    n = B.read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    T.export_table(n, path, ["n_regionkey", "n_name"])
    return spark.read.parquet(path)


@query("write_scores", "SELECT c_custkey AS item, CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS prediction, CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS error FROM customer")
def write_scores(spark, d):
    path = shared_folder(spark, "scores")
    c = B.read(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal", 2)).alias("prediction"), F.array().cast("array<string>").alias("warnings"), F.when(F.col("c_acctbal") < 0, "negative balance").alias("error"))
    T.write_scores(c, path, "json")
    good, bad = spark.read.json(f"{path}/predictions"), spark.read.json(f"{path}/failures")
    return good.select("item", "prediction", F.lit(None).cast("string").alias("error")).unionByName(bad.select("item", F.lit(None).cast("double").alias("prediction"), "error"))


@query("audit_record", "SELECT 'prepare' AS stage, count(*) AS rows, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, 'c_acctbal >= 0' AS rule, sha256('customer') AS input FROM customer")
def audit_record(spark, d):
    path = shared_folder(spark, "audit")
    c = B.read(spark, d, "customer")
    T.audit(c, "prepare", {"rows": F.count("*"), "negative": F.sum((F.col("c_acctbal") < 0).cast("int"))}, rules=["c_acctbal >= 0"], hashes={"input": F.sha2(F.lit("customer"), 256)}).write.json(path)
    return spark.read.json(path).select("stage", "counters.rows", "counters.negative", F.col("rules")[0].alias("rule"), "hashes.input")


_MODELS = f"WITH {B.SCORED}, models AS (SELECT 'half' AS model, grp, item, label, prediction FROM scored UNION ALL SELECT 'label', grp, item, label, label + 1 FROM scored)"


@query("summary_tables", f"""{_MODELS}, {_RANKED.replace('PARTITION BY grp', 'PARTITION BY model').format(src='models')}, g AS (SELECT model, avg(abs(prediction - label)) AS mae, sqrt(avg((prediction - label) ** 2)) AS rmse, {_CORR.format(x='label', y='prediction')} AS pearson, {_CORR.format(x='rl', y='rp')} AS spearman FROM ranked GROUP BY 1),
l AS (SELECT model, avg(p) AS p FROM (SELECT model, grp, {_CORR.format(x='label', y='prediction')} AS p FROM models GROUP BY 1, 2) GROUP BY 1) SELECT model, round(mae, {R}) AS mae, round(rmse, {R}) AS rmse, round(g.pearson, {R}) AS pearson, round(spearman, {R}) AS spearman, round(l.p, {R}) AS mean_pearson FROM g JOIN l USING (model)""")
def summary_tables(spark, d):
    s = B.scored(spark, d)
    both = s.withColumn("model", F.lit("half")).unionByName(s.withColumn("prediction", F.col("label") + 1).withColumn("model", F.lit("label")))
    whole = metrics.regression_metrics(both, "model")
    local = both.groupBy("model", "grp").agg(metrics.safe_corr("label", "prediction").alias("pearson")).groupBy("model").agg(F.avg("pearson").alias("mean_pearson"))
    first, second = T.summary_tables(metrics.long_metrics(whole, "model"), metrics.long_metrics(local, "model"))
    j = first.join(second.hint("merge"), "model")
    return rounded(j, "mae", "rmse", "pearson", "spearman", "mean_pearson").select("model", "mae", "rmse", "pearson", "spearman", "mean_pearson")


@query("export_training", f"WITH {B.ITEMS} SELECT item, round(label - avg(label) OVER (PARTITION BY grp), 4) AS centered, CASE WHEN CAST(('0x' || substr(sha256('outer-fold:' || grp), 1, 8))::UBIGINT % 5 AS INT) = 2 THEN 'val' ELSE 'train' END AS part FROM items")
def export_training(spark, d):
    path = shared_folder(spark, "training")
    T.export_training(B.items(spark, d), 2, path)
    return spark.read.csv(path, header=True, schema="item long, centered double, part string").withColumn("centered", F.round("centered", 4) + F.lit(0.0))


@query("import_predictions", f"SELECT c_custkey AS item, round((c_acctbal + c_acctbal * 2 + 3) / 3, {R}) AS prediction FROM customer")
def import_predictions(spark, d):
    c = B.read(spark, d, "customer")
    folds = c.select(F.col("c_custkey").alias("item"), F.explode(F.array(F.col("c_acctbal"), F.col("c_acctbal") * 2, F.lit(3.0))).alias("prediction"))
    return rounded(T.import_predictions(c.select(F.col("c_custkey").alias("item")), folds), "prediction")


# ---------------------------------------------------------------- records
@query("reaggregate", f"WITH {B.SCORED}, g AS (SELECT grp, count(*) AS size, {_CORR.format(x='label', y='prediction')} AS pearson FROM scored GROUP BY 1), m AS (SELECT grp, CASE WHEN grp LIKE '%BUILDING' THEN 0.3 WHEN grp LIKE '%MACHINERY' THEN 0.6 ELSE 0.9 END AS median FROM g) SELECT CASE WHEN median <= 0.5 THEN 'far' WHEN median <= 0.7 THEN 'mid' ELSE 'near' END AS stratum, count(*) AS groups, CAST(sum(size) AS BIGINT) AS items, round(avg(pearson), {R}) AS pearson FROM g JOIN m USING (grp) GROUP BY 1 UNION ALL SELECT 'all', 1, 2, 0.5")
def reaggregate(spark, d):
    path = shared_folder(spark, "groups")
    s = B.scored(spark, d)
    s.groupBy("grp").agg(F.count("*").alias("size"), metrics.safe_corr("label", "prediction").alias("pearson")).write.parquet(path)
    stored = spark.read.parquet(path)
    median = stored.select("grp", F.when(F.col("grp").endswith("BUILDING"), 0.3).when(F.col("grp").endswith("MACHINERY"), 0.6).otherwise(0.9).alias("median"))
    old = spark.createDataFrame([("far", 9, 9, 0.1), ("all", 1, 2, 0.5)], "stratum string, groups long, items long, pearson double")
    return rounded(metrics.reaggregate(stored, median, old), "pearson")


@query("lowest_per_item", "SELECT l_orderkey AS item, l_linenumber AS candidate, round(e, 4) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY e, l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS e FROM lineitem WHERE l_linenumber % 4 <> 3 GROUP BY 1, 2)) WHERE r = 1")
def lowest_per_item(spark, d):
    c = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("candidate"), F.when(F.col("l_linenumber") % 4 != 3, F.col("l_extendedprice")).alias("energy"))
    some = c.where("energy is not null").select("item").distinct()
    return reactions.lowest_per_item(c.join(some.hint("merge"), "item", "left_semi")).withColumn("energy", F.round("energy", 4))


@query("scorer_choice", f"WITH s AS (SELECT l_orderkey AS reaction, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE -l_quantity END) AS delta, count(*) AS edits, bool_or(l_quantity >= 50) AS failed FROM lineitem GROUP BY 1) SELECT reaction, 'GRAPH' AS scorer, CASE WHEN NOT failed THEN round(delta, {R}) END AS score FROM s UNION ALL SELECT reaction, 'ITS', CASE WHEN NOT failed THEN round(delta + 0.5 * edits, {R}) END FROM s")
def scorer_choice(spark, d):
    rows = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("reaction")).agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("delta"), F.count("*").alias("edits"), F.bool_or(F.col("l_quantity") >= 50).alias("failed"))
    rows = rows.withColumn("delta", F.when(~F.col("failed"), F.col("delta")))
    out = [reactions.score_with(name, rows, {"edit": 0.5}).select("reaction", F.lit(name).alias("scorer"), "score") for name in ("GRAPH", "ITS")]
    return rounded(out[0].unionByName(out[1]), "score")


@query("score_states", f"WITH t AS (SELECT l_orderkey AS reaction, l_returnflag AS kind, sum(l_quantity) AS change FROM lineitem GROUP BY 1, 2), p AS (SELECT reaction, sum(change * CASE kind WHEN 'R' THEN 0.2 WHEN 'A' THEN -0.1 ELSE 0 END) AS p FROM t GROUP BY 1) SELECT o_orderkey AS reaction, CASE WHEN o_orderkey % 6 = 0 THEN 'unsupported' ELSE 'success' END AS status, CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice / 1000 + coalesce(p, 0) - CASE WHEN o_orderkey % 4 = 0 THEN 1.5 ELSE 0 END, {R}) END AS score FROM orders LEFT JOIN p ON p.reaction = o_orderkey")
def score_states(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("reaction"), (F.col("o_totalprice") / 1000).alias("delta"))
    terms = B.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("reaction"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("change"))
    status = o.select("reaction", F.when(F.col("reaction") % 6 == 0, "unsupported").otherwise("success").alias("status"))
    near = o.where("reaction % 4 = 0").select("reaction", F.lit(1.5).alias("stabilization"))
    return rounded(reactions.score_its(o, terms, {"R": 0.2, "A": -0.1}, status, near), "score")


@query("sort_reactions", "SELECT reaction, CAST(row_number() OVER (ORDER BY score NULLS LAST, reaction) AS BIGINT) AS place FROM (SELECT o_orderkey AS reaction, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 10 END AS score FROM orders)")
def sort_reactions(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("reaction"), F.col("o_orderkey").alias("ix"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 10).alias("score"))
    return reactions.placed(o).select("reaction", "place")


@query("pinned_inputs", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey = 4 THEN 'changed' ELSE 'same' END AS state FROM nation")
def pinned_inputs(spark, d):
    n = B.read(spark, d, "nation")
    stored = n.select(F.col("n_nationkey").cast("string").alias("key"), F.sha2("n_name", 256).alias("value"))
    current = n.select(F.col("n_nationkey").cast("string").alias("key"), F.sha2(F.when(F.col("n_nationkey") == 4, "other").otherwise(F.col("n_name")), 256).alias("value"))
    return enrich.pin_states(stored, current)


@query("split_failures", "SELECT CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'kept' END AS side, count(*) AS n FROM customer GROUP BY 1")
def split_failures(spark, d):
    c = prep.clean_labels(B.read(spark, d, "customer").select("c_custkey", "c_acctbal"), [(F.col("c_acctbal") < 0, "negative")])
    kept, failed = prep.split_failures(c)
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("side"), "n").unionByName(failed.agg(F.count("*").alias("n")).select(F.lit("failed").alias("side"), "n"))


@query("widen_ranges", "SELECT element, min(lo) AS lo, max(hi) AS hi FROM (SELECT l_returnflag AS element, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_linenumber > 2 GROUP BY 1 UNION ALL SELECT l_linestatus, min(l_linenumber), max(l_linenumber) FROM lineitem GROUP BY 1) GROUP BY 1")
def widen_ranges(spark, d):
    lines = B.read(spark, d, "lineitem")
    of = lambda c, df: df.groupBy(F.col(c).alias("element")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return linear.widen_ranges(of("l_returnflag", lines.where("l_linenumber > 2")), of("l_linestatus", lines))


@query("strata_partition", "SELECT bool_and((o_custkey % 9 = 3)::INT + (o_custkey % 9 = 4)::INT + (o_custkey % 9 >= 5)::INT = 1) AS partitions, count(o_orderkey) AS n FROM orders WHERE o_custkey % 9 >= 3")
def strata_partition(spark, d):
    o = B.read(spark, d, "orders").where("o_custkey % 9 >= 3")
    return metrics.is_partition(o, "o_orderkey", metrics.size_strata(F.col("o_custkey") % 9))


# ---------------------------------------------------------------- streams
def _streamed(spark, rows, transform):
    """What a stream over the files of rows writes to files, all of them read once."""
    path = shared_folder(spark, "stream")
    rows.write.parquet(f"{path}/in")
    stream = transform(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_scores", f"SELECT p_partkey AS item, round(1.0 + 0.5 * p_size + CASE WHEN p_partkey % 2 = 0 THEN -0.25 * p_retailprice ELSE 0 END, {R}) + 0.0 AS prediction FROM part")
def stream_scores(spark, d):
    p = B.read(spark, d, "part")
    even = F.when(F.col("p_partkey") % 2 == 0, F.lit("price")).otherwise("unknown")
    rows = p.select(F.col("p_partkey").alias("item"), F.create_map(F.lit("size"), F.col("p_size").cast("double"), even, F.col("p_retailprice").cast("double")).alias("features"))
    return rounded(_streamed(spark, rows, lambda x: scoring.score_stream(x, {"size": 0.5, "price": -0.25}, 1.0)), "prediction").select("item", "prediction")


@query("stream_components", f"WITH {B.RAW}, p AS (SELECT location, string_split(regexp_extract(trim(s), '^\\S+'), '>') AS parts FROM raw), u AS (SELECT location, unnest(['reactant', 'reagent', 'product']) AS side, unnest(parts) AS part FROM p WHERE len(parts) = 3) SELECT location, side, unnest(list_filter(string_split(part, '.'), lambda x: x <> '')) AS component FROM u")
def stream_components(spark, d):
    return _streamed(spark, B.raw(spark, d), scoring.split_stream).select("location", "side", "component")


@query("stream_labels", "SELECT c_custkey AS item, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal, 2) END AS label, CASE WHEN c_custkey % 8 = 0 THEN 'nonfinite_label' WHEN c_custkey % 4 = 0 THEN 'missing_label' END AS reason FROM customer")
def stream_labels(spark, d):
    c = B.read(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 8 == 0, "inf").when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.round("c_acctbal", 2).cast("string"))
    rows = c.select(F.col("c_custkey").alias("item"), text.alias("energy"), F.lit(" ").alias("energy_eV"))
    return _streamed(spark, rows, lambda x: scoring.label_stream(x, "energy_eV", "energy")).select("item", "label", "reason")


# ---------------------------------------------------------------- column functions
@query("reaction_sides", "SELECT p_partkey AS item, CASE WHEN p_partkey % 4 <> 0 THEN concat(p_brand, '+', p_type) END AS \"left\", CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS \"right\" FROM part")
def reaction_sides(spark, d):
    p = B.read(spark, d, "part")
    text = F.when(F.col("p_partkey") % 8 == 0, F.concat("p_brand", F.lit(">>"))).when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit("."), "p_type", F.lit(">>"), "p_name", F.lit(" ")))
    return p.select(F.col("p_partkey").alias("item"), S.reaction_sides(text).alias("s")).select("item", F.array_join("s.left", "+").alias("left"), F.array_join("s.right", "+").alias("right"))


@query("scalar_functions", f"""SELECT l_orderkey AS item, l_linenumber AS line, l_returnflag <> 'R' AS supported, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE round(l_quantity, {R}) END AS clean, CASE WHEN l_returnflag = 'N' THEN 'fixed' WHEN l_returnflag = 'A' THEN 'first_order' ELSE 'named' END AS block,
 CASE WHEN l_returnflag = 'A' THEN 'v2_' || l_linenumber ELSE l_returnflag END AS renamed, least(l_returnflag || '|' || l_linestatus || '|C', 'C|' || l_linestatus || '|' || l_returnflag) AS path,
 CASE WHEN l_linenumber = 5 THEN 'aromatic' WHEN l_linenumber % 4 = 3 THEN 'triple' WHEN l_linenumber % 4 = 2 THEN 'double' ELSE 'single' END AS bond, round(1 / (1 + l_quantity), {R}) AS applicability,
 CASE WHEN l_linenumber = 1 THEN 'worker_error' WHEN l_linenumber = 2 THEN 'unsupported' WHEN l_linenumber = 3 THEN 'missing_energy' WHEN l_linenumber = 4 THEN 'partial' ELSE 'success' END AS status,
 CASE WHEN l_returnflag = 'N' THEN 'own' WHEN l_returnflag = 'A' THEN 'first_order_v1' ELSE 'ring_topology' END AS family FROM lineitem""")
def scalar_functions(spark, d):
    lines = B.read(spark, d, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    name = F.when(flag == "N", "n").when(flag == "A", F.concat(F.lit("first_order_v1["), number.cast("string"))).otherwise("ring_x")
    return lines.select(
        F.col("l_orderkey").alias("item"),
        number.alias("line"),
        S.elements_supported(F.array(F.lit("C"), F.when(flag == "R", "Xx").otherwise("N"))).alias("supported"),
        F.round(S.clean_value(F.when(number % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))), R).alias("clean"),
        S.feature_block(name, ["n"]).alias("block"),
        S.renamed(F.when(flag == "A", F.concat(F.lit("v1_"), number.cast("string"))).otherwise(flag), "v1_", "v2_").alias("renamed"),
        S.canonical_path(F.array(flag, F.col("l_linestatus"), F.lit("C"))).alias("path"),
        S.bond_class((number % 4).cast("double"), number == 5).alias("bond"),
        F.round(S.applicability(F.col("l_quantity")), R).alias("applicability"),
        enrich.derive_status(F.when(number != 3, F.col("l_quantity")), F.when(number == 1, "broken"), F.when(number == 4, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")), number == 2).alias("status"),
        S.merged_family(name, {"n": "own"}).alias("family"),
    )


@query("rename_terms", "SELECT s_suppkey AS item, json_object('new_a', s_suppkey, 'b', json_object('new_c', 'new_x'), 'd', json_array('new_y', 'old')) AS record FROM supplier")
def rename_terms(spark, d):
    s = B.read(spark, d, "supplier")
    text = F.concat(F.lit('{"v3_a":'), F.col("s_suppkey").cast("string"), F.lit(',"b":{"v3_c":"v3_x"},"d":["v3_y","old"]}'))
    return s.select(F.col("s_suppkey").alias("item"), S.rename_record(text, "v3_", "new_").alias("record"))


@query("largest_weights", "SELECT concat('t', s_suppkey) AS name, round(s_acctbal, 2) AS weight FROM supplier ORDER BY abs(round(s_acctbal, 2)) DESC, name LIMIT 30")
def largest_weights(spark, d):
    return linear.largest_weights(_supplier_model(spark, d).select("name", "weight"), 30)


@query("label_table", "SELECT c_custkey AS key, CASE WHEN c_custkey % 20 = 0 THEN 'worker_error' ELSE 'success' END AS status, CASE WHEN c_custkey % 20 <> 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS value, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS attempt FROM customer")
def label_table(spark, d):
    """A first attempt that fails on every tenth key, a second that fails on every twentieth; the latest result of each key."""
    manifest = B.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("item"))
    path = shared_folder(spark, "labels")

    def failing(n):
        def evaluate(item):
            if item % n == 0:
                raise ValueError("no value")
            return item % 7

        return evaluate

    labelling.label_table(manifest, path, failing(10), ["key"], 1, 2)
    found = labelling.label_table(manifest, path, failing(20), ["key"], 2, 2, retry=True)
    return prep.upsert(found.select("key", "status", "value", "attempt"), ["key"], "attempt")
