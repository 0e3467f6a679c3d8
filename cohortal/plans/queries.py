"""Registered queries: each operator over the driver's whole tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.functions import hashing as H
from cohortal.functions import scalars as S
from cohortal.operators import cohort, enrich, graph, linear, margins, metrics, motifs, nearest, nested, prep, reactions, resampling, studies
from cohortal.operators.loops import IN_PLACE, checkpointed
from cohortal.plans import bindings as B

QUERIES: dict = {}
SQL: dict = {}
R = 6  # digits that floating-point results are rounded to


#: Fixed names: queries all of whose joins are inside molecules, whose rows lie together (see bindings.kept).
IN_MOLECULES = frozenset("""graph_components cycle_rank degree_features zagreb environment_counts path_counts feature_families neighbourhood_labels
hashed_environments symmetry_terms symmetry_classes graph_identity assign_pi pi_systems pi_matrix spectral_moments charge_topology charge_decay
formal_charge_terms steric_terms ring_terms ring_strain ring_parity small_ring_terms ring_names exocyclic_bonds rotatable_bonds
resonance_terms localized_bonds local_signatures bond_inventory motif_terms rigid_pairs expand_orbitals""".split())


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            # joins by molecule and further columns leave rows where they are; a setting of the session until the next query is called
            spark.conf.set(IN_PLACE, "false" if name in IN_MOLECULES and B.small_molecules(spark, d) else "true")
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), R) + F.lit(0.0))
    return df


WEIGHTS = {"edges": 0.75, "doubles": -1.25, "closures": 0.4}
WEIGHTS_SQL = "w(name, weight) AS (VALUES ('edges', 0.75::DOUBLE), ('doubles', -1.25), ('closures', 0.4))"


# ---------------------------------------------------------------- scoring and ranking
def _scored_molecules(spark: SparkSession, d: str) -> DataFrame:
    items = prep.rankable_groups(B.mol_items(spark, d))
    return linear.score_linear(items, B.features(spark, d), linear.weights_frame(spark, WEIGHTS), 2.0)


_SCORED = f"""WITH {B.FEATURES}, {WEIGHTS_SQL},
good AS (SELECT grp FROM mol_items GROUP BY grp HAVING count(*) >= 3 AND count(DISTINCT label) >= 2),
s AS (SELECT f.item, sum(w.weight * f.value) AS s FROM features f JOIN w USING (name) GROUP BY 1),
scored AS (SELECT m.item, m.grp, m.label, coalesce(s.s, 0) + 2.0 AS prediction FROM mol_items m JOIN good USING (grp) LEFT JOIN s USING (item))"""


@query("score_and_rank", _SCORED + f""" SELECT item, grp, round(prediction, {R}) AS prediction,
  CAST(row_number() OVER (PARTITION BY grp ORDER BY round(prediction, {R}), item) AS INT) AS rank, round(round(prediction, {R}) - min(round(prediction, {R})) OVER (PARTITION BY grp), {R}) AS delta FROM scored""")
def score_and_rank(spark, d):
    scored = rounded(_scored_molecules(spark, d), "prediction")
    return rounded(linear.rank_group(scored), "delta").select("item", "grp", "prediction", "rank", "delta")


@query("linear_score", _SCORED + f" SELECT item, round(prediction, {R}) AS prediction FROM scored")
def linear_score(spark, d):
    return rounded(_scored_molecules(spark, d), "prediction").select("item", "prediction")


@query("top_contributions", f"""WITH {B.FEATURES}, {WEIGHTS_SQL}, c AS (SELECT f.item, f.name, w.weight * f.value AS value FROM features f JOIN w USING (name) WHERE abs(w.weight * f.value) > 1e-12),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY round(abs(value), 9) DESC, name) AS INT) AS place FROM c) SELECT item, name, round(value, {R}) AS value, place FROM r WHERE place <= 2""")
def top_contributions(spark, d):
    parts = linear.contributions(B.features(spark, d), linear.weights_frame(spark, WEIGHTS)).withColumn("value", F.round("value", 9))
    return rounded(linear.top_contributions(parts, 2), "value")


@query("full_prediction")
def full_prediction(spark, d):
    items, features = B.mol_items(spark, d), B.features(spark, d)
    counts = B.atoms(spark, d).groupBy(F.col("mol_id").alias("item"), "element").agg(F.count("*").alias("n"))
    moments = linear.feature_moments(items, features).select("name", "mean", "scale")
    element = spark.createDataFrame([("C", -2.0), ("N", -1.5), ("O", -3.0), ("S", -0.5)], "element string, weight double")
    ranges = spark.createDataFrame([("C", 0, 4), ("N", 0, 4), ("O", 0, 4), ("S", 0, 4)], "element string, lo long, hi long")
    out = linear.predict(items, counts, features, {"intercept": 1.5, "q99": 2.0}, element, linear.weights_frame(spark, WEIGHTS), moments, ranges)
    return rounded(out, "composition", "connectivity", "prediction", "distance").select("item", "composition", "connectivity", "prediction", "distance", F.array_join("warnings", ";").alias("warnings"))


SQL["full_prediction"] = f"""WITH {B.FEATURES}, {WEIGHTS_SQL}, n AS (SELECT count(*) AS n FROM mol_items),
mo AS (SELECT name, sum(value) / n AS mean, CASE WHEN sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) > 1e-12 THEN sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) ELSE 1 END AS scale FROM features, n GROUP BY name, n),
grid AS (SELECT m.item, mo.*, coalesce(f.value, 0) AS value FROM mol_items m CROSS JOIN mo LEFT JOIN features f ON f.item = m.item AND f.name = mo.name),
t AS (SELECT item, sum(coalesce(w.weight, 0) * value) AS connectivity, sqrt(avg(((value - mean) / scale) ** 2)) AS distance FROM grid LEFT JOIN w USING (name) GROUP BY item),
k AS (SELECT mol_id AS item, 1.5 + sum(CASE element WHEN 'C' THEN -2.0 WHEN 'N' THEN -1.5 WHEN 'O' THEN -3.0 ELSE -0.5 END) AS composition FROM atoms GROUP BY 1),
o AS (SELECT item, max(n) > 4 AS outside FROM (SELECT mol_id AS item, element, count(*) AS n FROM atoms GROUP BY 1, 2) GROUP BY 1)
SELECT item, round(composition, {R})::DOUBLE AS composition, round(connectivity, {R}) AS connectivity, round(composition + connectivity, {R}) AS prediction, round(distance, {R}) AS distance,
  concat_ws(';', CASE WHEN distance > 2 THEN 'DISTANCE_OUTSIDE_Q99' END, CASE WHEN outside THEN 'COMPOSITION_OUTSIDE_RANGE' END) AS warnings
FROM mol_items JOIN t USING (item) JOIN k USING (item) JOIN o USING (item)"""


# ---------------------------------------------------------------- preparation
@query("reaction_components", f"WITH {B.RAW}, p AS (SELECT location, string_split(regexp_extract(trim(s), '^\\S+'), '>') AS parts FROM raw), u AS (SELECT location, unnest(['reactant', 'reagent', 'product']) AS side, unnest(parts) AS part FROM p WHERE len(parts) = 3), v AS (SELECT location, side, list_filter(list_transform(string_split(part, '.'), lambda x: trim(x)), lambda x: x <> '') AS list FROM u) SELECT location, side, unnest(list) AS component, CAST(generate_subscripts(list, 1) - 1 AS INT) AS position FROM v")
def reaction_components(spark, d):
    return prep.split_reactions(B.raw(spark, d)).select("location", "side", "component", "position")


@query("harvest_events", "SELECT trim(event_type) AS value, count(*) AS occurrences, min(event_id) AS first_event FROM events WHERE trim(event_type) <> '' GROUP BY 1")
def harvest_events(spark, d):
    out = prep.harvest(B.read(spark, d, "events"), "event_type", "event_id", "event_id")
    return out.select("value", "occurrences", F.col("example.event_id").alias("first_event"))


@query("dedupe_components", f"WITH {B.RAW} SELECT s AS value, count(*) AS occurrences, min(location) AS first_location FROM raw WHERE trim(s) <> '' GROUP BY 1")
def dedupe_components(spark, d):
    raw = B.raw(spark, d)
    half = [prep.harvest(raw.where(F.col("location") % 2 == k), "s", "location", "location") for k in (0, 1)]
    return prep.merge_counts(*half).select("value", "occurrences", F.col("example.location").alias("first_location"))


@query("merge_audits", "SELECT event_type AS counter, count(*) AS n FROM events GROUP BY 1")
def merge_audits(spark, d):
    per = B.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counters"))
    return prep.merge_audits(per)


@query("group_inventory", f"WITH {B.ATOMS}, {B.MOLECULES} SELECT formula, count(*) AS members, count(DISTINCT n_atoms) AS identities, CAST(sum(CASE WHEN label > 100 THEN 1 ELSE 0 END) AS BIGINT) AS eligible, sum(CASE WHEN label > 100 THEN 1 ELSE 0 END) >= 3 AS rankable FROM molecules GROUP BY 1")
def group_inventory(spark, d):
    return prep.group_inventory(B.molecules(spark, d), ["formula"], "n_atoms", F.col("label") > 100)


@query("group_size_distribution", f"WITH {B.ATOMS}, {B.MOLECULES} SELECT size, count(*) AS groups FROM (SELECT formula, count(*) AS size FROM molecules GROUP BY 1) GROUP BY 1")
def group_size_distribution(spark, d):
    return prep.size_distribution(B.molecules(spark, d), "formula")


@query("prep_totals", f"""WITH {B.ATOMS}, {B.MOLECULES}, g AS (SELECT formula, count(*) AS n FROM molecules GROUP BY 1)
SELECT CAST((SELECT count(*) FROM molecules) AS BIGINT) AS rows, CAST((SELECT count(*) FROM molecules WHERE label > 100) AS BIGINT) AS eligible, count(*) AS groups,
 CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS large_groups, CAST(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS BIGINT) AS rows_in_large, CAST((SELECT count(DISTINCT n_atoms) FROM molecules) AS BIGINT) AS identities FROM g""")
def prep_totals(spark, d):
    return prep.totals(B.molecules(spark, d), ["formula"], "n_atoms", F.col("label") > 100)


@query("connectivity_variants", "SELECT o_orderkey AS item, count(*) OVER (PARTITION BY o_custkey) AS variants, CASE WHEN o_totalprice > 100000 AND count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'ambiguous_identity' END AS variant_reason FROM orders")
def connectivity_variants(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey", (F.col("o_totalprice") > 100000).alias("eligible"))
    return prep.connectivity_variants(o, "o_custkey", "eligible").select("item", "variants", "variant_reason")


_REASONS = "concat_ws(';', CASE WHEN q < 0 THEN 'negative' END, CASE WHEN q > 0 THEN 'positive' END, CASE WHEN s > 0 THEN 'sulfur' END, CASE WHEN n > 9 THEN 'large' END)"
_REASONED = f"WITH {B.ATOMS}, r AS (SELECT mol_id, {_REASONS} AS reasons FROM (SELECT mol_id, sum(formal_charge) AS q, sum(CASE WHEN element = 'S' THEN 1 ELSE 0 END) AS s, count(*) AS n FROM atoms GROUP BY 1))"


def _reasoned(spark, d):
    per = B.atoms(spark, d).groupBy("mol_id").agg(F.sum("formal_charge").alias("q"), F.sum((F.col("element") == "S").cast("int")).alias("s"), F.count("*").alias("n"))
    found = S.reasons((F.col("q") < 0, "negative"), (F.col("q") > 0, "positive"), (F.col("s") > 0, "sulfur"), (F.col("n") > 9, "large"))
    return per.select("mol_id", F.array_join(found, ";").alias("reasons"))


@query("exclusion_reasons", _REASONED + " SELECT mol_id, reasons FROM r")
def exclusion_reasons(spark, d):
    return _reasoned(spark, d)


@query("reason_counts", _REASONED + " SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM r) WHERE reason <> '' GROUP BY 1 UNION ALL SELECT 'total_excluded', count(*) FROM r WHERE reasons <> ''")
def reason_counts(spark, d):
    return prep.reason_counts(_reasoned(spark, d), "reasons")


_CLEAN = "CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN c_custkey % 7 = 0 THEN 'seventh' END"


@query("label_cleaning", f"SELECT coalesce({_CLEAN}, 'kept') AS reason, count(*) AS n FROM customer GROUP BY 1")
def label_cleaning(spark, d):
    c = B.read(spark, d, "customer")
    rules = [(F.col("c_acctbal").isNull(), "missing"), (F.col("c_acctbal") < 0, "negative"), (F.col("c_mktsegment") == "MACHINERY", "segment"), (F.col("c_custkey") % 7 == 0, "seventh")]
    return prep.clean_labels(c, rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("drop_ambiguous", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def drop_ambiguous(spark, d):
    lines = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return prep.drop_ambiguous(lines, "l_orderkey", "l_linenumber")


@query("rankable_groups", f"WITH {B.ATOMS}, {B.MOLECULES} SELECT formula AS grp, count(*) AS n FROM molecules GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT label) >= 2")
def rankable_groups(spark, d):
    return prep.rankable_groups(B.mol_items(spark, d)).groupBy("grp").agg(F.count("*").alias("n"))


@query("group_ceiling", f"WITH {B.SCORED} SELECT item, grp FROM scored WHERE grp NOT IN (SELECT grp FROM scored GROUP BY 1 HAVING max(label) > 9950)")
def group_ceiling(spark, d):
    return prep.group_ceiling(B.items(spark, d), "label", 9950).select("item", "grp")


_SPLIT = "('0x' || substr(sha256('split: ' || grp), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


@query("drop_unseen_groups", f"""WITH {B.ATOMS}, {B.MOLECULES}, m AS (SELECT a.mol_id, a.element, formula AS grp FROM atoms a JOIN molecules USING (mol_id)), known AS (SELECT DISTINCT element FROM m WHERE mol_id % 97 = 0 AND element <> 'S')
SELECT mol_id AS item, grp FROM molecules_ WHERE grp NOT IN (SELECT grp FROM m WHERE mol_id % 97 <> 0 AND element NOT IN (SELECT element FROM known))""".replace("molecules_", "(SELECT mol_id, formula AS grp FROM molecules WHERE mol_id % 97 <> 0)"))
def drop_unseen_groups(spark, d):
    sets = B.atoms(spark, d).groupBy("mol_id").agg(F.collect_set("element").alias("elements")).join(B.molecules(spark, d), "mol_id").select(F.col("mol_id").alias("item"), F.col("formula").alias("grp"), "elements")
    training = sets.where("item % 97 = 0").withColumn("elements", F.filter("elements", lambda e: e != "S"))
    return prep.drop_unseen(sets.where("item % 97 <> 0"), training).select("item", "grp")


@query("firewall_regroup", """WITH e AS (SELECT c_custkey AS item, concat(CAST(c_nationkey AS VARCHAR), '|', c_mktsegment) AS grp, c_acctbal AS label, c_custkey % 1000 AS ident FROM customer WHERE c_nationkey >= 3 OR c_mktsegment = 'BUILDING'),
t AS (SELECT c_custkey % 1000 AS ident, concat(CAST(c_nationkey AS VARCHAR), '|', c_mktsegment) AS grp FROM customer WHERE c_nationkey < 2), f AS (SELECT * FROM e WHERE ident NOT IN (SELECT ident FROM t)),
g AS (SELECT grp FROM f GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT label) >= 2) SELECT item, grp FROM f JOIN g USING (grp) WHERE grp NOT IN (SELECT grp FROM t)""")
def firewall_regroup(spark, d):
    c = B.read(spark, d, "customer")
    rows = B.items(spark, d).join(c.select(F.col("c_custkey").alias("item"), "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 1000).alias("ident")), "item")
    evaluation, training = rows.where("c_nationkey >= 3 or c_mktsegment = 'BUILDING'"), rows.where("c_nationkey < 2")
    return prep.apply_firewall(evaluation, training, "ident").select("item", "grp")


@query("firewall_at_once", """WITH e AS (SELECT c_custkey AS item, concat(CAST(c_nationkey AS VARCHAR), '|', c_mktsegment) AS grp, c_custkey % 1000 AS ident FROM customer WHERE c_nationkey >= 3 OR c_mktsegment = 'BUILDING'),
t AS (SELECT c_custkey % 1000 AS ident, concat(CAST(c_nationkey AS VARCHAR), '|', c_mktsegment) AS grp FROM customer WHERE c_nationkey < 2) SELECT item, grp FROM e WHERE ident NOT IN (SELECT ident FROM t) AND grp NOT IN (SELECT grp FROM t)""")
def firewall_at_once(spark, d):
    c = B.read(spark, d, "customer")
    rows = B.items(spark, d).join(c.select(F.col("c_custkey").alias("item"), "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 1000).alias("ident")), "item")
    return prep.apply_firewall(rows.where("c_nationkey >= 3 or c_mktsegment = 'BUILDING'"), rows.where("c_nationkey < 2"), "ident", by_group_first=True).select("item", "grp")


@query("scaffold_unseen", """WITH r AS (SELECT c_custkey AS item, c_mktsegment AS grp, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 500 AS VARCHAR) END AS scaffold FROM customer), t AS (SELECT DISTINCT scaffold FROM r WHERE item % 3 = 0 AND scaffold <> ''), e AS (SELECT r.*, t.scaffold IS NOT NULL AS known FROM r LEFT JOIN t USING (scaffold) WHERE item % 3 <> 0)
SELECT item, scaffold <> '' AND NOT known AS unseen, bool_or(scaffold <> '') OVER (PARTITION BY grp) AND NOT bool_or(known) OVER (PARTITION BY grp) AS group_unseen FROM e""")
def scaffold_unseen(spark, d):
    c = B.read(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("grp"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise((F.col("c_custkey") % 500).cast("string")).alias("scaffold"))
    return prep.scaffold_unseen(c.where("item % 3 <> 0"), c.where("item % 3 = 0"), "scaffold").select("item", "unseen", "group_unseen")


@query("pending_rows", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def pending_rows(spark, d):
    return prep.pending_rows(B.read(spark, d, "documents").select("doc_id"), B.read(spark, d, "labels"), ["doc_id"])


@query("latest_event", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event(spark, d):
    return prep.upsert(B.read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# ---------------------------------------------------------------- scalar functions
@query("hash_functions", """SELECT c_custkey AS item, sha256('ns: ' || c_custkey || ': ' || c_mktsegment) AS digest, ('0x' || substr(sha256('ns: ' || c_custkey || ': ' || c_mktsegment), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS fraction,
 CAST(('0x' || substr(sha256('ns:' || c_custkey), 1, 8))::UBIGINT % 7 AS INT) AS bucket, CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::UBIGINT % 2147483647 AS BIGINT) AS seed, ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::UBIGINT::DOUBLE / 4294967295.0 AS record FROM customer""")
def hash_functions(spark, d):
    c, key = B.read(spark, d, "customer"), F.col("c_custkey")
    digest = H.stable_hash("ns", key, F.col("c_mktsegment"))
    return c.select(key.alias("item"), digest.alias("digest"), H.hash_fraction(digest).alias("fraction"), H.hash_bucket("ns", key.cast("string"), 7).alias("bucket"), H.item_seed(key).alias("seed"), H.record_fraction(key).alias("record"))


@query("hash_features", """WITH f AS (SELECT l_orderkey AS item, sha256(l_returnflag || '|' || l_linenumber) AS h FROM lineitem), b AS (SELECT item, CAST(('0x' || substr(h, 1, 16))::UBIGINT % 128 AS INT) AS bin, CASE WHEN ('0x' || substr(h, 17, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM f)
SELECT item, bin, sum(s) AS value FROM b GROUP BY 1, 2 HAVING sum(s) <> 0""")
def hash_features(spark, d):
    place, sign = H.signed_bin(F.concat_ws("|", "l_returnflag", F.col("l_linenumber").cast("string")), 128)
    found = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), place.alias("bin"), sign.alias("s"))
    return found.groupBy("item", "bin").agg(F.sum("s").alias("value")).where("value <> 0")


@query("parse_formula", f"WITH {B.ATOMS}, {B.MOLECULES} SELECT mol_id, element, CAST(sum(n) AS BIGINT) AS n FROM (SELECT mol_id, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1)) AS element, CAST(unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 2)) AS INT) AS n FROM molecules) GROUP BY 1, 2")
def parse_formula(spark, d):
    m = B.molecules(spark, d).select("mol_id", F.explode(S.formula_parts(F.col("formula"))).alias("p"))
    return m.groupBy("mol_id", F.col("p.element").alias("element")).agg(F.sum("p.n").alias("n"))


@query("hill_formula", f"""WITH {B.ATOMS}, c AS (SELECT mol_id, element, count(*) AS n FROM atoms GROUP BY 1, 2 UNION ALL SELECT mol_id, 'H', sum(total_hcount) FROM atoms GROUP BY 1 HAVING sum(total_hcount) > 0),
k AS (SELECT *, max(CASE WHEN element = 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY mol_id) AS carbon FROM c)
SELECT mol_id, string_agg(element || CASE WHEN n = 1 THEN '' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END, '' ORDER BY CASE WHEN carbon = 1 AND element = 'C' THEN 0 WHEN carbon = 1 AND element = 'H' THEN 1 ELSE 2 END, element) AS hill FROM k GROUP BY 1""")
def hill_formula(spark, d):
    counts = _composition(spark, d).groupBy("mol_id").agg(F.collect_list(F.struct("element", "n")).alias("counts"))
    return counts.select("mol_id", S.hill_formula(F.col("counts")).alias("hill"))


def _composition(spark, d):
    return graph.composition(B.atoms(spark, d))


@query("composition", f"WITH {B.ATOMS} SELECT mol_id, element, CAST(sum(n) AS BIGINT) AS n FROM (SELECT mol_id, element, 1 AS n FROM atoms UNION ALL SELECT mol_id, 'H', total_hcount FROM atoms) GROUP BY 1, 2 HAVING sum(n) > 0")
def composition(spark, d):
    return _composition(spark, d)


@query("composition_vector", f"WITH {B.ATOMS} SELECT mol_id, count(*) FILTER (element = 'C') AS c, count(*) FILTER (element = 'N') AS n, count(*) FILTER (element = 'O') AS o, count(*) FILTER (element = 'S') AS s, count(*) AS heavy, CAST(sum(CASE element WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8 ELSE 16 END) AS BIGINT) AS electrons, count(*) * count(*) AS heavy_square FROM atoms GROUP BY 1")
def composition_vector(spark, d):
    return graph.composition_features(B.atoms(spark, d), {"C": 6, "N": 7, "O": 8, "S": 16})


@query("finite_labels", "SELECT p_partkey AS item, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS label, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 10 = 0 THEN 'nonfinite_label' ELSE 'missing_label' END END AS reason FROM part")
def finite_labels(spark, d):
    p = B.read(spark, d, "part")
    text = F.when(F.col("p_partkey") % 10 == 0, "NaN").when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_retailprice").cast("string"))
    value, reason = S.finite_label(F.lit(None), text)
    return p.select(F.col("p_partkey").alias("item"), value.alias("label"), reason.alias("reason"))


# ---------------------------------------------------------------- cohorts
@query("hash_split", f"WITH {B.ITEMS}, s AS (SELECT item, grp, CASE WHEN {_SPLIT} < 0.2 THEN 'external' WHEN {_SPLIT} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'training' END AS split FROM items) SELECT split, count(DISTINCT grp) AS groups, count(*) AS items, count(DISTINCT item) AS identities FROM s GROUP BY 1")
def hash_split(spark, d):
    return cohort.split_summary(B.items(spark, d).withColumn("split", cohort.split_of(F.col("grp"))), "item")


@query("hash_folds", f"WITH {B.ITEMS} SELECT DISTINCT grp, CAST(('0x' || substr(sha256('outer-fold:' || grp), 1, 8))::UBIGINT % 5 AS INT) AS outer_fold, CAST(('0x' || substr(sha256('inner-fold-2:' || grp), 1, 8))::UBIGINT % 3 AS INT) AS inner_fold FROM items")
def hash_folds(spark, d):
    g = B.items(spark, d).select("grp").distinct()
    return g.select("grp", cohort.fold_of(F.col("grp")).alias("outer_fold"), cohort.fold_of(F.col("grp"), 3, 2).alias("inner_fold"))


_SAMPLE = f"{B.SCORED}, sampled AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY sha256('sample:' || grp || ':' || item), item) AS INT) AS place FROM scored QUALIFY place <= 10)"


def _sampled(spark, d):
    return cohort.sample_group(B.scored(spark, d), "sample")


@query("sample_groups", f"WITH {_SAMPLE} SELECT item, grp, place FROM sampled")
def sample_groups(spark, d):
    return _sampled(spark, d).select("item", "grp", "place")


@query("limit_groups", f"WITH {B.ITEMS}, g AS (SELECT DISTINCT grp FROM items), k AS (SELECT grp FROM g ORDER BY sha256('budget: ' || grp), grp LIMIT 20) SELECT item, grp FROM items WHERE grp IN (SELECT grp FROM k)")
def limit_groups(spark, d):
    return cohort.limit_groups(B.items(spark, d), "budget", 20).select("item", "grp")


@query("leakage_report", """WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' WHEN o_orderkey % 3 = 1 THEN 'b' ELSE 'c' END AS split, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS ident FROM orders),
v AS (SELECT DISTINCT 'customer' AS key, customer AS value, split FROM s UNION SELECT DISTINCT 'ident', ident, split FROM s) SELECT l.key, l.split AS left_split, r.split AS right_split, count(*) AS shared FROM v l JOIN v r ON l.key = r.key AND l.value = r.value AND l.split < r.split GROUP BY ALL""")
def leakage_report(spark, d):
    split = F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderkey") % 3 == 1, "b").otherwise("c")
    rows = B.read(spark, d, "orders").select(split.alias("split"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("ident"))
    return cohort.leakage_report(rows, ["customer", "ident"])


@query("tanimoto_pairs", f"""WITH {B.BITS}, n AS (SELECT item, count(*) AS n FROM bits GROUP BY 1), p AS (SELECT a.grp, a.item AS item_a, b.item AS item_b, count(*) AS k FROM bits a JOIN bits b ON a.grp = b.grp AND a.bit = b.bit AND a.item < b.item GROUP BY ALL)
SELECT p.grp, item_a, item_b, round(k / (x.n + y.n - k), {R}) AS similarity FROM p JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b""")
def tanimoto_pairs(spark, d):
    return cohort.tanimoto_pairs(B.bits(spark, d), digits=R)


_NEAREST = f"""WITH {B.BITS}, n AS (SELECT item, count(*) AS n FROM bits GROUP BY 1), p AS (SELECT q.item, r.item AS ref, count(*) AS k FROM bits q JOIN bits r ON q.bit = r.bit AND q.item <> r.item WHERE q.item % 5 = 0 AND r.item % 5 <> 0 GROUP BY ALL),
nearest AS (SELECT q.item, coalesce(max(k / (q.n + r.n - k)), 0) AS nearest FROM n q LEFT JOIN p ON p.item = q.item LEFT JOIN n r ON r.item = p.ref WHERE q.item % 5 = 0 GROUP BY 1)"""


def _nearest(spark, d):
    bits = B.bits(spark, d)
    return cohort.nearest_similarity(bits.where("item % 5 = 0"), bits.where("item % 5 <> 0"))


@query("nearest_similarity", _NEAREST + f" SELECT item, round(nearest, {R}) AS nearest FROM nearest")
def nearest_similarity(spark, d):
    return rounded(_nearest(spark, d), "nearest")


@query("nearest_by_group", _NEAREST + f" SELECT grp, round(min(nearest), {R}) AS minimum, round(quantile_cont(nearest, 0.5), {R}) AS median, round(max(nearest), {R}) AS maximum FROM nearest JOIN (SELECT DISTINCT item, grp FROM bits) USING (item) GROUP BY 1")
def nearest_by_group(spark, d):
    return rounded(nearest.group_nearest(_nearest(spark, d), B.bits(spark, d)), "minimum", "median", "maximum")


@query("similarity_strata", _NEAREST + f", g AS (SELECT grp, quantile_cont(nearest, 0.5) AS median FROM nearest JOIN (SELECT DISTINCT item, grp FROM bits) USING (item) GROUP BY 1) SELECT grp, round(median, {R}) AS median, CASE WHEN median <= 0.5 THEN 'far' WHEN median <= 0.7 THEN 'mid' ELSE 'near' END AS stratum FROM g")
def similarity_strata(spark, d):
    return rounded(cohort.similarity_strata(_nearest(spark, d), B.bits(spark, d)), "median")


@query("diverse_sample")
def diverse_sample(spark, d):
    return cohort.diverse_sample(B.bits(spark, d), 5)


_LINKED = "edges AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS link FROM lineitem WHERE l_extendedprice >= 50000)"


def _edges(spark, d):
    return B.read(spark, d, "lineitem").where("l_extendedprice >= 50000").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("link")).distinct()


@query("link_components", f"WITH RECURSIVE {_LINKED}, near AS (SELECT DISTINCT a.grp AS x, b.grp AS y FROM edges a JOIN edges b USING (link)), reach(x, y) AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y) SELECT x AS grp, min(y) AS comp FROM reach GROUP BY 1")
def link_components(spark, d):
    return cohort.link_components(_edges(spark, d))


@query("assign_components")
def assign_components(spark, d):
    """Suppliers linked by the dearest lines, which make many components."""
    lines = B.read(spark, d, "lineitem").where("l_quantity >= 50 and l_extendedprice >= 90000")
    found = cohort.link_components(lines.select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("link")).distinct())
    return cohort.assign_components(found, {"training": 0.7, "validation": 0.1, "external": 0.2})


@query("select_cohorts", f"""WITH {B.ATOMS}, {B.MOLECULES}, good AS (SELECT formula AS grp FROM molecules GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT label) >= 2 AND max(n_atoms) <= 9), k AS (SELECT grp FROM good ORDER BY sha256('budget: ' || grp), grp LIMIT 60),
r AS (SELECT grp, mol_id AS item, count(*) OVER (PARTITION BY grp) AS group_size_available, CAST(row_number() OVER (PARTITION BY grp ORDER BY sha256('cohort:' || grp || ':' || mol_id), mol_id) AS INT) AS selection_rank FROM molecules JOIN k ON k.grp = formula)
SELECT CASE WHEN {_SPLIT} < 0.2 THEN 'external' WHEN {_SPLIT} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'training' END AS split, grp, item, selection_rank, group_size_available FROM r WHERE selection_rank <= 10""")
def select_cohorts(spark, d):
    m = B.molecules(spark, d).select(F.col("mol_id").alias("item"), F.col("formula").alias("grp"), "label", "n_atoms")
    return cohort.select_cohorts(m)


@query("stable_support", """WITH s AS (SELECT DISTINCT l_linenumber % 3 AS fold, l_partkey AS name FROM lineitem WHERE l_quantity > 40) SELECT CAST(name AS VARCHAR) AS name FROM s GROUP BY 1 HAVING count(DISTINCT fold) = 3""")
def stable_support(spark, d):
    s = B.read(spark, d, "lineitem").where("l_quantity > 40").select((F.col("l_linenumber") % 3).alias("fold"), F.col("l_partkey").cast("string").alias("name"))
    return cohort.stable_support(s, 3)


@query("compare_support", """WITH o AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_returnflag = 'A') SELECT change, count(*) AS n FROM (SELECT CASE WHEN n.name IS NULL THEN 'dropped' WHEN o.name IS NULL THEN 'new' ELSE 'retained' END AS change FROM o FULL OUTER JOIN n ON o.name = n.name) GROUP BY 1""")
def compare_support(spark, d):
    lines = B.read(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), "l_returnflag")
    return cohort.compare_support(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")).groupBy("change").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics
_RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY label) + (count(*) OVER (PARTITION BY grp, label) - 1) / 2 AS rl, rank() OVER (PARTITION BY grp ORDER BY prediction) + (count(*) OVER (PARTITION BY grp, prediction) - 1) / 2 AS rp FROM {src})"
_CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("average_rank", f"WITH {B.ITEMS} SELECT item, rank() OVER (PARTITION BY grp ORDER BY label) + (count(*) OVER (PARTITION BY grp, label) - 1) / 2 AS rank FROM items")
def average_rank(spark, d):
    return B.items(spark, d).select("item", metrics.avg_rank("label", "grp").alias("rank"))


@query("numeric_profile", f"SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), {R}) AS mean, round(stddev_samp(c_acctbal), {R}) AS std, min(c_acctbal) AS min, " + ", ".join(f"round(quantile_cont(c_acctbal, {q}), {R}) AS {n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.95, "q95"))) + ", max(c_acctbal) AS max FROM customer GROUP BY 1")
def numeric_profile(spark, d):
    return rounded(metrics.profile(B.read(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "mean", "std", "q05", "q25", "median", "q75", "q95")


@query("regression_metrics", f"""WITH {B.SCORED}, {_RANKED.format(src='scored')} SELECT grp, count(*) AS n, round(avg(abs(prediction - label)), {R}) AS mae, round(sqrt(avg((prediction - label) ** 2)), {R}) AS rmse, round(quantile_cont(abs(prediction - label), 0.5), {R}) AS median_abs_error,
 round(1 - sum((prediction - label) ** 2) / nullif(var_pop(label) * count(*), 0), {R}) AS r2, round({_CORR.format(x='label', y='prediction')}, {R}) AS pearson, round({_CORR.format(x='rl', y='rp')}, {R}) AS spearman, round(avg(prediction - label), {R}) AS mean_signed_error FROM ranked GROUP BY 1""")
def regression_metrics(spark, d):
    return rounded(metrics.regression_metrics(B.scored(spark, d), "grp"), "mae", "rmse", "median_abs_error", "r2", "pearson", "spearman", "mean_signed_error")


_RANK_SQL = f"""WITH {B.SCORED}, {_RANKED.format(src='scored')},
flags AS (SELECT *, label <= min(label) OVER (PARTITION BY grp) + {{near}} AS bl, prediction <= min(prediction) OVER (PARTITION BY grp) + {{near}} AS bp FROM ranked),
per AS (SELECT grp, count(*) AS size, {_CORR.format(x='label', y='prediction')} AS pearson, {_CORR.format(x='rl', y='rp')} AS spearman, {{top}} AS top1 FROM flags GROUP BY 1),
conc AS (SELECT a.grp, avg(CASE WHEN (a.prediction - b.prediction) * (a.label - b.label) > 0 THEN 1.0 WHEN (a.prediction - b.prediction) * (a.label - b.label) = 0 THEN 0.5 ELSE 0.0 END) AS concordance FROM scored a JOIN scored b ON a.grp = b.grp AND a.item < b.item GROUP BY 1),
found AS (SELECT per.grp, size, pearson, spearman, concordance, CAST(top1 AS DOUBLE) AS top1 FROM per LEFT JOIN conc ON per.grp = conc.grp {{keep}})"""
_SHARE = "sum(CASE WHEN bl AND bp THEN 1 ELSE 0 END) / sum(CASE WHEN bp THEN 1 ELSE 0 END)"
_FIRST = "CASE WHEN first(item ORDER BY prediction, item) = first(item ORDER BY label, item) THEN 1 ELSE 0 END"
_MODES = {"tie_aware": (metrics.TIE, _SHARE, ""), "keep_ties": (0, _SHARE, ""), "drop_undefined": (metrics.TIE, _FIRST, "WHERE pearson IS NOT NULL AND spearman IS NOT NULL")}
_COLUMNS = f"SELECT grp, size, round(pearson, {R}) AS pearson, round(spearman, {R}) AS spearman, round(concordance, {R}) AS concordance, round(top1, {R}) AS top1 FROM found"


def _rank_query(mode):
    return lambda spark, d: rounded(metrics.rank_metrics(B.scored(spark, d), mode), "pearson", "spearman", "concordance", "top1")


for _mode, (_near, _top, _keep) in _MODES.items():
    query(f"rank_metrics_{_mode}", _RANK_SQL.format(near=_near, top=_top, keep=_keep) + " " + _COLUMNS)(_rank_query(_mode))

_SUMMARY = f"""count(*) AS groups, CAST(sum(size) AS BIGINT) AS items, round(avg(pearson), {R}) AS pearson, round(sum(size * pearson) / sum(CASE WHEN pearson IS NOT NULL THEN size END), {R}) AS pearson_weighted, round(avg(CASE WHEN pearson > 0 THEN 1.0 WHEN pearson IS NOT NULL THEN 0.0 END), {R}) AS pearson_positive,
 round(avg(spearman), {R}) AS spearman, round(sum(size * spearman) / sum(CASE WHEN spearman IS NOT NULL THEN size END), {R}) AS spearman_weighted, round(avg(concordance), {R}) AS concordance, round(avg(top1), {R}) AS top1, round(avg(1 / size), {R}) AS chance_top1"""
_TIE_AWARE = _RANK_SQL.format(near=metrics.TIE, top=_SHARE, keep="")
_MEANS = ("pearson", "pearson_weighted", "pearson_positive", "spearman", "spearman_weighted", "concordance", "top1", "chance_top1")


@query("summarize_groups", f"{_TIE_AWARE} SELECT {_SUMMARY}, round((avg(pearson) + avg(spearman)) / 2, {R}) AS composite FROM found")
def summarize_groups(spark, d):
    return rounded(metrics.composite(metrics.summarize_groups(metrics.rank_metrics(B.scored(spark, d)))), *_MEANS, "composite")


@query("stratified_metrics", f"""{_TIE_AWARE}, strata AS (SELECT *, unnest(list_filter([CASE WHEN size < 12 THEN 'small' END, CASE WHEN size = 12 THEN 'twelve' END, CASE WHEN grp LIKE '%BUILDING' THEN 'building' END, CASE WHEN pearson > 0.9 THEN 'inside' ELSE 'outside' END], lambda x: x IS NOT NULL)) AS stratum FROM found) SELECT stratum, {_SUMMARY} FROM strata GROUP BY 1""")
def stratified_metrics(spark, d):
    found = metrics.rank_metrics(B.scored(spark, d))
    strata = {"small": F.col("size") < 12, "twelve": F.col("size") == 12, "building": F.col("grp").endswith("BUILDING"), "inside": F.col("pearson") > 0.9, "outside": ~F.coalesce(F.col("pearson") > 0.9, F.lit(False))}
    return rounded(metrics.summarize_groups(metrics.stratify(found, strata), "stratum"), *_MEANS)


_BY_CUSTOMER = "by_customer AS (SELECT o_custkey AS grp, o_orderkey AS item, o_totalprice / 1000 AS label, o_totalprice / 2000 + sqrt(CAST(o_orderkey AS DOUBLE)) AS prediction FROM orders)"


def _by_customer(spark, d):
    """Orders in groups of one customer, which are small however many there are."""
    o = B.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 1000).alias("label"), (F.col("o_totalprice") / 2000 + F.sqrt(F.col("o_orderkey").cast("double"))).alias("prediction"))


@query("group_pairs", f"WITH {_BY_CUSTOMER} SELECT a.grp, a.item AS item_a, b.item AS item_b, round(a.label - b.label, {R}) + 0.0 AS label_gap FROM by_customer a JOIN by_customer b ON a.grp = b.grp AND a.item < b.item")
def group_pairs(spark, d):
    return rounded(metrics.pairs(_by_customer(spark, d)).select("grp", "item_a", "item_b", (F.col("label_a") - F.col("label_b")).alias("label_gap")), "label_gap")


@query("margin_quintiles", f"""WITH {B.SCORED}, p AS (SELECT abs(a.prediction - b.prediction) AS margin, CASE WHEN (a.prediction - b.prediction) * (a.label - b.label) > 0 THEN 1.0 WHEN (a.prediction - b.prediction) * (a.label - b.label) = 0 THEN 0.5 ELSE 0.0 END AS ok FROM scored a JOIN scored b ON a.grp = b.grp AND a.item < b.item),
e AS (SELECT quantile_cont(margin, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM p), b AS (SELECT CAST(len(list_filter(e[2:5], lambda x: margin >= x)) AS INT) AS bin, margin, ok, e FROM p, e)
SELECT bin, round(any_value(e[bin + 1]), {R}) AS lower, round(any_value(e[bin + 2]), {R}) AS upper, count(*) AS n, round(avg(margin), {R}) AS mean_margin, round(avg(ok), {R}) AS correctness FROM b GROUP BY 1""")
def margin_quintiles(spark, d):
    return rounded(margins.margin_bins(B.scored(spark, d)), "lower", "upper", "mean_margin", "correctness")


@query("paired_delta", f"WITH {B.SCORED}, a AS (SELECT grp, avg(abs(label - prediction)) AS mae FROM scored GROUP BY 1), b AS (SELECT grp, avg(abs(label)) AS mae FROM scored WHERE item % 2 = 0 GROUP BY 1) SELECT grp, round(a.mae - b.mae, {R}) AS mae FROM a JOIN b USING (grp)")
def paired_delta(spark, d):
    s = B.scored(spark, d)
    a = s.groupBy("grp").agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"))
    b = s.where("item % 2 = 0").groupBy("grp").agg(F.avg(F.abs("label")).alias("mae"))
    return rounded(metrics.paired_delta(a, b, "mae"), "mae")


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    per = B.scored(spark, d).groupBy("grp").agg(metrics.safe_corr("label", "prediction").alias("pearson"))
    return rounded(resampling.bootstrap_ci(per, "pearson"), "estimate", "low", "high")


@query("bootstrap_mae")
def bootstrap_mae(spark, d):
    per = B.scored(spark, d).groupBy("grp").agg(F.sum(F.abs(F.col("label") - F.col("prediction"))).alias("e"), F.count("*").alias("n"))
    return rounded(resampling.bootstrap_ci(per, "e", weight="n"), "estimate", "low", "high")


@query("bootstrap_rmse")
def bootstrap_rmse(spark, d):
    error = F.col("label") - F.col("prediction")
    per = B.scored(spark, d).groupBy("grp").agg(F.sum(error * error).alias("e"), F.count("*").alias("n"))
    return rounded(resampling.bootstrap_ci(per, "e", weight="n", root=True), "estimate", "low", "high")


@query("bootstrap_paired")
def bootstrap_paired(spark, d):
    """The RMSE of the prediction less that of the group's mean, over the same draws."""
    error = F.col("label") - F.col("prediction")
    per = B.scored(spark, d).groupBy("grp").agg(F.sum(error * error).alias("e"), (F.var_pop("label") * F.count("*")).alias("base"), F.count("*").alias("n"))
    return rounded(resampling.bootstrap_ci(per, "e", weight="n", root=True, versus="base"), "estimate", "low", "high")


@query("permutation_null")
def permutation_null(spark, d):
    return rounded(resampling.permutation_null(B.scored(spark, d)), "observed", "mean", "low", "high", "max", "p")


@query("metric_gates", f"{_TIE_AWARE}, s AS (SELECT avg(pearson) AS p, avg(top1) AS t, avg(1 / size) AS c FROM found) SELECT unnest(['correlates', 'beats_chance', 'all']) AS gate, unnest([p > 0.5, t > c, p > 0.5 AND t > c]) AS passed FROM s")
def metric_gates(spark, d):
    s = metrics.summarize_groups(metrics.rank_metrics(B.scored(spark, d)))
    return metrics.gates(s, {"correlates": F.col("pearson") > 0.5, "beats_chance": F.col("top1") > F.col("chance_top1")})


@query("modal_choice", "SELECT l_quantity, n FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, abs(log10(l_quantity) - log10(25.0)), l_quantity DESC LIMIT 1")
def modal_choice(spark, d):
    return metrics.modal(B.read(spark, d, "lineitem"), "l_quantity", 25.0)


@query("worst_groups", f"{_TIE_AWARE} SELECT grp, round(pearson, {R}) AS pearson FROM found WHERE pearson IS NOT NULL ORDER BY round(pearson, {R}), grp LIMIT 20")
def worst_groups(spark, d):
    return metrics.worst_groups(rounded(metrics.rank_metrics(B.scored(spark, d)), "pearson"), 20)


@query("worst_groups_by_rank", f"{_TIE_AWARE} SELECT grp, round(spearman, {R}) AS spearman FROM found WHERE spearman IS NOT NULL ORDER BY round(spearman, {R}), grp LIMIT 20")
def worst_groups_by_rank(spark, d):
    return metrics.worst_groups(rounded(metrics.rank_metrics(B.scored(spark, d)), "spearman"), 20, "spearman")


# ---------------------------------------------------------------- features and fits
@query("center_labels", f"WITH {B.ITEMS} SELECT item, round(label - avg(label) OVER (PARTITION BY grp), {R}) AS centered FROM items")
def center_labels(spark, d):
    return rounded(linear.center_labels(B.items(spark, d)), "centered").select("item", "centered")


_CENTERED = f"WITH {B.FEATURES}, sizes AS (SELECT grp, count(*) AS n FROM mol_items GROUP BY 1), means AS (SELECT f.grp, f.name, sum(value) / max(n) AS mean FROM features f JOIN sizes USING (grp) GROUP BY 1, 2), centered AS (SELECT m.item, m.grp, means.name, coalesce(f.value, 0) - mean AS value FROM mol_items m JOIN means USING (grp) LEFT JOIN features f ON f.item = m.item AND f.name = means.name)"


@query("center_features", _CENTERED + f" SELECT item, name, round(value, {R}) AS value FROM centered")
def center_features(spark, d):
    return rounded(linear.center_features(B.mol_items(spark, d), B.features(spark, d)), "value").select("item", "name", "value")


@query("feature_moments", f"WITH {B.FEATURES}, n AS (SELECT count(*) AS n FROM mol_items) SELECT name, round(sum(value) / n, {R}) AS mean, round(sqrt(sum(value * value) / n - (sum(value) / n) ** 2), {R}) AS scale, count(DISTINCT item) AS support FROM features, n GROUP BY name, n")
def feature_moments(spark, d):
    return rounded(linear.feature_moments(B.mol_items(spark, d), B.features(spark, d)), "mean", "scale")


@query("support_counts", f"WITH {B.FEATURES} SELECT name, count(DISTINCT item) AS items FROM features WHERE value <> 0 GROUP BY 1")
def support_counts(spark, d):
    return linear.support_counts(B.features(spark, d))


@query("gram_matrix", _CENTERED + " SELECT x.name AS a, y.name AS b, round(sum(x.value * y.value), 4) AS s FROM centered x JOIN centered y ON x.item = y.item AND x.name <= y.name GROUP BY 1, 2")
def gram_matrix(spark, d):
    g = linear.gram(linear.center_features(B.mol_items(spark, d), B.features(spark, d)))
    return g.select("a", "b", F.round("s", 4).alias("s"))


@query("group_distance", _CENTERED + f" SELECT item, round(sqrt(sum((value / 2.0) ** 2) / 3), {R}) AS distance FROM centered GROUP BY 1")
def group_distance(spark, d):
    scales = linear.weights_frame(spark, dict.fromkeys(WEIGHTS, 2.0)).withColumnRenamed("weight", "scale")
    return rounded(linear.group_distance(linear.center_features(B.mol_items(spark, d), B.features(spark, d)), scales), "distance")


@query("composition_ranges", f"WITH {B.ATOMS}, c AS (SELECT mol_id, element, count(*) AS n FROM atoms GROUP BY 1, 2), t AS (SELECT count(DISTINCT mol_id) AS t FROM atoms) SELECT element, CASE WHEN count(*) < t THEN least(min(n), 0) ELSE min(n) END AS lo, max(n) AS hi FROM c, t GROUP BY element, t")
def composition_ranges(spark, d):
    a = B.atoms(spark, d)
    counts = a.groupBy(F.col("mol_id").alias("item"), "element").agg(F.count("*").alias("n"))
    return linear.composition_ranges(a.select(F.col("mol_id").alias("item")).distinct(), counts)


@query("zero_information", f"WITH {B.ATOMS}, {B.MOLECULES}, c AS (SELECT m.mol_id, m.formula, count(*) FILTER (element = 'C') AS c FROM atoms a JOIN molecules m USING (mol_id) GROUP BY 1, 2) SELECT round(max(abs(c - m)), {R}) AS centered_max_abs FROM (SELECT c, avg(c) OVER (PARTITION BY formula) AS m FROM c)")
def zero_information(spark, d):
    c = B.atoms(spark, d).groupBy("mol_id").agg(F.sum((F.col("element") == "C").cast("int")).alias("c")).join(B.molecules(spark, d), "mol_id")
    return rounded(metrics.centred_most(c, "c", "formula"), "centered_max_abs")


def _fit_inputs(spark, d):
    return prep.rankable_groups(B.mol_items(spark, d)), B.features(spark, d)


#: Ridge on three terms in SQL: moments, columns scaled to unit deviation, and Cramer's rule. c: (item, x1, x2, x3, y), less the means.
_THREE = """m AS (SELECT count(*) AS n, sum(x1 * x1) AS a11, sum(x2 * x2) AS a22, sum(x3 * x3) AS a33, sum(x1 * x2) AS a12, sum(x1 * x3) AS a13, sum(x2 * x3) AS a23, sum(x1 * y) AS r1, sum(x2 * y) AS r2, sum(x3 * y) AS r3, sum(y * y) AS yy FROM c),
s AS (SELECT *, CASE WHEN a11 / n > 1e-18 THEN 1 / sqrt(a11 / n) ELSE 0 END AS s1, CASE WHEN a22 / n > 1e-18 THEN 1 / sqrt(a22 / n) ELSE 0 END AS s2, CASE WHEN a33 / n > 1e-18 THEN 1 / sqrt(a33 / n) ELSE 0 END AS s3 FROM m),
z AS (SELECT *, a11 * s1 * s1 + 1.0 AS p, a22 * s2 * s2 + 1.0 AS q, a33 * s3 * s3 + 1.0 AS r, a12 * s1 * s2 AS u, a13 * s1 * s3 AS v, a23 * s2 * s3 AS w, r1 * s1 AS b1, r2 * s2 AS b2, r3 * s3 AS b3 FROM s),
d AS (SELECT *, p * (q * r - w * w) - u * (u * r - w * v) + v * (u * w - q * v) AS det FROM z),
k AS (SELECT *, (b1 * (q * r - w * w) - u * (b2 * r - w * b3) + v * (b2 * w - q * b3)) / det * s1 AS w1, (p * (b2 * r - w * b3) - b1 * (u * r - w * v) + v * (u * b3 - b2 * v)) / det * s2 AS w2, (p * (q * b3 - b2 * w) - u * (u * b3 - b2 * v) + b1 * (u * w - q * v)) / det * s3 AS w3 FROM d)"""
_WIDE = "wide AS (SELECT i.item, i.grp, i.label AS y, coalesce(sum(CASE WHEN name = 'closures' THEN value END), 0) AS x1, coalesce(sum(CASE WHEN name = 'doubles' THEN value END), 0) AS x2, coalesce(sum(CASE WHEN name = 'edges' THEN value END), 0) AS x3 FROM {items} i LEFT JOIN features f USING (item) GROUP BY 1, 2, 3)"
_LESS = "c AS (SELECT item, " + ", ".join(f"{x} - avg({x}) OVER ({{by}}) AS {x}" for x in ("x1", "x2", "x3", "y")) + " FROM wide)"
_GROUP_FIT = f"""WITH {B.FEATURES}, good AS (SELECT grp FROM mol_items GROUP BY grp HAVING count(*) >= 3 AND count(DISTINCT label) >= 2), own AS (SELECT m.* FROM mol_items m JOIN good USING (grp)), {_WIDE.format(items='own')}, {_LESS.format(by='PARTITION BY grp')}, {_THREE}
SELECT unnest(['closures', 'doubles', 'edges']) AS name, round(unnest([w1, w2, w3]), {R}) AS weight FROM k"""
_PLAIN_FIT = f"""WITH {B.FEATURES}, {_WIDE.format(items='mol_items')}, {_LESS.format(by='')}, {_THREE}, e AS (SELECT avg(y) AS y, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM wide)
SELECT unnest(['closures', 'doubles', 'edges', 'intercept', 'residual_rmse']) AS name, round(unnest([w1, w2, w3, e.y - w1 * e.x1 - w2 * e.x2 - w3 * e.x3,
  sqrt((yy - 2 * (w1 * r1 + w2 * r2 + w3 * r3) + w1 * w1 * a11 + w2 * w2 * a22 + w3 * w3 * a33 + 2 * (w1 * w2 * a12 + w1 * w3 * a13 + w2 * w3 * a23)) / n)]), {R}) AS weight FROM k, e"""


@query("fit_group_ridge", _GROUP_FIT)
def fit_group_ridge(spark, d):
    items, features = _fit_inputs(spark, d)
    w = linear.weights_frame(spark, linear.fit_group_ridge(items, features.join(items.select("item").hint("merge"), "item", "left_semi"), 1.0))
    return rounded(w, "weight")


@query("predict_group_ridge", _CENTERED + f", {WEIGHTS_SQL} SELECT item, round(round(coalesce(sum(w.weight * value), 0), 9), {R}) AS prediction, round(coalesce(sqrt(sum((value / 2.0) ** 2) / 3), 0), {R}) AS distance FROM mol_items LEFT JOIN centered c USING (item) LEFT JOIN w USING (name) GROUP BY 1")
def predict_group_ridge(spark, d):
    scales = linear.weights_frame(spark, dict.fromkeys(WEIGHTS, 2.0)).withColumnRenamed("weight", "scale")
    out = linear.predict_group_ridge(B.mol_items(spark, d), B.features(spark, d), linear.weights_frame(spark, WEIGHTS), scales)
    # predictions that end in a half of the last digit kept are rounded twice, so that the order of a sum doesn't decide
    return rounded(out.withColumn("prediction", F.round("prediction", 9)), "prediction", "distance").select("item", "prediction", "distance")


@query("fit_composition")
def fit_composition(spark, d):
    counts = B.atoms(spark, d).groupBy(F.col("mol_id").alias("item"), "element").agg(F.count("*").alias("n"))
    return rounded(linear.weights_frame(spark, linear.fit_composition(B.mol_items(spark, d), counts)), "weight")


@query("fit_ridge", _PLAIN_FIT)
def fit_ridge(spark, d):
    intercept, weights, rmse = linear.fit_ridge(B.mol_items(spark, d), B.features(spark, d), 1.0)
    return rounded(linear.weights_frame(spark, weights | {"intercept": intercept, "residual_rmse": rmse}), "weight")


@query("lasso_support")
def lasso_support(spark, d):
    items, features = _fit_inputs(spark, d)
    s = linear.System.in_groups(features.join(items.select("item").hint("merge"), "item", "left_semi"), items, "label")
    return rounded(linear.weights_frame(spark, s.lasso(0.05)), "weight")


@query("tune_ridge")
def tune_ridge(spark, d):
    items, features = _fit_inputs(spark, d)
    return rounded(linear.tune_ridge(items, features.join(items.select("item").hint("merge"), "item", "left_semi"), [0.1, 1.0, 10.0]), "pearson", "spearman", "composite")


@query("refine_weights")
def refine_weights(spark, d):
    items = linear.score_linear(B.mol_items(spark, d), B.features(spark, d), linear.weights_frame(spark, WEIGHTS)).withColumn("residual", F.col("label") - F.col("prediction"))
    return rounded(linear.weights_frame(spark, linear.refine(items, B.features(spark, d).select("item", "name", "value"), "residual", 0.01)), "weight")


@query("ensemble", f"WITH {B.ITEMS}, m AS (SELECT item, 'a' AS member, label AS p, 1.0 AS dist, 1.0 AS w FROM items UNION ALL SELECT item, 'b', label * 2, item % 3, 3.0 FROM items) SELECT item, round(sum(p * w / 4), {R}) AS prediction, CAST(max(dist) AS DOUBLE) AS distance FROM m GROUP BY 1")
def ensemble(spark, d):
    i = B.items(spark, d)
    members = i.select(F.lit("a").alias("member"), "item", F.col("label").alias("prediction"), F.lit(1.0).alias("distance")).unionByName(i.select(F.lit("b").alias("member"), "item", (F.col("label") * 2).alias("prediction"), (F.col("item") % 3).cast("double").alias("distance")))
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "member string, weight double")
    return rounded(linear.ensemble_predict(members, w), "prediction")


# ---------------------------------------------------------------- graphs
_DIRECTED = "directed AS (SELECT mol_id, a, b, bond_order FROM bonds UNION ALL SELECT mol_id, b, a, bond_order FROM bonds)"
_DEG = "deg AS (SELECT mol_id, a AS atom_id, count(*) AS degree FROM directed GROUP BY 1, 2)"
_COMP = f"{B.ATOMS}, {B.PARTS}, {_DIRECTED}, reach(mol_id, x, y) AS (SELECT mol_id, atom_id, atom_id FROM atoms UNION SELECT r.mol_id, r.x, e.b FROM reach r JOIN directed e ON e.mol_id = r.mol_id AND e.a = r.y), comp AS (SELECT mol_id, x AS atom_id, min(y) AS comp FROM reach GROUP BY 1, 2)"


@query("graph_components", f"WITH RECURSIVE {_COMP} SELECT mol_id, atom_id, comp FROM comp")
def graph_components(spark, d):
    return graph.graph_components(B.atoms(spark, d), B.bonds(spark, d, several=True))


@query("cycle_rank", f"WITH RECURSIVE {_COMP}, c AS (SELECT mol_id, count(DISTINCT comp) AS k, count(*) AS n FROM comp GROUP BY 1), e AS (SELECT mol_id, count(*) AS e FROM bonds GROUP BY 1) SELECT mol_id, coalesce(e, 0) - n + k AS cycle_rank FROM c LEFT JOIN e USING (mol_id)")
def cycle_rank(spark, d):
    return graph.cycle_rank(B.atoms(spark, d), B.bonds(spark, d, several=True))


@query("normalize_graphs", f"WITH {B.ATOMS} SELECT mol_id, atom_id, CASE WHEN element = 'S' AND atom_id = 3 THEN 'UNSUPPORTED_ELEMENT' WHEN atom_id = 5 AND formal_charge = 1 THEN 'NONFINITE_PARTIAL_CHARGE' ELSE '' END AS warnings, CASE WHEN NOT (atom_id = 5 AND formal_charge = 1) THEN round(partial_charge, {R}) END AS partial_charge, formal_charge FROM atoms")
def normalize_graphs(spark, d):
    a = B.atoms(spark, d)
    odd = a.select("mol_id", "atom_id", F.when((F.col("element") == "S") & (F.col("atom_id") == 3), "Xx").otherwise(F.col("element")).alias("symbol"), F.col("formal_charge").cast("string").alias("charge"), F.when((F.col("atom_id") == 5) & (F.col("formal_charge") == 1) & ((F.col("element") != "S") | (F.col("atom_id") != 3)), F.lit(float("nan"))).otherwise(F.col("partial_charge")).alias("partial_charge"))
    return rounded(graph.normalize_atoms(odd), "partial_charge").select("mol_id", "atom_id", F.array_join("warnings", ";").alias("warnings"), "partial_charge", "formal_charge")


@query("normalize_bonds", f"WITH {B.ATOMS}, {B.BONDS} SELECT mol_id, a, b, CASE WHEN a % 3 = 0 THEN 1.0::DOUBLE ELSE bond_order END AS bond_order, CASE WHEN a % 3 = 0 THEN 'INVALID_BOND_ORDER' ELSE '' END AS warnings, bond_aromatic, false AS conjugated FROM bonds")
def normalize_bonds(spark, d):
    odd = F.when(F.col("a") % 9 == 0, "x").when(F.col("a") % 9 == 3, "-1").when(F.col("a") % 9 == 6, "NaN").otherwise(F.col("bond_order").cast("string"))
    found = graph.normalize_bonds(B.bonds(spark, d).select("mol_id", "a", "b", odd.alias("order"), "bond_aromatic"))
    return found.select("mol_id", "a", "b", "bond_order", F.array_join("warnings", ";").alias("warnings"), "bond_aromatic", "conjugated")


@query("degree_features", f"WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_DEG}, j AS (SELECT a.*, coalesce(degree, 0) AS degree FROM atoms a LEFT JOIN deg USING (mol_id, atom_id)) SELECT mol_id, count(*) AS atoms, CAST(sum(degree) / 2 AS BIGINT) AS bonds, CAST(sum(formal_charge) AS BIGINT) AS charge, CAST(sum(abs(formal_charge)) AS BIGINT) AS abs_charge, count(*) FILTER (aromatic) AS aromatic, " + ", ".join(f"count(*) FILTER (degree = {k}) AS degree_{k}" for k in range(1, 5)) + " FROM j GROUP BY 1")
def degree_features(spark, d):
    return graph.degree_features(B.atoms(spark, d), B.bonds(spark, d))


@query("zagreb", f"WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_DEG}, one AS (SELECT mol_id, CAST(sum(degree * degree) AS BIGINT) AS m1 FROM deg GROUP BY 1), two AS (SELECT e.mol_id, CAST(sum(x.degree * y.degree) AS BIGINT) AS m2, round(sum(1 / sqrt(x.degree * y.degree)), {R}) AS randic FROM bonds e JOIN deg x ON x.mol_id = e.mol_id AND x.atom_id = e.a JOIN deg y ON y.mol_id = e.mol_id AND y.atom_id = e.b GROUP BY 1) SELECT mol_id, m1, m2, randic FROM one JOIN two USING (mol_id)")
def zagreb(spark, d):
    return rounded(graph.zagreb(B.bonds(spark, d)), "randic")


_DIST = f"{B.ATOMS}, {B.BONDS}, {_DIRECTED}, walk(mol_id, a, b, d) AS (SELECT DISTINCT mol_id, a, b, 1 FROM directed UNION SELECT w.mol_id, w.a, e.b, d + 1 FROM walk w JOIN directed e ON e.mol_id = w.mol_id AND e.a = w.b WHERE d < 4), dist AS (SELECT mol_id, a, b, min(d) AS d FROM walk WHERE a < b GROUP BY 1, 2, 3)"


@query("shortest_paths", f"WITH RECURSIVE {_DIST} SELECT mol_id, a, b, CAST(d AS INT) AS d FROM dist")
def shortest_paths(spark, d):
    return graph.graph_distances(B.bonds(spark, d), 4)


@query("path_indices", f"WITH RECURSIVE {_DIST} SELECT mol_id, CAST(sum(d) AS BIGINT) AS wiener, round(sum(1 / d), {R}) AS harary, round(avg(d), {R}) AS mean_distance FROM dist GROUP BY 1")
def path_indices(spark, d):
    return rounded(graph.path_indices(graph.path_profile(B.bonds(spark, d), 4)), "harary", "mean_distance")


# no path of these molecules is longer than 40 bonds: the largest customer of any table has 41 orders at most
_WALK = "directed AS (SELECT mol_id, a, b FROM {bonds} UNION ALL SELECT mol_id, b, a FROM {bonds}), walk(mol_id, a, b, d) AS (SELECT mol_id, a, b, 1 FROM directed UNION SELECT w.mol_id, w.a, e.b, d + 1 FROM walk w JOIN directed e ON e.mol_id = w.mol_id AND e.a = w.b WHERE d < 40), dist AS (SELECT mol_id, a, b, min(d) AS d FROM walk WHERE a < b GROUP BY 1, 2, 3)"


@query("long_paths", f"WITH RECURSIVE {B.LONG}, {_WALK.format(bonds='bonds')} SELECT mol_id, a, b, CAST(d AS INT) AS d FROM dist")
def long_paths(spark, d):
    return graph.graph_distances(B.long_bonds(spark, d))


@query("long_path_indices", f"WITH RECURSIVE {B.LONG}, {_WALK.format(bonds='bonds')} SELECT mol_id, CAST(sum(d) AS BIGINT) AS wiener, round(sum(1 / d), {R}) AS harary, round(avg(d), {R}) AS mean_distance FROM dist GROUP BY 1")
def long_path_indices(spark, d):
    return rounded(graph.path_indices(graph.path_profile(B.long_bonds(spark, d))), "harary", "mean_distance")


@query("skeleton_indices", f"WITH RECURSIVE {B.LONG}, inner_bonds AS (SELECT e.mol_id, e.a, e.b FROM bonds e JOIN atoms x ON x.mol_id = e.mol_id AND x.atom_id = e.a AND x.element = 'C' JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = e.b AND y.element = 'C'), {_WALK.format(bonds='inner_bonds')}, per AS (SELECT mol_id, count(*) AS pairs, avg(d) AS mean_distance FROM dist GROUP BY 1) SELECT mol_id, coalesce(pairs, 0) AS pairs, round(coalesce(mean_distance, 0), {R}) AS mean_distance FROM (SELECT DISTINCT mol_id FROM atoms) LEFT JOIN per USING (mol_id)")
def skeleton_indices(spark, d):
    return rounded(graph.skeleton_indices(B.long_atoms(spark, d), B.long_bonds(spark, d)), "mean_distance")


_NAMED = "named AS (SELECT mol_id, atom_id, element, element || CASE WHEN aromatic THEN '*' ELSE '' END || 'h' || total_hcount || 'q' || formal_charge AS label FROM atoms)"


_ENV = f"""{B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_NAMED}, near AS (SELECT e.mol_id, e.a AS atom_id, string_agg(n.element, '.' ORDER BY n.element) AS near FROM directed e JOIN named n ON n.mol_id = e.mol_id AND n.atom_id = e.b GROUP BY 1, 2),
names AS (SELECT mol_id, 'atom_state[' || label || ']' AS name FROM named UNION ALL SELECT n.mol_id, 'benson_nn[' || element || '|' || coalesce(near, '') || ']' FROM named n LEFT JOIN near USING (mol_id, atom_id)
 UNION ALL SELECT e.mol_id, 'bond_environment[' || least(x.label, y.label) || ';' || CAST(bond_order AS INT) || ';' || greatest(x.label, y.label) || ']' FROM bonds e JOIN named x ON x.mol_id = e.mol_id AND x.atom_id = e.a JOIN named y ON y.mol_id = e.mol_id AND y.atom_id = e.b)"""


@query("environment_counts", f"WITH {_ENV} SELECT mol_id, name, count(*) AS n FROM names GROUP BY 1, 2")
def environment_counts(spark, d):
    return graph.env_counts(B.atoms(spark, d), B.bonds(spark, d))


_PATHS = """s AS (SELECT e.mol_id, a, b, x.element AS ea, y.element AS eb FROM directed e JOIN atoms x ON x.mol_id = e.mol_id AND x.atom_id = a JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = b),
p3 AS (SELECT s.mol_id, s.a, s.b, t.b AS c, s.ea, s.eb, t.eb AS ec FROM s JOIN s t ON t.mol_id = s.mol_id AND t.a = s.b WHERE s.a <> t.b),
p4 AS (SELECT p.*, t.b AS d, t.eb AS ed FROM p3 p JOIN s t ON t.mol_id = p.mol_id AND t.a = p.c WHERE t.b <> p.a AND t.b <> p.b),
paths AS (SELECT mol_id, 'path_1_3[' || least(ea || '|' || eb || '|' || ec, ec || '|' || eb || '|' || ea) || ']' AS name FROM p3 WHERE a < c UNION ALL SELECT mol_id, 'path_1_4[' || least(ea || '|' || eb || '|' || ec || '|' || ed, ed || '|' || ec || '|' || eb || '|' || ea) || ']' FROM p4 WHERE a < d)"""


@query("path_counts", f"WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_PATHS} SELECT mol_id, name, count(*) AS n FROM paths GROUP BY 1, 2")
def path_counts(spark, d):
    return graph.path_counts(B.atoms(spark, d), B.bonds(spark, d))


@query("feature_families", f"WITH {_ENV}, {_PATHS}, every AS (SELECT DISTINCT name FROM (SELECT name FROM names UNION ALL SELECT name FROM paths)) SELECT CASE WHEN name LIKE 'atom_state[%' THEN 'atom_state' WHEN name LIKE 'bond_environment[%' THEN 'bond_environment' ELSE 'other_named_term' END AS family, NOT regexp_matches(name, '^(path_1_3|path_1_4|benson_nn|inactive_empirical)\\[') AS compact, count(*) AS terms FROM every GROUP BY 1, 2")
def feature_families(spark, d):
    atoms, bonds = B.atoms(spark, d), B.bonds(spark, d)
    counts = graph.env_counts(atoms, bonds).select("name").union(graph.path_counts(atoms, bonds).select("name")).distinct()
    kept = counts.withColumn("family", S.feature_family(F.col("name"))).withColumn("compact", S.is_compact(F.col("name")))
    return kept.groupBy("family", "compact").agg(F.count("*").alias("terms"))


_WL0 = f"{B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_NAMED}, wl0 AS (SELECT mol_id, atom_id, sha256(label) AS label FROM named)"
_WLN = "around{k} AS (SELECT e.mol_id, e.a AS atom_id, string_agg(CAST(bond_order AS INT) || ':' || label, ',' ORDER BY CAST(bond_order AS INT) || ':' || label) AS around FROM directed e JOIN wl{j} w ON w.mol_id = e.mol_id AND w.atom_id = e.b GROUP BY 1, 2), wl{k} AS (SELECT w.mol_id, w.atom_id, sha256(label || ',' || coalesce(around, '')) AS label FROM wl{j} w LEFT JOIN around{k} r USING (mol_id, atom_id))"
_WL2 = f"{_WL0}, {_WLN.format(k=1, j=0)}, {_WLN.format(k=2, j=1)}"


def _labels(spark, d):
    return graph.neighbourhood_labels(B.atoms(spark, d), B.bonds(spark, d), 2)


@query("neighbourhood_labels", f"WITH {_WL2.replace('wl1 AS (', 'wl1 AS MATERIALIZED (').replace('wl0 AS (', 'wl0 AS MATERIALIZED (')} SELECT mol_id, atom_id, label FROM wl2")
def neighbourhood_labels(spark, d):
    return _labels(spark, d)


@query("hashed_environments", f"WITH {_WL2}, b AS (SELECT mol_id, 'wl_' || lpad(CAST(('0x' || substr(sha256(label), 1, 16))::UBIGINT % 128 AS VARCHAR), 3, '0') AS name, CASE WHEN ('0x' || substr(sha256(label), 17, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM wl2) SELECT mol_id, name, sum(s) AS value FROM b GROUP BY 1, 2 HAVING sum(s) <> 0")
def hashed_environments(spark, d):
    return graph.hashed_environments(_labels(spark, d))


# rounds go on while a class of the molecule splits; its last round has as many classes as the one before
_SETTLED = f"""WITH RECURSIVE {B.ATOMS}, {B.BONDS}, {_DIRECTED.replace('directed AS (', 'directed AS MATERIALIZED (')}, {_NAMED.replace('named AS (', 'named AS MATERIALIZED (')},
wl(round, mol_id, atom_id, label, classes, before) AS (SELECT 0, mol_id, atom_id, label, count(DISTINCT label) OVER (PARTITION BY mol_id), 0::BIGINT FROM (SELECT mol_id, atom_id, sha256(coalesce(label, '')) AS label FROM named)
 UNION ALL SELECT round, mol_id, atom_id, label, count(DISTINCT label) OVER (PARTITION BY mol_id), before FROM (
  SELECT w.round + 1 AS round, w.mol_id, w.atom_id, w.classes AS before, sha256(w.label || ',' || coalesce(r.around, '')) AS label FROM wl w LEFT JOIN (
   SELECT e.mol_id, e.a AS atom_id, string_agg(CAST(bond_order AS INT) || ':' || v.label, ',' ORDER BY CAST(bond_order AS INT) || ':' || v.label) AS around FROM directed e JOIN wl v ON v.mol_id = e.mol_id AND v.atom_id = e.b GROUP BY 1, 2) r
  ON r.mol_id = w.mol_id AND r.atom_id = w.atom_id WHERE w.classes > w.before)),
settled AS (SELECT mol_id, atom_id, label FROM wl WHERE classes = before)"""


@query("symmetry_terms", f"{_SETTLED}, c AS (SELECT mol_id, label, count(*) AS n FROM settled GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY mol_id) AS p FROM c) SELECT mol_id, count(*) AS classes, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS equivalent_pairs, round(-sum(p * ln(p)), {R}) + 0.0 AS entropy FROM t GROUP BY 1")
def symmetry_terms(spark, d):
    return rounded(graph.stable_symmetry(B.atoms(spark, d), B.bonds(spark, d)), "entropy")


# eight rounds: an order has fewer than ten lines, and each round before the last splits a class
_STABLE = f"{B.ATOMS}, {B.BONDS}, {_DIRECTED}, degree AS (SELECT mol_id, a AS atom_id, count(*) AS degree FROM directed GROUP BY 1, 2), wl0 AS MATERIALIZED (SELECT mol_id, atom_id, sha256(concat_ws('|', element, total_hcount, formal_charge, aromatic, hybridization, coalesce(degree, 0))) AS label FROM atoms LEFT JOIN degree USING (mol_id, atom_id)), " + ", ".join(_WLN.format(k=k, j=k - 1).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") for k in range(1, 9))


@query("symmetry_classes", f"WITH {_STABLE}, c AS (SELECT mol_id, label, count(*) AS n FROM wl8 GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY mol_id) AS p FROM c) SELECT mol_id, count(*) AS classes, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS equivalent_pairs, round(-sum(p * ln(p)), {R}) + 0.0 AS entropy FROM t GROUP BY 1")
def symmetry_classes(spark, d):
    return rounded(graph.symmetry_terms(graph.stable_classes(B.atoms(spark, d), B.bonds(spark, d))), "entropy")


@query("graph_identity", f"WITH RECURSIVE {_WL2}, reach(mol_id, x, y) AS (SELECT mol_id, atom_id, atom_id FROM atoms UNION SELECT r.mol_id, r.x, e.b FROM reach r JOIN directed e ON e.mol_id = r.mol_id AND e.a = r.y), comp AS (SELECT mol_id, x AS atom_id, min(y) AS comp FROM reach GROUP BY 1, 2), parts AS (SELECT mol_id, comp, sha256(string_agg(label, ',' ORDER BY label)) AS part FROM wl2 JOIN comp USING (mol_id, atom_id) GROUP BY 1, 2) SELECT mol_id, sha256(string_agg(part, '.' ORDER BY part)) AS identity FROM parts GROUP BY 1")
def graph_identity(spark, d):
    return graph.graph_identity(_labels(spark, d), graph.graph_components(B.atoms(spark, d), B.bonds(spark, d)))


_PI = f"""{B.ATOMS}, {B.BONDS}, {_DIRECTED}, top AS (SELECT mol_id, a AS atom_id, max(bond_order) AS top FROM directed GROUP BY 1, 2),
pi AS (SELECT *, CASE reason WHEN 'aromatic_carbon' THEN 1 - formal_charge WHEN 'double_bond_carbon' THEN 1 - formal_charge WHEN 'pyrrole_like' THEN 2 WHEN 'anionic_nitrogen' THEN 2 WHEN 'pyridine_like' THEN 1 WHEN 'aromatic_donor' THEN 2 WHEN 'double_bond_hetero' THEN CASE WHEN formal_charge = -1 THEN 2 ELSE 1 END END::INT AS electrons FROM (
 SELECT a.*, top, CASE WHEN radical_electrons > 0 THEN 'open_shell' WHEN top >= 3 THEN 'triple_bond' WHEN aromatic AND element = 'C' THEN 'aromatic_carbon' WHEN aromatic AND element = 'N' THEN CASE WHEN total_hcount > 0 THEN 'pyrrole_like' WHEN formal_charge = -1 THEN 'anionic_nitrogen' ELSE 'pyridine_like' END WHEN aromatic THEN 'aromatic_donor' WHEN top >= 2 AND element = 'C' THEN 'double_bond_carbon' WHEN top >= 2 THEN 'double_bond_hetero' ELSE 'none' END AS reason
 FROM atoms a LEFT JOIN top USING (mol_id, atom_id))),
coupled AS (SELECT e.* FROM bonds e JOIN pi x ON x.mol_id = e.mol_id AND x.atom_id = e.a AND x.electrons IS NOT NULL JOIN pi y ON y.mol_id = e.mol_id AND y.atom_id = e.b AND y.electrons IS NOT NULL WHERE bond_aromatic OR conjugated OR bond_order >= 2),
inside AS (SELECT mol_id, a, b, bond_order FROM coupled UNION ALL SELECT mol_id, b, a, bond_order FROM coupled)"""


def _pi(spark, d):
    return graph.assign_pi(B.atoms(spark, d), B.bonds(spark, d))


@query("assign_pi", f"WITH {_PI} SELECT mol_id, atom_id, electrons IS NOT NULL AS included, coalesce(electrons, -1) AS electrons, reason, CASE WHEN reason IN ('open_shell', 'triple_bond') THEN 'unsupported' WHEN reason IN ('anionic_nitrogen', 'aromatic_donor', 'double_bond_hetero') THEN 'medium' ELSE 'high' END AS confidence FROM pi")
def assign_pi(spark, d):
    return _pi(spark, d).withColumn("electrons", F.coalesce("electrons", F.lit(-1)))


_SYSTEMS = f"{_PI}, reach(mol_id, x, y) AS (SELECT mol_id, atom_id, atom_id FROM pi WHERE electrons IS NOT NULL UNION SELECT r.mol_id, r.x, e.b FROM reach r JOIN inside e ON e.mol_id = r.mol_id AND e.a = r.y), sys AS (SELECT mol_id, x AS atom_id, min(y) AS system FROM reach GROUP BY 1, 2)"


@query("pi_systems", f"WITH RECURSIVE {_SYSTEMS} SELECT mol_id, system, count(*) AS sites, CAST(sum(electrons) AS BIGINT) AS electrons FROM sys JOIN pi USING (mol_id, atom_id) GROUP BY 1, 2")
def pi_systems(spark, d):
    atoms, bonds = B.atoms(spark, d), B.bonds(spark, d)
    return graph.pi_systems(graph.assign_pi(atoms, bonds), bonds, graph.molecule_sizes(atoms, bonds))


ALPHA, BETA = {"C": 0.0, "N": 0.5, "O": 1.0, "S": 0.4}, {1.0: -0.8, 2.0: -1.1}
_MATRIX = _SYSTEMS + ", matrix AS (SELECT mol_id, system, atom_id AS i, atom_id AS j, CAST(CASE element WHEN 'N' THEN 0.5 WHEN 'O' THEN 1.0 WHEN 'S' THEN 0.4 ELSE 0 END AS DOUBLE) AS value FROM pi JOIN sys USING (mol_id, atom_id) WHERE electrons IS NOT NULL UNION ALL SELECT e.mol_id, system, a, b, CAST(CASE WHEN bond_order = 1 THEN -0.8 WHEN bond_order = 2 THEN -1.1 END AS DOUBLE) FROM inside e JOIN sys ON sys.mol_id = e.mol_id AND sys.atom_id = e.a)"


@query("pi_matrix", f"WITH RECURSIVE {_MATRIX} SELECT mol_id, system, i, j, value FROM matrix")
def pi_matrix(spark, d):
    return graph.pi_matrix(_pi(spark, d), B.atoms(spark, d), B.bonds(spark, d), ALPHA, BETA)


@query("spectral_moments", f"""WITH RECURSIVE {_MATRIX}, sq AS (SELECT x.mol_id, x.system, x.i, y.j, sum(x.value * y.value) AS s FROM matrix x JOIN matrix y ON y.mol_id = x.mol_id AND y.i = x.j GROUP BY 1, 2, 3, 4),
n AS (SELECT mol_id, system, count(DISTINCT i) AS n FROM matrix GROUP BY 1, 2), m2 AS (SELECT mol_id, system, sum(s) AS v FROM sq WHERE i = j GROUP BY 1, 2),
m3 AS (SELECT s.mol_id, s.system, sum(s.s * m.value) AS v FROM sq s JOIN matrix m ON m.mol_id = s.mol_id AND m.i = s.j AND m.j = s.i GROUP BY 1, 2),
m4 AS (SELECT s.mol_id, s.system, sum(s.s * t.s) AS v FROM sq s JOIN sq t ON t.mol_id = s.mol_id AND t.i = s.j AND t.j = s.i GROUP BY 1, 2)
SELECT n.mol_id, round(sum(coalesce(m2.v, 0) / n) + 1e-9, 5) AS m2, round(sum(coalesce(m3.v, 0) / n) + 1e-9, 5) + 0.0 AS m3, round(sum(coalesce(m4.v, 0) / n) + 1e-9, 5) AS m4
FROM n LEFT JOIN m2 USING (mol_id, system) LEFT JOIN m3 USING (mol_id, system) LEFT JOIN m4 USING (mol_id, system) GROUP BY 1""")
def spectral_moments(spark, d):
    count = lambda df, name: df.groupBy("mol_id").agg(F.count("*").alias(name))
    both = count(B.atoms(spark, d), "n").join(count(B.bonds(spark, d), "m").hint("merge"), "mol_id", "left")
    sizes = both.select("mol_id", (F.col("n") + 2 * F.coalesce("m", F.lit(0))).alias("n"))  # an entry an atom and two a bond at most
    found = graph.spectral_moments(graph.pi_matrix(_pi(spark, d), B.atoms(spark, d), B.bonds(spark, d), ALPHA, BETA), sizes)
    return found.select("mol_id", *((F.round(F.col(m) + 1e-9, 5) + F.lit(0.0)).alias(m) for m in ("m2", "m3", "m4")))


@query("charge_topology", f"WITH RECURSIVE {_DIST} SELECT t.mol_id, CAST(d AS INT) AS d, round(sum(abs(x.partial_charge - y.partial_charge)), {R}) + 0.0 AS difference, round(sum(x.partial_charge * y.partial_charge), {R}) + 0.0 AS product FROM dist t JOIN atoms x ON x.mol_id = t.mol_id AND x.atom_id = a JOIN atoms y ON y.mol_id = t.mol_id AND y.atom_id = b GROUP BY 1, 2")
def charge_topology(spark, d):
    return rounded(graph.charge_topology(B.atoms(spark, d), graph.graph_distances(B.bonds(spark, d), 4)), "difference", "product")


_EVERY_DIST = _DIST.replace("d < 4", "d < 16")  # orders have fewer lines than that


@query("charge_decay", f"""WITH RECURSIVE {_EVERY_DIST}, e AS (SELECT *, element IN ('N', 'O') AND total_hcount > 0 AS donor, element IN ('N', 'O') AND lone_pairs > 0 AS acceptor FROM atoms), p AS (SELECT t.mol_id, t.d, abs(x.partial_charge - y.partial_charge) AS diff, x.partial_charge * y.partial_charge AS prod, (x.donor AND y.acceptor) OR (y.donor AND x.acceptor) AS bridge FROM dist t JOIN e x ON x.mol_id = t.mol_id AND x.atom_id = t.a JOIN e y ON y.mol_id = t.mol_id AND y.atom_id = t.b),
s AS (SELECT mol_id, sum(diff / 2 ** d) AS dd, sum(prod / 2 ** d) AS dp, sum(CASE WHEN bridge AND d = 2 THEN diff ELSE 0 END) AS b2, sum(CASE WHEN bridge AND d = 3 THEN diff ELSE 0 END) AS b3, sum(CASE WHEN bridge AND d = 4 THEN diff ELSE 0 END) AS b4 FROM p GROUP BY 1),
c AS (SELECT t.mol_id, sum(CASE WHEN x.partial_charge * y.partial_charge < 0 AND abs(x.partial_charge) > 1e-12 AND abs(y.partial_charge) > 1e-12 THEN 1 ELSE 0 END) AS n FROM bonds t JOIN e x ON x.mol_id = t.mol_id AND x.atom_id = t.a JOIN e y ON y.mol_id = t.mol_id AND y.atom_id = t.b GROUP BY 1)
SELECT mol_id, round(coalesce(dd, 0), 12) + 0.0 AS decay_difference, round(coalesce(dp, 0), 12) + 0.0 AS decay_product, round(coalesce(b2, 0), 12) + 0.0 AS bridge_2, round(coalesce(b3, 0), 12) + 0.0 AS bridge_3, round(coalesce(b4, 0), 12) + 0.0 AS bridge_4, CAST(coalesce(n, 0) AS BIGINT) AS sign_changes FROM (SELECT DISTINCT mol_id FROM atoms) LEFT JOIN s USING (mol_id) LEFT JOIN c USING (mol_id)""")
def charge_decay(spark, d):
    polar = F.col("element").isin("N", "O")
    atoms = B.atoms(spark, d).withColumn("donor", polar & (F.col("total_hcount") > 0)).withColumn("acceptor", polar & (F.col("lone_pairs") > 0))
    bonds = B.bonds(spark, d)
    terms = graph.charge_decay(atoms, bonds, graph.graph_distances(bonds))
    return terms.select("mol_id", *((F.round(c, 12) + F.lit(0.0)).alias(c) for c in terms.columns[1:-1]), "sign_changes")


@query("formal_charge_terms", f"WITH RECURSIVE {_DIST}, o AS (SELECT mol_id, CAST(sum(abs(formal_charge)) AS BIGINT) AS magnitude, round(sum(formal_charge * formal_charge * CASE element WHEN 'C' THEN 5.0 WHEN 'N' THEN 7.2 WHEN 'O' THEN 6.1 ELSE 0 END), 6)::DOUBLE AS hardness FROM atoms GROUP BY 1), p AS (SELECT t.mol_id, sum(x.formal_charge * y.formal_charge / d) AS c, sum(CASE WHEN x.formal_charge * y.formal_charge > 0 THEN abs(x.formal_charge * y.formal_charge) / d ELSE 0 END) AS l, sum(CASE WHEN x.formal_charge * y.formal_charge < 0 THEN abs(x.formal_charge * y.formal_charge) / d ELSE 0 END) AS u FROM dist t JOIN atoms x ON x.mol_id = t.mol_id AND x.atom_id = a JOIN atoms y ON y.mol_id = t.mol_id AND y.atom_id = b WHERE x.formal_charge <> 0 AND y.formal_charge <> 0 GROUP BY 1) SELECT mol_id, magnitude, hardness, round(coalesce(c, 0), {R}) + 0.0 AS coulomb, round(coalesce(l, 0), {R}) AS \"like\", round(coalesce(u, 0), {R}) AS unlike FROM o LEFT JOIN p USING (mol_id)")
def formal_charge_terms(spark, d):
    return rounded(graph.formal_charge_terms(B.atoms(spark, d), graph.graph_distances(B.bonds(spark, d), 4), {"C": 5.0, "N": 7.2, "O": 6.1}), "hardness", "coulomb", "like", "unlike")


@query("steric_terms", f"WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, {_DEG}, r AS (SELECT mol_id, atom_id, CASE element WHEN 'C' THEN 1.7 WHEN 'N' THEN 1.55 WHEN 'O' THEN 1.52 ELSE 1.8 END::DOUBLE AS r FROM atoms), s AS (SELECT e.mol_id, a, b, r FROM directed e JOIN r ON r.mol_id = e.mol_id AND r.atom_id = e.b), c AS (SELECT x.mol_id, sum(x.r * y.r) AS crowding, count(*) AS np FROM s x JOIN s y ON y.mol_id = x.mol_id AND y.a = x.a AND x.b < y.b GROUP BY 1), t AS (SELECT mol_id, count(*) FILTER (degree = 3) AS tertiary, count(*) FILTER (degree >= 4) AS quaternary FROM deg GROUP BY 1), w AS (SELECT e.mol_id, count(*) FILTER (x.degree >= 3 AND y.degree >= 3) AS adj FROM bonds e JOIN deg x ON x.mol_id = e.mol_id AND x.atom_id = a JOIN deg y ON y.mol_id = e.mol_id AND y.atom_id = b GROUP BY 1) SELECT mol_id, tertiary, quaternary, adj AS adjacent_branches, round(coalesce(crowding, 0), {R}) AS crowding, coalesce(np, 0) AS neighbour_pairs FROM t JOIN w USING (mol_id) LEFT JOIN c USING (mol_id)")
def steric_terms(spark, d):
    return rounded(graph.steric_terms(B.atoms(spark, d), B.bonds(spark, d), {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}), "crowding")


ENERGY, HYDROGEN, FALLBACK = {("C", "C", 1): 3.6, ("C", "C", 2): 6.3, ("C", "N", 1): 3.2, ("C", "O", 1): 3.7, ("C", "O", 2): 7.7, ("N", "O", 1): 2.1}, {"C": 4.3, "N": 4.0, "O": 4.8}, 3.0


@query("bond_energy", f"WITH {B.ATOMS}, {B.BONDS}, t(x, y, o, e) AS (VALUES " + ", ".join(f"('{x}', '{y}', {o}.0::DOUBLE, {e}::DOUBLE)" for (x, y, o), e in ENERGY.items()) + f"), j AS (SELECT e.mol_id, least(p.element, q.element) AS x, greatest(p.element, q.element) AS y, bond_order AS o FROM bonds e JOIN atoms p ON p.mol_id = e.mol_id AND p.atom_id = a JOIN atoms q ON q.mol_id = e.mol_id AND q.atom_id = b), l AS (SELECT j.mol_id, coalesce(t.e, u.e, 3.0) AS e FROM j LEFT JOIN t USING (x, y, o) LEFT JOIN t u ON u.x = j.x AND u.y = j.y AND u.o = 1 UNION ALL SELECT mol_id, total_hcount * CASE element WHEN 'C' THEN 4.3 WHEN 'N' THEN 4.0 WHEN 'O' THEN 4.8 ELSE 3.0 END FROM atoms) SELECT mol_id, round(-sum(e), {R}) + 0.0 AS energy FROM l GROUP BY 1")
def bond_energy(spark, d):
    return rounded(graph.bond_energy(B.atoms(spark, d), B.bonds(spark, d), ENERGY, HYDROGEN, FALLBACK), "energy")


_RING = "rings AS (SELECT e.mol_id, e.a AS ring, e.a + k AS atom_id FROM bonds e, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE e.b = e.a + 3 AND (SELECT count(*) FROM bonds c WHERE c.mol_id = e.mol_id AND c.b = c.a + 1 AND c.a BETWEEN e.a AND e.a + 2) = 3)"
_RINGS = f"{B.ATOMS}, {B.BONDS}, {_RING}"
_RING_TERMS = _RINGS + ", sides AS (SELECT r.mol_id, r.ring, least(r.atom_id, q.atom_id) AS a, greatest(r.atom_id, q.atom_id) AS b FROM rings r JOIN rings q ON q.mol_id = r.mol_id AND q.ring = r.ring AND (q.atom_id = r.atom_id + 1 OR (r.atom_id = r.ring AND q.atom_id = r.ring + 3))), both_sides AS (SELECT x.mol_id, x.ring, y.ring AS other, count(*) AS sides FROM sides x JOIN sides y ON y.mol_id = x.mol_id AND y.a = x.a AND y.b = x.b AND x.ring < y.ring GROUP BY 1, 2, 3), n AS (SELECT mol_id, count(DISTINCT ring) AS rings FROM rings GROUP BY 1), jn AS (SELECT mol_id, count(*) AS junctions FROM (SELECT mol_id, atom_id FROM rings GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), sh AS (SELECT x.mol_id, x.ring, y.ring AS other, count(*) AS k FROM rings x JOIN rings y ON y.mol_id = x.mol_id AND y.atom_id = x.atom_id AND x.ring < y.ring GROUP BY 1, 2, 3), pr AS (SELECT mol_id, count(*) FILTER (k = 1) AS spiro, count(*) FILTER (k = 2 AND sides > 0) AS fused, count(*) FILTER (k >= 2 AND NOT (k = 2 AND coalesce(sides, 0) > 0)) AS bridged FROM sh LEFT JOIN both_sides USING (mol_id, ring, other) GROUP BY 1), cs AS (SELECT mol_id, count(*) AS shared_sides FROM (SELECT mol_id, a, b FROM sides GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1), terms AS (SELECT n.mol_id, rings, coalesce(junctions, 0) AS junctions, coalesce(spiro, 0) AS spiro, coalesce(fused, 0) AS fused, coalesce(bridged, 0) AS bridged, coalesce(shared_sides, 0) AS shared_sides FROM n LEFT JOIN jn USING (mol_id) LEFT JOIN pr USING (mol_id) LEFT JOIN cs USING (mol_id))"


@query("ring_terms", f"WITH {_RING_TERMS} SELECT * FROM terms")
def ring_terms(spark, d):
    return graph.ring_terms(graph.rings_of_closures(B.bonds(spark, d)))


@query("ring_strain", f"WITH {_RING_TERMS}, x AS (SELECT mol_id, sum(k - 1) AS extra FROM (SELECT mol_id, atom_id, count(*) AS k FROM rings GROUP BY 1, 2) GROUP BY 1) SELECT mol_id, round(rings * 1.1 + extra * 0.3, {R})::DOUBLE AS strain FROM terms JOIN x USING (mol_id)")
def ring_strain(spark, d):
    return rounded(graph.ring_strain(graph.rings_of_closures(B.bonds(spark, d)), {3: 1.2, 4: 1.1}, 0.3, 0.2), "strain")


@query("ring_parity", f"WITH {_PI}, {_RING}, t AS (SELECT r.mol_id, ring, count(*) AS size, bool_and(electrons IS NOT NULL) AS whole, sum(electrons) AS e FROM rings r JOIN pi USING (mol_id, atom_id) GROUP BY 1, 2), s AS (SELECT r.mol_id, r.ring, count(*) AS sides FROM (SELECT DISTINCT mol_id, ring FROM rings) r JOIN coupled c ON c.mol_id = r.mol_id AND c.a >= r.ring AND c.b <= r.ring + 3 AND (c.b = c.a + 1 OR (c.a = r.ring AND c.b = r.ring + 3)) GROUP BY 1, 2) SELECT t.mol_id, round(sum(CASE WHEN whole AND sides = size AND e > 0 AND e % 4 = 0 THEN size * 0.2 ELSE 0 END), {R})::DOUBLE AS penalty FROM t LEFT JOIN s USING (mol_id, ring) GROUP BY 1")
def ring_parity(spark, d):
    bonds = B.bonds(spark, d)
    return rounded(graph.pi_ring_parity(graph.rings_of_closures(bonds), _pi(spark, d), bonds, 0.2), "penalty")


@query("small_ring_terms", f"WITH {_RING_TERMS}, u AS (SELECT DISTINCT s.mol_id, s.ring FROM sides s JOIN bonds e ON e.mol_id = s.mol_id AND e.a = s.a AND e.b = s.b WHERE bond_aromatic OR bond_order >= 1.5), h AS (SELECT mol_id, count(*) AS heads FROM (SELECT mol_id, atom_id FROM rings GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1) SELECT r.mol_id, count(*) FILTER (u.ring IS NULL) AS saturated_small, count(*) FILTER (u.ring IS NOT NULL) AS unsaturated_small, 0::BIGINT AS medium, (4.0 * count(*))::DOUBLE AS size_deviation, 0.0::DOUBLE AS size_variance, coalesce(max(heads), 0) AS bridgeheads FROM (SELECT DISTINCT mol_id, ring FROM rings) r LEFT JOIN u USING (mol_id, ring) LEFT JOIN h ON h.mol_id = r.mol_id GROUP BY 1")
def small_ring_terms(spark, d):
    bonds = B.bonds(spark, d)
    return graph.small_ring_terms(graph.rings_of_closures(bonds), bonds)


@query("ring_names", f"WITH {_RINGS}, own AS (SELECT mol_id, ring, count(*) AS size, count(*) FILTER (aromatic) AS arom, string_agg(element, ',' ORDER BY element) AS elements FROM rings JOIN atoms USING (mol_id, atom_id) GROUP BY 1, 2), u AS (SELECT r.mol_id, r.ring, count(*) AS k FROM (SELECT DISTINCT mol_id, ring FROM rings) r JOIN bonds e ON e.mol_id = r.mol_id AND e.a BETWEEN r.ring AND r.ring + 3 AND e.b BETWEEN r.ring AND r.ring + 3 AND (bond_aromatic OR bond_order >= 1.5) GROUP BY 1, 2) SELECT mol_id, 'ring[size=' || size || ';arom_atoms=' || arom || ';unsat_edges=' || coalesce(k, 0) || ';elements=' || elements || ']' AS name, count(*) AS n FROM own LEFT JOIN u USING (mol_id, ring) GROUP BY 1, 2")
def ring_names(spark, d):
    bonds = B.bonds(spark, d)
    return graph.ring_names(graph.rings_of_closures(bonds), B.atoms(spark, d), bonds)


@query("exocyclic_bonds", f"WITH {_RINGS}, r AS (SELECT DISTINCT mol_id, atom_id FROM rings) SELECT e.mol_id, CAST(sum(CASE WHEN (x.mol_id IS NULL) <> (y.mol_id IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS exocyclic FROM bonds e LEFT JOIN r x ON x.mol_id = e.mol_id AND x.atom_id = e.a LEFT JOIN r y ON y.mol_id = e.mol_id AND y.atom_id = e.b WHERE NOT bond_aromatic AND bond_order >= 1.5 GROUP BY 1")
def exocyclic_bonds(spark, d):
    bonds = B.bonds(spark, d)
    return graph.exocyclic_bonds(graph.rings_of_closures(bonds), bonds)


@query("composition_reference", f"WITH {B.ATOMS}, p AS (SELECT mol_id, bool_or(element = 'S') AS u, sum(CASE element WHEN 'C' THEN -1.0 WHEN 'N' THEN -2.5 WHEN 'O' THEN -4.0 END) AS s FROM atoms GROUP BY 1) SELECT mol_id, CASE WHEN u THEN 'unsupported' ELSE 'success' END AS status, CASE WHEN NOT u THEN round(s, {R})::DOUBLE END AS score FROM p")
def composition_reference(spark, d):
    return rounded(graph.composition_reference(B.atoms(spark, d), {"C": -1.0, "N": -2.5, "O": -4.0}), "score")


@query("ledger_score", f"WITH {B.ATOMS}, {B.BONDS}, o AS (SELECT mol_id, count(*) AS n FROM atoms GROUP BY 1), e AS (SELECT mol_id, sum(bond_order) AS s FROM bonds GROUP BY 1) SELECT mol_id, round(n - coalesce(s, 0), {R})::DOUBLE AS score FROM o LEFT JOIN e USING (mol_id)")
def ledger_score(spark, d):
    return rounded(graph.ledger_score(graph.local_ledger(B.atoms(spark, d), B.bonds(spark, d)), exclude=("charge",)), "score")


_COORDS = "coords AS (SELECT a.mol_id, a.atom_id, a.formal_charge AS q, a.atom_id * 1.5 AS x, a.total_hcount * 0.5 AS y, a.partial_charge AS z FROM atoms a)"


@query("pair_distance_terms", f"WITH {B.ATOMS}, {B.BONDS}, {_COORDS}, p AS (SELECT m.mol_id, m.q * n.q AS qq, greatest(0.5, sqrt((m.x - n.x) ** 2 + (m.y - n.y) ** 2 + (m.z - n.z) ** 2)) AS r FROM coords m JOIN coords n ON n.mol_id = m.mol_id AND m.atom_id < n.atom_id LEFT JOIN bonds e ON e.mol_id = m.mol_id AND e.a = m.atom_id AND e.b = n.atom_id WHERE e.a IS NULL) SELECT mol_id, round(sum(qq / r), {R}) + 0.0 AS coulomb, round(sum(exp(-r)), {R}) AS overlap FROM p GROUP BY 1")
def pair_distance_terms(spark, d):
    coords = B.atoms(spark, d).select("mol_id", "atom_id", F.col("formal_charge").alias("q"), (F.col("atom_id") * 1.5).alias("x"), (F.col("total_hcount") * 0.5).alias("y"), F.col("partial_charge").alias("z"))
    return rounded(graph.pair_distance_terms(coords, B.bonds(spark, d)), "coulomb", "overlap")


@query("rotatable_bonds", f"WITH {B.ATOMS}, {B.PARTS}, {_DIRECTED}, {_DEG}, {_RING}, r AS (SELECT DISTINCT mol_id, atom_id FROM rings) SELECT e.mol_id, count(*) AS rotatable FROM bonds e JOIN deg x ON x.mol_id = e.mol_id AND x.atom_id = e.a AND x.degree > 1 JOIN deg y ON y.mol_id = e.mol_id AND y.atom_id = e.b AND y.degree > 1 LEFT JOIN r p ON p.mol_id = e.mol_id AND p.atom_id = e.a LEFT JOIN r q ON q.mol_id = e.mol_id AND q.atom_id = e.b WHERE bond_order = 1 AND p.mol_id IS NULL AND q.mol_id IS NULL GROUP BY 1")
def rotatable_bonds(spark, d):
    bonds = B.bonds(spark, d, several=True)
    return graph.rotatable(bonds, graph.rings_of_closures(bonds))


_RES = f"""{B.ATOMS}, {B.BONDS}, site AS (SELECT mol_id, atom_id, aromatic FROM atoms WHERE aromatic OR hybridization IN ('SP', 'SP2') OR (element IN ('N', 'O', 'S') AND formal_charge <= 0 AND lone_pairs > 0)),
half AS (SELECT e.mol_id, a, b FROM bonds e JOIN site x ON x.mol_id = e.mol_id AND x.atom_id = a JOIN site y ON y.mol_id = e.mol_id AND y.atom_id = b WHERE bond_aromatic OR conjugated OR bond_order >= 1.5),
step AS (SELECT mol_id, a, b FROM half UNION SELECT mol_id, b, a FROM half),
reach(mol_id, x, y) AS (SELECT mol_id, atom_id, atom_id FROM site UNION SELECT r.mol_id, r.x, s.b FROM reach r JOIN step s ON s.mol_id = r.mol_id AND s.a = r.y),
part AS (SELECT mol_id, comp, count(*) AS n FROM (SELECT mol_id, x, min(y) AS comp FROM reach GROUP BY 1, 2) GROUP BY 1, 2), one AS (SELECT mol_id, count(*) AS components, CAST(sum(n) AS BIGINT) AS sites, max(n) AS largest FROM part GROUP BY 1),
br AS (SELECT d.mol_id, count(*) AS branch_centres, count(*) FILTER (NOT aromatic) AS cross_conjugated FROM (SELECT mol_id, a AS atom_id FROM step GROUP BY 1, 2 HAVING count(*) >= 3) d JOIN site USING (mol_id, atom_id) GROUP BY 1),
w2 AS (SELECT s.mol_id, s.a AS p0, s.b AS p1, t.b AS p2 FROM step s JOIN step t ON t.mol_id = s.mol_id AND t.a = s.b AND t.b <> s.a), w3 AS (SELECT w.*, t.b AS p3 FROM w2 w JOIN step t ON t.mol_id = w.mol_id AND t.a = p2 AND t.b NOT IN (p0, p1)), w4 AS (SELECT w.*, t.b AS p4 FROM w3 w JOIN step t ON t.mol_id = w.mol_id AND t.a = p3 AND t.b NOT IN (p0, p1, p2)),
c2 AS (SELECT mol_id, count(*) AS k FROM w2 WHERE p0 < p2 GROUP BY 1), c3 AS (SELECT mol_id, count(*) AS k FROM w3 WHERE p0 < p3 GROUP BY 1), c4 AS (SELECT mol_id, count(*) AS k FROM w4 WHERE p0 < p4 GROUP BY 1)"""


@query("resonance_terms", f"WITH RECURSIVE {_RES} SELECT one.mol_id, components, sites, largest, coalesce(branch_centres, 0) AS branch_centres, coalesce(cross_conjugated, 0) AS cross_conjugated, coalesce(c2.k, 0) AS paths_2, coalesce(c3.k, 0) AS paths_3, coalesce(c4.k, 0) AS paths_4 FROM one LEFT JOIN br USING (mol_id) LEFT JOIN c2 USING (mol_id) LEFT JOIN c3 USING (mol_id) LEFT JOIN c4 USING (mol_id)")
def resonance_terms(spark, d):
    return graph.resonance_terms(B.atoms(spark, d), B.bonds(spark, d))


@query("localized_bonds", f"WITH {_PI}, o AS (SELECT mol_id, atom_id, element, CAST(CASE element WHEN 'N' THEN 0.5 WHEN 'O' THEN 1.0 WHEN 'S' THEN 0.4 ELSE 0 END AS DOUBLE) AS al FROM pi) SELECT e.mol_id, round(sum(-2 * sqrt(((x.al - y.al) / 2) ** 2 + 1.21)), {R}) AS localized, round(sum(CASE WHEN bond_aromatic THEN 0 WHEN least(x.element, y.element) = 'C' AND greatest(x.element, y.element) = 'O' THEN -0.3 WHEN least(x.element, y.element) = 'C' AND greatest(x.element, y.element) = 'N' THEN -0.2 ELSE 0 END), {R})::DOUBLE + 0.0 AS increment FROM coupled e JOIN o x ON x.mol_id = e.mol_id AND x.atom_id = a JOIN o y ON y.mol_id = e.mol_id AND y.atom_id = b WHERE bond_order >= 1.5 GROUP BY 1")
def localized_bonds(spark, d):
    found = graph.localized_bonds(_pi(spark, d), B.atoms(spark, d), B.bonds(spark, d), ALPHA, 1.1, {("C", "O"): -0.3, ("C", "N"): -0.2})
    return rounded(found, "localized", "increment")


_SEEDS = "own AS (SELECT mol_id, atom_id, concat_ws('|', element, CAST(aromatic AS INT), formal_charge, total_hcount) AS seed, concat_ws(':', element, formal_charge, CAST(aromatic AS INT)) AS brief FROM atoms), kinds AS (SELECT mol_id, a, b, CASE WHEN bond_aromatic THEN 'aromatic' WHEN bond_order >= 2.5 THEN 'triple' WHEN bond_order >= 1.5 THEN 'double' ELSE 'single' END AS kind FROM bonds), near AS (SELECT k.mol_id, k.a AS atom_id, string_agg(k.kind || ':' || o.brief, ',' ORDER BY k.kind || ':' || o.brief) AS near, count(*) AS degree FROM (SELECT * FROM kinds UNION ALL SELECT mol_id, b, a, kind FROM kinds) k JOIN own o ON o.mol_id = k.mol_id AND o.atom_id = k.b GROUP BY 1, 2), sig AS (SELECT mol_id, 'atom' AS kind, concat_ws('|', seed, coalesce(degree, 0), coalesce(near, '')) AS signature FROM own LEFT JOIN near USING (mol_id, atom_id) UNION ALL SELECT k.mol_id, 'bond', concat_ws('~', k.kind, least(x.seed, y.seed), greatest(x.seed, y.seed)) FROM kinds k JOIN own x ON x.mol_id = k.mol_id AND x.atom_id = a JOIN own y ON y.mol_id = k.mol_id AND y.atom_id = b UNION ALL SELECT t.mol_id, 'atom_pair', concat_ws('~', d, least(x.seed, y.seed), greatest(x.seed, y.seed)) FROM dist t JOIN own x ON x.mol_id = t.mol_id AND x.atom_id = a JOIN own y ON y.mol_id = t.mol_id AND y.atom_id = b WHERE d BETWEEN 2 AND 4), bins AS (SELECT mol_id, kind || '_' || lpad(CAST(('0x' || substr(sha256(signature), 1, 16))::UBIGINT % 128 AS VARCHAR), 3, '0') AS name, CASE WHEN ('0x' || substr(sha256(signature), 17, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM sig)"


@query("local_signatures", f"WITH RECURSIVE {_DIST}, {_SEEDS} SELECT mol_id, name, sum(s) AS value FROM bins GROUP BY 1, 2 HAVING sum(s) <> 0")
def local_signatures(spark, d):
    return graph.signature_bins(B.atoms(spark, d), B.bonds(spark, d), 2, 4)


@query("bond_inventory", f"WITH {B.ATOMS}, {B.BONDS} SELECT mol_id, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT e.mol_id, least(x.element, y.element) || '-' || greatest(x.element, y.element) || ';' || CAST(bond_order AS INT) AS name, 1 AS n FROM bonds e JOIN atoms x ON x.mol_id = e.mol_id AND x.atom_id = a JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = b UNION ALL SELECT mol_id, least('H', element) || '-' || greatest('H', element) || ';1', total_hcount FROM atoms WHERE total_hcount > 0) GROUP BY 1, 2")
def bond_inventory(spark, d):
    return graph.bond_inventory(B.atoms(spark, d), B.bonds(spark, d))


@query("domain_validation", f"WITH RECURSIVE {_COMP}, p AS (SELECT mol_id, count(DISTINCT comp) AS k FROM comp GROUP BY 1), q AS (SELECT mol_id, bool_or(isotope > 0) AS i, bool_or(element = 'S') AS s, sum(formal_charge) AS c, sum(radical_electrons) AS r FROM atoms WHERE mol_id % 101 <> 0 GROUP BY 1) SELECT o_orderkey AS mol_id, CASE WHEN q.mol_id IS NULL THEN 'empty' WHEN k > 1 THEN 'disconnected' WHEN i THEN 'isotope' WHEN s THEN 'unsupported_element' WHEN c <> 0 THEN 'charged' WHEN r > 0 THEN 'radical' END AS reason FROM orders LEFT JOIN q ON q.mol_id = o_orderkey LEFT JOIN p ON p.mol_id = o_orderkey")
def domain_validation(spark, d):
    a = B.atoms(spark, d).where("mol_id % 101 <> 0")
    every = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("mol_id"))
    return prep.validate_domain(a, graph.graph_components(a, B.bonds(spark, d, several=True).where("mol_id % 101 <> 0")), ("C", "N", "O"), molecules=every)


# ---------------------------------------------------------------- reactions
def _sides(spark, d):
    lines = B.read(spark, d, "lineitem")
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("bond_order"))
    return side("R"), side("A")


_CHANGES = "l AS (SELECT l_suppkey, l_partkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), r AS (SELECT l_suppkey, l_partkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), changes AS (SELECT coalesce(l.l_suppkey, r.l_suppkey) AS l_suppkey, coalesce(l.l_partkey, r.l_partkey) AS l_partkey, l.n AS left_order, r.n AS right_order, CASE WHEN l.n IS NULL THEN 'formed' WHEN r.n IS NULL THEN 'broken' WHEN l.n <> r.n THEN 'order_changed' ELSE 'unchanged' END AS kind FROM l FULL OUTER JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_partkey = r.l_partkey)"


@query("bond_changes", f"WITH {_CHANGES} SELECT * FROM changes WHERE kind <> 'unchanged'")
def bond_changes(spark, d):
    return reactions.bond_changes(*_sides(spark, d), ["l_suppkey", "l_partkey"])


@query("edit_terms", f"WITH {_CHANGES} SELECT l_suppkey, kind, count(*) AS n, sum(abs(coalesce(right_order, 0) - coalesce(left_order, 0))) AS change FROM changes WHERE kind <> 'unchanged' GROUP BY 1, 2")
def edit_terms(spark, d):
    return reactions.edit_terms(reactions.bond_changes(*_sides(spark, d), ["l_suppkey", "l_partkey"]), "l_suppkey")


@query("check_mapping", """WITH s AS (SELECT l_suppkey AS reaction, l_linenumber AS map, l_returnflag AS flag, min(l_shipdate) AS dt FROM lineitem GROUP BY 1, 2, 3), l AS (SELECT reaction, map, reaction % 3 AS e FROM s WHERE flag = 'R'), r AS (SELECT reaction, map, CASE WHEN reaction % 5 = 0 THEN 9 ELSE reaction % 3 END AS e FROM s WHERE flag = 'A'),
ln AS (SELECT reaction, count(*) AS n FROM l GROUP BY 1), rn AS (SELECT reaction, count(*) AS n FROM r GROUP BY 1), u AS (SELECT coalesce(l.reaction, r.reaction) AS reaction, bool_or(NOT coalesce(l.e = r.e, false)) AS u FROM l FULL OUTER JOIN r ON l.reaction = r.reaction AND l.map = r.map GROUP BY 1)
SELECT reaction, CASE WHEN c IS NULL THEN 'success' ELSE 'unsupported' END AS status, c AS code FROM (SELECT u.reaction, CASE WHEN ln.n IS NULL OR rn.n IS NULL THEN 'REACTION_MAPPING_MISSING' WHEN u OR ln.n <> rn.n THEN 'REACTION_NOT_BALANCED' END AS c FROM u LEFT JOIN ln ON ln.reaction = u.reaction LEFT JOIN rn ON rn.reaction = u.reaction)""")
def check_mapping(spark, d):
    s = B.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("reaction"), F.col("l_linenumber").alias("map"), "l_returnflag").distinct().withColumn("charge", F.lit(0))
    left = s.where("l_returnflag = 'R'").withColumn("element", F.col("reaction") % 3)
    right = s.where("l_returnflag = 'A'").withColumn("element", F.when(F.col("reaction") % 5 == 0, 9).otherwise(F.col("reaction") % 3))
    return reactions.check_mapping(left, right)


@query("reaction_delta", f"WITH s AS (SELECT l_orderkey AS reaction, CASE WHEN l_returnflag = 'N' THEN 'product' ELSE 'reactant' END AS side, l_partkey AS component FROM lineitem), v AS (SELECT p_partkey AS component, p_retailprice AS value FROM part WHERE p_partkey % 50 <> 0), j AS (SELECT reaction, bool_or(value IS NULL) AS gap, sum(CASE WHEN side = 'product' THEN value ELSE -value END) AS d FROM s LEFT JOIN v USING (component) GROUP BY 1) SELECT reaction, CASE WHEN gap THEN 'missing_value' ELSE 'success' END AS status, CASE WHEN NOT gap THEN round(d, 4) END AS delta FROM j")
def reaction_delta(spark, d):
    sides = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), F.when(F.col("l_returnflag") == "N", "product").otherwise("reactant").alias("side"), F.col("l_partkey").alias("component"))
    values = B.read(spark, d, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("component"), F.col("p_retailprice").alias("value"))
    return reactions.reaction_delta(sides, values).withColumn("delta", F.round("delta", 4))


@query("valence_filter", f"WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, u AS (SELECT mol_id, a AS atom_id, sum(bond_order) AS u FROM directed GROUP BY 1, 2) SELECT a.mol_id, a.atom_id, radical_electrons = 0 AND coalesce(u, 0) + total_hcount + 1 <= CASE element WHEN 'C' THEN 4 WHEN 'N' THEN 4 WHEN 'O' THEN 3 ELSE 6 END AS allowed FROM atoms a LEFT JOIN u USING (mol_id, atom_id)")
def valence_filter(spark, d):
    return reactions.valence_allowed(B.atoms(spark, d), B.bonds(spark, d))


def _frontiers(spark, d):
    a = B.atoms(spark, d)
    return a.withColumn("comp", F.col("atom_id") % 2).select("mol_id", "comp", "atom_id", (F.col("partial_charge") * 10).alias("homo"), (F.col("partial_charge") * 10 + F.col("total_hcount") * 0.02).alias("lumo"), F.lit(0.5).alias("homo_density"), F.lit(0.25).alias("lumo_density"))


_FRONT = f"{B.ATOMS}, systems AS (SELECT mol_id, atom_id % 2 AS comp, atom_id, partial_charge * 10 AS homo, partial_charge * 10 + total_hcount * 0.02 AS lumo FROM atoms), ends AS (SELECT *, max(homo) OVER (PARTITION BY mol_id, comp) AS top, min(lumo) OVER (PARTITION BY mol_id, comp) AS low FROM systems), f AS (SELECT mol_id, comp, atom_id, top, low, CASE WHEN homo = top THEN 0.5 ELSE 0.0 END AS hd, CASE WHEN lumo = low THEN 0.25 ELSE 0.0 END AS ld FROM ends)"


@query("merge_frontiers", f"WITH {_FRONT} SELECT mol_id, CAST(comp AS INT) AS comp, atom_id, round(top, {R}) AS homo, round(low, {R}) AS lumo, hd::DOUBLE AS homo_density, ld::DOUBLE AS lumo_density FROM f")
def merge_frontiers(spark, d):
    return rounded(reactions.merge_frontiers(_frontiers(spark, d)), "homo", "lumo")


def _pair_scores(spark, d):
    a, e = B.atoms(spark, d), B.bonds(spark, d)
    f = reactions.merge_frontiers(_frontiers(spark, d)).join(a.select("mol_id", "atom_id", "element", "formal_charge", F.col("partial_charge").alias("q")).hint("merge"), ["mol_id", "atom_id"])
    f = f.join(reactions.valence_allowed(a, e).where("allowed").hint("merge"), ["mol_id", "atom_id"], "left_semi").join(reactions.accessibility(_pi(spark, d), e).hint("merge"), ["mol_id", "atom_id"])
    f = checkpointed(f)
    side = lambda s: f.select("mol_id", F.col("atom_id").alias(s), F.col("homo").alias(f"homo_{s}"), F.col("lumo").alias(f"lumo_{s}"), F.col("homo_density").alias(f"hd_{s}"), F.col("lumo_density").alias(f"ld_{s}"), F.col("q").alias(f"q_{s}"), F.col("accessibility").alias(f"acc_{s}"), F.col("element").alias(f"element_{s}"), F.col("formal_charge").alias(f"charge_{s}"))
    pairs = reactions.candidate_pairs(f.select("mol_id", "atom_id", "comp")).select("mol_id", "a", "b")
    return reactions.score_pairs(pairs.join(side("a").hint("merge"), ["mol_id", "a"]).join(side("b").hint("merge"), ["mol_id", "b"]))


_PAIRS = _PI + """, systems AS (SELECT mol_id, atom_id % 2 AS comp, atom_id, partial_charge * 10 AS homo, partial_charge * 10 + total_hcount * 0.02 AS lumo FROM atoms), ends AS (SELECT *, max(homo) OVER (PARTITION BY mol_id, comp) AS top, min(lumo) OVER (PARTITION BY mol_id, comp) AS low FROM systems),
used AS (SELECT mol_id, a AS atom_id, sum(bond_order) AS u FROM directed GROUP BY 1, 2), outside AS (SELECT e.mol_id, e.a AS atom_id, count(*) AS k FROM directed e JOIN pi ON pi.mol_id = e.mol_id AND pi.atom_id = e.b AND pi.electrons IS NULL GROUP BY 1, 2),
f AS (SELECT n.mol_id, n.comp, n.atom_id, top AS h, low AS l, CASE WHEN homo = top THEN 0.5 ELSE 0.0 END::DOUBLE AS hd, CASE WHEN lumo = low THEN 0.25 ELSE 0.0 END::DOUBLE AS ld, t.element, t.formal_charge, t.partial_charge AS q, 1.0::DOUBLE / (1 + coalesce(k, 0)) AS acc, 1 / greatest((low - top) / 2, 0.05) AS soft FROM ends n JOIN atoms t USING (mol_id, atom_id) LEFT JOIN used USING (mol_id, atom_id) LEFT JOIN outside USING (mol_id, atom_id)
 WHERE t.radical_electrons = 0 AND coalesce(u, 0) + t.total_hcount + 1 <= CASE t.element WHEN 'C' THEN 4 WHEN 'N' THEN 4 WHEN 'O' THEN 3 ELSE 6 END),
p AS (SELECT x.mol_id, x.atom_id AS a, y.atom_id AS b, CASE WHEN y.l - x.h > 0 THEN x.hd * y.ld / greatest(y.l - x.h, 0.05) ELSE 0 END AS ab, CASE WHEN x.l - y.h > 0 THEN y.hd * x.ld / greatest(x.l - y.h, 0.05) ELSE 0 END AS ba, x.soft * y.soft * (x.hd * y.ld + y.hd * x.ld) AS hsab, -x.q * y.q AS charge, x.acc + y.acc AS acc,
 concat_ws(';', CASE WHEN y.l - x.h <= 0 THEN 'INVALID_DIRECTIONAL_GAP' WHEN y.l - x.h < 0.05 THEN 'FRONTIER_GAP_REGULARIZED' END, CASE WHEN x.l - y.h <= 0 THEN 'INVALID_DIRECTIONAL_GAP' WHEN x.l - y.h < 0.05 THEN 'FRONTIER_GAP_REGULARIZED' END) AS codes, concat_ws('/', x.element, x.formal_charge, x.hd, x.ld, round(x.acc, 9), y.element, y.formal_charge, y.hd, y.ld, round(y.acc, 9)) AS alike
 FROM f x JOIN f y ON y.mol_id = x.mol_id AND x.comp < y.comp),
scored AS (SELECT *, round(ab + ba + 0.25 * hsab + 0.05 * charge + 0.1 * acc, 6) + 0.0 AS score, CASE WHEN ab > ba THEN 'A_to_B' WHEN ba > ab THEN 'B_to_A' ELSE 'mixed' END AS direction FROM p)"""


@query("pair_ranking", f"WITH {_PAIRS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY mol_id ORDER BY score DESC, a, b) AS INT) AS rank FROM scored) SELECT mol_id, a, b, direction, round(ab, {R}) AS fmo_a_to_b, round(ba, {R}) AS fmo_b_to_a, round(hsab, {R}) AS hsab, round(charge, {R}) + 0.0 AS charge, round(acc, {R}) AS accessibility, codes, score, rank FROM r WHERE rank <= 3")
def pair_ranking(spark, d):
    scored = rounded(_pair_scores(spark, d), "score")
    best = rounded(reactions.rank_pairs(scored, 3), "fmo_a_to_b", "fmo_b_to_a", "hsab", "charge", "accessibility")
    return best.select("mol_id", "a", "b", "direction", "fmo_a_to_b", "fmo_b_to_a", "hsab", "charge", "accessibility", F.array_join("codes", ";").alias("codes"), "score", "rank")


@query("equivalent_pairs", f"WITH {_PAIRS} SELECT mol_id, count(*) AS n, CAST(split_part(min(lpad(a::VARCHAR, 3, '0') || '-' || lpad(b::VARCHAR, 3, '0')), '-', 1) AS INT) AS a, CAST(split_part(min(lpad(a::VARCHAR, 3, '0') || '-' || lpad(b::VARCHAR, 3, '0')), '-', 2) AS INT) AS b, string_agg(a || '-' || b, ' ' ORDER BY a, b) AS pairs FROM scored GROUP BY mol_id, alike")
def equivalent_pairs(spark, d):
    found = reactions.group_equivalent_pairs(_pair_scores(spark, d))
    return found.select("mol_id", "a", "b", "n", F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))), " ").alias("pairs"))


@query("formed_pairs", f"WITH {_PAIRS}, g AS (SELECT mol_id, atom_id AS lo, atom_id + 1 AS hi FROM atoms WHERE total_hcount = 2), j AS (SELECT g.mol_id, s.a, s.ab + s.ba AS fmo, s.hsab, s.charge FROM g LEFT JOIN scored s ON s.mol_id = g.mol_id AND least(s.a, s.b) = lo AND greatest(s.a, s.b) = hi) SELECT mol_id, count(*) AS formed, round(coalesce(sum(fmo), 0), {R}) AS fmo, round(coalesce(sum(hsab), 0), {R}) AS hsab, round(coalesce(sum(charge), 0), {R}) + 0.0 AS charge, CASE WHEN bool_or(a IS NULL) THEN 'FORMED_BOND_NOT_PAIR_SCORABLE' END AS warning FROM j GROUP BY 1")
def formed_pairs(spark, d):
    changes = B.atoms(spark, d).where("total_hcount = 2").select("mol_id", F.col("atom_id").alias("b"), (F.col("atom_id") + 1).alias("a"), F.lit("formed").alias("kind"))
    return rounded(reactions.formed_pairs(_pair_scores(spark, d), changes), "fmo", "hsab", "charge")


@query("screening", f"WITH s AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS score FROM part), k AS (SELECT item FROM s WHERE score IS NOT NULL ORDER BY score, item LIMIT 25) SELECT s.item, s.score, CASE WHEN k.item IS NOT NULL THEN round(sqrt(s.item), {R}) ELSE s.score END AS final, CASE WHEN s.score IS NULL THEN 'failed' WHEN k.item IS NOT NULL THEN 'evaluated' ELSE 'screened' END AS status FROM s LEFT JOIN k USING (item)")
def screening(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("score"))
    return reactions.screen(p, 25, lambda x: x.select("item", F.round(F.sqrt(F.col("item").cast("double")), R).alias("value")))


# ---------------------------------------------------------------- enrichment and checks
@query("enrich_pending", "SELECT d.doc_id, d.doc_id AS item, CASE WHEN length(d.text) % 10 = 0 THEN 'worker_error' ELSE 'success' END AS status, CASE WHEN length(d.text) % 10 <> 0 THEN CAST(length(d.text) % 10 AS DOUBLE) END AS value FROM (SELECT doc_id, text FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL".replace("length(d.text)", "d.doc_id"))
def enrich_pending(spark, d):
    manifest = B.read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("item"))

    def evaluate(item):
        if item % 10 == 0:
            raise ValueError("no value")
        return item % 10

    return enrich.enrich_pending(manifest, B.read(spark, d, "labels"), evaluate, ["doc_id"], 1).select("doc_id", "item", "status", "value")


@query("release_checks", "WITH e AS (SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS expected FROM nation), a AS (SELECT n_name AS name, CAST(CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END AS VARCHAR) AS actual FROM nation WHERE n_nationkey <> 3), j AS (SELECT e.name, expected, actual, expected IS NOT DISTINCT FROM actual AS ok FROM e LEFT JOIN a USING (name)) SELECT * FROM j UNION ALL SELECT 'all', NULL, NULL, bool_and(ok) FROM j")
def release_checks(spark, d):
    n = B.read(spark, d, "nation")
    e = n.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    a = n.where("n_nationkey <> 3").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") == 7, 99).otherwise(F.col("n_regionkey")).cast("string").alias("value"))
    return enrich.release_checks(e, a)


@query("same_weights", "WITH l AS (SELECT s_suppkey AS name, s_acctbal AS w FROM supplier), r AS (SELECT s_suppkey AS name, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE s_acctbal END AS w FROM supplier WHERE s_suppkey % 7 <> 0) SELECT count(l.name) AS left_terms, count(r.name) AS right_terms, CAST(sum(CASE WHEN l.w IS DISTINCT FROM r.w THEN 1 ELSE 0 END) AS BIGINT) AS different FROM l FULL OUTER JOIN r ON l.name = r.name")
def same_weights(spark, d):
    s = B.read(spark, d, "supplier")
    left = s.select(F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("weight"))
    right = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("weight"))
    return enrich.same_weights(left, right)


@query("coverage", "SELECT count(*) AS selected, count(l.quality) AS scored, count(l.quality) / count(*) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, d):
    j = B.read(spark, d, "documents").select("doc_id").join(B.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return enrich.failures(j, "quality")


# ---------------------------------------------------------------- motifs and studies
@query("motif_terms", f"""WITH {B.ATOMS}, {B.BONDS}, {_DIRECTED}, dbl AS (SELECT DISTINCT mol_id, a AS atom_id FROM directed WHERE bond_order >= 2), bes AS (SELECT DISTINCT e.mol_id, e.a AS atom_id FROM directed e JOIN dbl ON dbl.mol_id = e.mol_id AND dbl.atom_id = e.b WHERE bond_order < 2),
lone AS (SELECT a.mol_id, count(*) AS n FROM atoms a SEMI JOIN bes USING (mol_id, atom_id) ANTI JOIN dbl USING (mol_id, atom_id) WHERE element IN ('N', 'O', 'S') GROUP BY 1),
ends AS (SELECT DISTINCT e.mol_id, e.a FROM directed e JOIN atoms x ON x.mol_id = e.mol_id AND x.atom_id = a AND x.element = 'C' JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = b AND y.element = 'C' WHERE bond_order >= 2),
arms AS (SELECT e.mol_id, count(*) AS s, count(*) FILTER (y.total_hcount > 0) AS h FROM directed e JOIN ends USING (mol_id, a) JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = e.b AND y.element = 'C' WHERE bond_order < 2 GROUP BY 1)
SELECT m.mol_id, coalesce(lone.n, 0) AS lone_pair, coalesce(s, 0) AS substitution, coalesce(h, 0) AS hyperconjugation, round(coalesce(lone.n, 0) * 0.3 + coalesce(s, 0) * 0.1 + coalesce(h, 0) * 0.05, {R})::DOUBLE AS reward FROM (SELECT DISTINCT mol_id FROM atoms) m LEFT JOIN lone USING (mol_id) LEFT JOIN arms USING (mol_id)""")
def motif_terms(spark, d):
    return rounded(motifs.motif_terms(B.atoms(spark, d), B.bonds(spark, d), {"lone_pair": 0.3, "substitution": 0.1, "hyperconjugation": 0.05}), "reward")


@query("rigid_pairs")
def rigid_pairs(spark, d):
    b = B.bonds(spark, d)
    return motifs.rigid_pairs(B.atoms(spark, d), b, graph.rings_of_closures(b))


_ORBITALS = f"""{_PI}, triple AS (SELECT DISTINCT mol_id, a AS atom_id FROM directed WHERE bond_order >= 2.5),
cumul AS (SELECT mol_id, atom_id FROM (SELECT mol_id, a AS atom_id FROM bonds WHERE bond_order >= 1.5 AND bond_order < 2.5 AND NOT bond_aromatic UNION ALL SELECT mol_id, b FROM bonds WHERE bond_order >= 1.5 AND bond_order < 2.5 AND NOT bond_aromatic) JOIN atoms USING (mol_id, atom_id) WHERE hybridization = 'SP' GROUP BY 1, 2 HAVING count(*) = 2),
sulf AS (SELECT e.mol_id, e.a AS atom_id, count(*) AS k FROM directed e JOIN atoms x ON x.mol_id = e.mol_id AND x.atom_id = e.a AND x.element = 'S' JOIN atoms y ON y.mol_id = e.mol_id AND y.atom_id = e.b AND y.element = 'O' WHERE bond_order >= 1.5 GROUP BY 1, 2 HAVING count(*) >= 2),
fixed AS (SELECT a.mol_id, a.atom_id, p.electrons, (p.electrons IS NOT NULL OR t.mol_id IS NOT NULL) AS base, t.mol_id IS NOT NULL AS trip, greatest(CASE WHEN p.electrons IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN t.mol_id IS NOT NULL THEN 2 ELSE 0 END, CASE WHEN c.mol_id IS NOT NULL AND (p.electrons IS NOT NULL OR t.mol_id IS NOT NULL) THEN 2 ELSE 0 END, coalesce(s.k, 0)) AS many, c.mol_id IS NOT NULL OR s.mol_id IS NOT NULL OR t.mol_id IS NOT NULL AS ones, coalesce(s.k, 0) AS k FROM atoms a JOIN pi p USING (mol_id, atom_id) LEFT JOIN triple t USING (mol_id, atom_id) LEFT JOIN cumul c USING (mol_id, atom_id) LEFT JOIN sulf s USING (mol_id, atom_id)),
ways AS (SELECT mol_id, a, b, bond_order, conjugated FROM bonds UNION ALL SELECT mol_id, b, a, bond_order, conjugated FROM bonds),
donor AS (SELECT a.mol_id, a.atom_id, max(CASE WHEN f.k > 1 THEN f.k ELSE 1 END) AS m FROM atoms a JOIN fixed o ON o.mol_id = a.mol_id AND o.atom_id = a.atom_id AND o.many = 0 JOIN ways w ON w.mol_id = a.mol_id AND w.a = a.atom_id AND w.bond_order < 1.5 JOIN fixed f ON f.mol_id = w.mol_id AND f.atom_id = w.b AND f.many > 0 AND (f.k > 0 OR w.conjugated) WHERE a.element IN ('N', 'O', 'S') AND a.formal_charge <= 0 AND a.lone_pairs > 0 GROUP BY 1, 2)"""


@query("expand_orbitals", f"WITH {_ORBITALS} SELECT mol_id, atom_id, CAST(unnest(range(many)) AS INT) AS orbital, CASE WHEN ones THEN 1 ELSE electrons END AS electrons, 1.0::DOUBLE AS scale FROM fixed WHERE many > 0 UNION ALL SELECT mol_id, atom_id, 0, 2, round(1 / sqrt(m), {R}) FROM donor")
def expand_orbitals(spark, d):
    return rounded(motifs.expand_orbitals(B.atoms(spark, d), B.bonds(spark, d), _pi(spark, d)), "scale")


@query("expensive_gate", "SELECT p_partkey AS item, p_partkey % 4 > 2 OR p_retailprice - floor(p_retailprice) < 0.1 AS run FROM part")
def expensive_gate(spark, d):
    p = B.read(spark, d, "part")
    rotatable, margin = F.greatest(F.lit(0), F.col("p_partkey") % 4 - 2), F.col("p_retailprice") - F.floor("p_retailprice")
    return p.select(F.col("p_partkey").alias("item"), motifs.should_run("auto", rotatable, margin).alias("run"))


def _counts(spark, d):
    return B.atoms(spark, d).groupBy(F.col("mol_id").alias("item"), "element").agg(F.count("*").alias("n"))


_METRICS = ("mae", "rmse", "median_abs_error", "r2", "pearson", "spearman", "mean_signed_error")


@query("baseline_ladder")
def baseline_ladder(spark, d):
    hydrogens = B.atoms(spark, d).groupBy(F.col("mol_id").alias("item")).agg(F.sum("total_hcount").alias("n")).where("n > 0")
    counts = _counts(spark, d).unionByName(hydrogens.select("item", F.lit("H").alias("element"), "n"))
    items = B.mol_items(spark, d).withColumn("split", cohort.split_of(F.col("grp")))
    return rounded(studies.held_out_ladder(items, counts, B.features(spark, d), linear.weights_frame(spark, WEIGHTS)), *_METRICS)


@query("ablate_blocks")
def ablate_blocks(spark, d):
    w = linear.weights_frame(spark, WEIGHTS | {"path_edges": 0.0, "ring_closures": 0.0})
    return rounded(studies.ablate_blocks(B.mol_items(spark, d), _counts(spark, d), B.features(spark, d), w), *_METRICS)


@query("fit_bits")
def fit_bits(spark, d):
    bits = B.bits(spark, d)
    items = bits.select("item", "grp").distinct().withColumn("label", F.sin(F.col("item").cast("double")) * 5)
    return rounded(studies.fit_bits(items, bits, [1.0, 10.0]), "prediction").select("item", "prediction")


@query("tune_support")
def tune_support(spark, d):
    items, features = _fit_inputs(spark, d)
    return rounded(studies.tune_support(items, features.join(items.select("item").hint("merge"), "item", "left_semi"), [0.05], [1.0, 10.0], 2), "composite")


@query("fit_final")
def fit_final(spark, d):
    items, features = _fit_inputs(spark, d)
    weights, q99 = studies.fit_final(items, features.join(items.select("item").hint("merge"), "item", "left_semi"), 0.05, 1.0, 2)
    return rounded(weights.withColumn("q99", F.lit(q99).cast("double")), "weight", "mean", "scale", "q99")


@query("nested_cv")
def nested_cv(spark, d):
    items, features = _fit_inputs(spark, d)
    found = nested.nested_study(items, features, WEIGHTS, [], [1.0, 10.0], 2, 2).predictions
    return rounded(found.where("model = 'fixed'"), "prediction").select("item", "grp", "prediction", "fold")


def _study(spark, d):
    items, features = _fit_inputs(spark, d)
    return nested.nested_study(items, features, WEIGHTS, [0.01, 0.05], [1.0, 10.0], 3, 2)


@query("nested_study")
def nested_study(spark, d):
    return rounded(_study(spark, d).predictions, "prediction").select("model", "item", "grp", "prediction", "fold")


@query("nested_choices")
def nested_choices(spark, d):
    return rounded(_study(spark, d).choice_frame(), "composite")


@query("nested_gates")
def nested_gates(spark, d):
    found = _study(spark, d).predictions
    per = checkpointed(nested.model_metrics(found, *nested.MODELS))
    out = None
    for kind, left, right, conditions in (("choice", "expanded", "fixed", nested.choice_gates()), ("advancement", "expanded", "baseline", nested.advancement_gates())):
        now = metrics.gates(nested.model_deltas(found, left, right, per=per), conditions).withColumn("kind", F.lit(kind))
        out = now if out is None else out.unionByName(now)
    return out


@query("evaluate_external")
def evaluate_external(spark, d):
    return studies.evaluate_external(B.mol_items(spark, d), B.features(spark, d), linear.weights_frame(spark, WEIGHTS))


@query("throughput", f"SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), {R}) AS mean, round(stddev_samp(l_quantity), {R}) AS std, round(quantile_cont(l_quantity, 0.5), {R}) AS median, round(quantile_cont(l_quantity, 0.95), {R}) AS p95, round(count(*) / sum(l_quantity), {R}) AS rate FROM lineitem GROUP BY 1")
def throughput(spark, d):
    t = B.read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("seconds"))
    return rounded(enrich.throughput(t, "l_returnflag"), "mean", "std", "median", "p95", "rate")


@query("subset_runtime", "SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 50000 AND o_orderkey % 7 <> 0")
def subset_runtime(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("item"), "o_totalprice")
    requested = o.where("item % 3 = 0").select("item")
    timed = o.select("item", F.when(F.col("item") % 7 == 0, "worker_error").otherwise("success").alias("status"), (F.col("o_totalprice") - 50000).alias("seconds"))
    return enrich.subset_runtime(o.select("item"), requested, timed)
