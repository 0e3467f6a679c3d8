"""Operators on the small tables whose results are known by hand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import cohort, enrich, graph, linear, loops, metrics, ordering, prep, reactions, resampling
from cohortal.sources import tables
from cohortal.streaming import scoring


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"{g}{k}", g, float(k), label) for g, base, step in (("a", 100.0, 2.0), ("b", -50.0, 2.0)) for k in range(3) for label in (base + step * k,)]
    items = spark.createDataFrame([(i, g, y) for i, g, _, y in rows], "item string, grp string, label double")
    features = spark.createDataFrame([(i, g, n, v) for i, g, x, _ in rows for n, v in (("x", x), ("constant", 4.0)) if v], "item string, grp string, name string, value double")
    return items, features


def test_group_ridge_ignores_group_offsets(spark, groups):
    items, features = groups
    w = linear.fit_group_ridge(items, features, 1e-10)
    assert abs(w["x"] - 2) < 1e-6 and abs(w["constant"]) < 1e-9
    scales = spark.createDataFrame([("x", 1.0)], "name string, scale double")
    got = {r["item"]: r for r in linear.predict_group_ridge(items, features, linear.weights_frame(spark, w), scales).collect()}
    assert abs(sum(r["prediction"] for r in got.values())) < 1e-6 and abs(got["a2"]["prediction"] - got["a0"]["prediction"] - 4) < 1e-6
    assert abs(got["a0"]["distance"] - got["a2"]["distance"]) < 1e-9


def test_plain_ridge_and_refinement(spark):
    items = spark.createDataFrame([(k, "g", 2.0 * k + 1) for k in range(6)], "item long, grp string, label double")
    features = spark.createDataFrame([(k, "g", "x", float(k)) for k in range(1, 6)], "item long, grp string, name string, value double")
    intercept, w, rmse = linear.fit_ridge(items, features, 1e-10)
    assert abs(intercept + 3.5 * w["x"] - 8) < 1e-6 and rmse < 1e-4
    scored = items.withColumn("residual", F.col("label"))
    z = np.array([[0.0], [1], [2], [3], [4], [5]])
    want = np.linalg.solve(z.T @ z + 0.5 * np.eye(1), z.T @ np.array([1.0, 3, 5, 7, 9, 11]))[0]
    assert abs(linear.refine(scored, features.select("item", "name", "value"), "residual", 0.5)["x"] - want) < 1e-9
    with pytest.raises(ValueError):
        linear.refine(scored.limit(1), features, "residual", 1.0)


def test_lasso_meets_its_conditions(spark, groups):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(80, 4))
    y = x @ np.array([1.5, 0, -0.7, 0]) + 0.01 * rnd.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    s = linear.System(list("abcd"), x.T @ x, x.T @ y, 80)
    w = s.lasso(0.1)
    assert set(w) == {"a", "c"}
    scaled = x / x.std(0)
    beta = np.array([w.get(n, 0) for n in "abcd"]) * x.std(0)
    pull = scaled.T @ (y - scaled @ beta) / 80
    assert np.all(np.abs(pull) <= 0.1 + 1e-6) and np.allclose(np.abs(pull[beta != 0]), 0.1, atol=1e-6)


def test_contributions_add_up(spark, groups):
    items, features = groups
    w = linear.weights_frame(spark, {"x": 0.5, "constant": -1.0, "unknown": 9.0})
    totals = {r["item"]: r["s"] for r in linear.contributions(features, w).groupBy("item").agg(F.sum("value").alias("s")).collect()}
    for r in linear.score_linear(items, features, w, 1.0).collect():
        assert abs(r["prediction"] - 1.0 - totals[r["item"]]) < 1e-12


def test_ranking_breaks_ties_by_input(spark):
    df = spark.createDataFrame([(2, "g", 1.0), (1, "g", 1.0), (3, "g", 0.0), (9, "h", 5.0)], "item long, grp string, prediction double")
    got = {r["item"]: (r["rank"], r["delta"]) for r in linear.rank_group(df).collect()}
    assert got == {3: (1, 0.0), 1: (2, 1.0), 2: (3, 1.0), 9: (1, 0.0)}


def test_rank_metric_modes(spark):
    rows = [("a", k, y, p) for k, (y, p) in enumerate([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)])] + [("c", k, 1.0, float(k)) for k in range(3)]
    df = spark.createDataFrame(rows, "grp string, item long, label double, prediction double")
    tie = {r["grp"]: r for r in metrics.rank_metrics(df).collect()}
    assert tie["a"]["top1"] == 0.5 and abs(tie["a"]["concordance"] - 2.5 / 3) < 1e-12
    assert tie["c"]["pearson"] is None and tie["c"]["concordance"] == 0.5 and tie["c"]["top1"] == 1.0
    strict = metrics.rank_metrics(df, "drop_undefined").collect()
    assert [r["grp"] for r in strict] == ["a"] and strict[0]["top1"] == 1.0


def test_resampling_is_repeatable(spark):
    df = spark.createDataFrame([(f"g{k}", float(k % 7)) for k in range(40)], "grp string, v double")
    a, b = resampling.bootstrap_ci(df, "v", 100).first(), resampling.bootstrap_ci(df.repartition(3), "v", 100).first()
    assert a == b and a["low"] < a["estimate"] < a["high"]
    rows = [(g, k, float(k), float(k * k)) for g in "abcdef" for k in range(6)]
    null = resampling.permutation_null(spark.createDataFrame(rows, "grp string, item long, label double, prediction double"), 30).first()
    assert null["observed"] > 0.9 and abs(null["mean"]) < 0.3 and abs(null["p"] - 1 / 31) < 1e-12


def molecule(spark, bonds, elements, mol=1):
    atoms = spark.createDataFrame([(mol, k, e, 0, 0, False) for k, e in enumerate(elements)], "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, aromatic boolean")
    return atoms, spark.createDataFrame([(mol, a, b, o) for a, b, o in bonds], "mol_id long, a int, b int, bond_order double")


def test_pi_counts(spark):
    """Ethene; butadiene, whose middle bond is conjugated, and the same without that flag; acetaldehyde."""
    for bonds, elements, conjugated, want in (
        ([(0, 1, 2.0)], "CC", (), [2]),
        ([(0, 1, 2.0), (1, 2, 1.0), (2, 3, 2.0)], "CCCC", (1,), [4]),
        ([(0, 1, 2.0), (1, 2, 1.0), (2, 3, 2.0)], "CCCC", (), [2, 2]),
        ([(0, 1, 2.0), (1, 2, 1.0)], "OCC", (), [2]),
    ):
        atoms, b = molecule(spark, bonds, elements)
        b = b.withColumn("conjugated", F.col("a").isin(*conjugated) if conjugated else F.lit(False))
        assert sorted(r["electrons"] for r in graph.pi_systems(graph.assign_pi(atoms, b), b).collect()) == want


def test_pi_counts_of_rings(spark):
    """Benzene, pyridine, pyrrole and furan have six electrons in one system."""
    for elements, hydrogens in (("CCCCCC", {}), ("NCCCCC", {0: 0}), ("NCCCC", {0: 1}), ("OCCCC", {0: 0})):
        n = len(elements)
        atoms = spark.createDataFrame([(1, k, e, 0, hydrogens.get(k, 1), True) for k, e in enumerate(elements)], "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, aromatic boolean")
        bonds = spark.createDataFrame([(1, k, (k + 1) % n, 1.5, True) for k in range(n)], "mol_id long, a int, b int, bond_order double, bond_aromatic boolean")
        assert [(r["sites"], r["electrons"]) for r in graph.pi_systems(graph.assign_pi(atoms, bonds), bonds).collect()] == [(n, 6)]


def test_graph_identity_is_free_of_ids(spark):
    atoms, bonds = molecule(spark, [(0, 1, 2.0), (1, 2, 1.0)], "CCO")
    moved = lambda c: (F.col(c) * 7 + 100).cast("int").alias(c)
    other = atoms.select("mol_id", moved("atom_id"), "element", "formal_charge", "total_hcount", "aromatic"), bonds.select("mol_id", moved("a"), moved("b"), "bond_order")
    name = lambda a, b: graph.graph_identity(graph.neighbourhood_labels(a, b, 2), graph.graph_components(a, b)).first()["identity"]
    assert name(atoms, bonds) == name(*other) != name(*molecule(spark, [(0, 1, 1.0), (1, 2, 2.0)], "CCO"))


def test_normalize_graphs(spark):
    rows = [(1, 0, "C", float("nan")), (1, 1, "Zz", 0.1), (1, 2, None, 0.2)]
    got = [r["warnings"] for r in graph.normalize_atoms(spark.createDataFrame(rows, "mol_id long, atom_id int, symbol string, partial_charge double")).orderBy("atom_id").collect()]
    assert got == [["NONFINITE_PARTIAL_CHARGE"], ["UNSUPPORTED_ELEMENT"], ["MISSING_ELEMENT"]]
    with pytest.raises(Exception, match="atom without element"):
        graph.normalize_atoms(spark.createDataFrame(rows, "mol_id long, atom_id int, symbol string, partial_charge double"), strict=True).collect()


def test_distances_and_rings(spark):
    _, bonds = molecule(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0), (3, 4, 1.0)], "CCCCC")
    d = {(r["a"], r["b"]): r["d"] for r in graph.graph_distances(bonds, 5).collect()}
    assert d[(0, 2)] == 2 and d[(0, 3)] == 1 and d[(1, 4)] == 3 and len(d) == 10
    rings = graph.rings_of_closures(bonds)
    assert graph.ring_terms(rings).first()["rings"] == 1


def test_reactions(spark):
    left = spark.createDataFrame([(1, 2, 2.0), (3, 4, 1.0)], "a int, b int, bond_order double")
    right = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0)], "a int, b int, bond_order double")
    kinds = {(r["a"], r["b"]): r["kind"] for r in reactions.bond_changes(left, right, ["a", "b"]).collect()}
    assert kinds == {(1, 2): "order_changed", (3, 4): "broken", (1, 3): "formed", (2, 4): "formed"}
    side = lambda rows: spark.createDataFrame(rows, "reaction int, map int, element string, charge int")
    l, r = side([(1, 1, "C", 0), (2, None, "C", 0), (3, 1, "C", 0)]), side([(1, 1, "C", 0), (2, 1, "C", 0), (3, 1, "N", 0)])  # noqa: E741
    got = {x["reaction"]: x["code"] for x in reactions.check_mapping(l, r).collect()}
    assert got == {1: None, 2: "REACTION_MAPPING_MISSING", 3: "REACTION_NOT_BALANCED"}
    status = reactions.check_mapping(l, r).select("reaction", "status")
    delta = spark.createDataFrame([(1, 2.0)], "reaction int, delta double")
    terms = spark.createDataFrame([(1, "formed", 1, 2.0)], "reaction int, kind string, n int, change double")
    its = {x["reaction"]: x["score"] for x in reactions.score_its(delta, terms, {"formed": 0.5}, status).collect()}
    assert its == {1: 3.0, 2: None, 3: None}


def test_screening(spark):
    df = spark.createDataFrame([(1, 5.0, 0), (2, 1.0, 1), (3, None, 2)], "item int, score double, ix int")
    got = {r["item"]: (r["final"], r["status"]) for r in reactions.screen(df, 1, lambda x: x.withColumn("value", F.lit(9.0))).collect()}
    assert got == {1: (5.0, "screened"), 2: (9.0, "evaluated"), 3: (None, "failed")}
    assert [r["item"] for r in reactions.sort_reactions(df).collect()] == [2, 1, 3]


def test_diverse_sample_against_a_loop(spark):
    rnd = np.random.default_rng(1)
    sets = {(g, k): set(rnd.choice(30, 8, replace=False).tolist()) for g in range(2) for k in range(12)}
    rows = [(k, g, int(b)) for (g, k), bits in sets.items() for b in bits] + [(90, 5, 1), (91, 5, 2)]
    got = {(r["grp"], r["item"]): r["rank"] for r in cohort.diverse_sample(spark.createDataFrame(rows, "item long, grp int, bit int"), 4).collect()}
    import hashlib

    for g in range(2):
        h = {k: hashlib.sha256(f"diverse:{g}:{k}".encode()).hexdigest() for k in range(12)}
        picked = [min(h, key=h.get)]
        far = lambda a, b: 1 - len(sets[(g, a)] & sets[(g, b)]) / len(sets[(g, a)] | sets[(g, b)])  # noqa: E731, B023
        while len(picked) < 4:
            picked.append(min((k for k in h if k not in picked), key=lambda k: (-round(min(far(k, p) for p in picked), 12), h[k])))  # noqa: B023
        assert {k: r for (gg, k), r in got.items() if gg == g} == {k: n + 1 for n, k in enumerate(picked)}
    assert sum(g == 5 for g, _ in got) == 2


def test_component_split_fold(spark):
    comps = spark.createDataFrame([(k, k // 3) for k in range(30)], "grp long, comp long")
    got = cohort.assign_components(comps, {"training": 0.5, "external": 0.5}).collect()
    per = {s: sum(r["size"] for r in got if r["split"] == s) for s in ("training", "external")}
    assert per == {"training": 15, "external": 15} and len(got) == 10


def test_enrichment_resumes(spark):
    manifest = spark.createDataFrame([(k, k) for k in range(6)], "key int, item int")
    done = spark.createDataFrame([(0, 0, "success", 1.0, None, 0), (1, 1, "worker_error", None, "x", 0)], "key int, item int, status string, value double, message string, attempt int")

    def evaluate(x):
        return 10 / (x - 3)

    new = enrich.enrich_pending(manifest, done, evaluate, ["key"], 1, retry=True)
    out = {r["key"]: r["status"] for r in enrich.merge_results(done, new, ["key"]).collect()}
    assert out == {0: "success", 1: "success", 2: "success", 3: "worker_error", 4: "success", 5: "success"}
    assert enrich.enrich_pending(manifest, done, evaluate, ["key"], 1, limit=2).count() == 2
    with pytest.raises(ValueError):
        enrich.pin(spark.createDataFrame([("sha", "a")], "key string, value string"), {"sha": "b"})


def test_ambiguous_and_firewall(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [r["v"] for r in prep.drop_ambiguous(df, "k").collect()] == ["c"]
    train = spark.createDataFrame([("x", "g1")], "ident string, grp string")
    ev = spark.createDataFrame([("x", "g2", 1.0), ("y", "g2", 2.0), ("z", "g2", 3.0), ("p", "g1", 1.0), ("q", "g3", 1.0), ("r", "g3", 2.0), ("s", "g3", 3.0)], "ident string, grp string, label double")
    assert {r["ident"] for r in prep.apply_firewall(ev, train, "ident", True).collect()} == {"y", "z", "q", "r", "s"}
    assert {r["ident"] for r in prep.apply_firewall(ev, train, "ident").collect()} == {"q", "r", "s"}


def test_sources(spark, tmp_path):
    (tmp_path / "in.txt").write_text("A x\n\n# no\n B\n")
    assert [r["item"] for r in tables.read_lines(spark, f"file://{tmp_path}/in.txt").orderBy("ix").collect()] == ["A", "B"]
    w = spark.createDataFrame([("b", 1.0, 0.0, 2.0), ("a", 0.5, 0.1, 1.0)], "name string, weight double, mean double, scale double")
    tables.save_model({"intercept": 1.5, "q99": 100.0}, w, f"file://{tmp_path}/model")
    card, back = tables.load_model(spark, f"file://{tmp_path}/model/*.txt")
    assert card == {"intercept": 1.5, "q99": 100.0} and sorted(map(tuple, back.collect())) == sorted(map(tuple, w.collect()))
    (tmp_path / "bad.json").write_text('{"schema_version": 2}')
    with pytest.raises(ValueError):
        tables.load_model(spark, f"file://{tmp_path}/bad.json")
    with pytest.raises(ValueError, match="y, z"):
        tables.require_columns(w, ["name", "y", "z"])
    assert tables.scan_files(spark, f"file://{tmp_path}", "*.json", 1).first()["length"] == 21
    with pytest.raises(Exception, match="expected split"):
        tables.read_manifest(spark.createDataFrame([("a", "val")], "item string, split string"), "train").collect()


def test_stream_scores_as_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"x": 2.0, "u": 1.0}), ("b", {})], "item string, features map<string,double>")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = scoring.score_stream(stream, {"x": 0.5}, 1.0).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["item"]: r["prediction"] for r in spark.table("scored").collect()}
    assert got == {"a": 2.0, "b": 1.0} == {r["item"]: r["prediction"] for r in scoring.score_stream(rows, {"x": 0.5}, 1.0).collect()}


def test_scores_use_every_weight(spark):
    n = 5000
    items = spark.createDataFrame([(1, "g", 0.0)], "item long, grp string, label double")
    features = spark.range(n).select(F.lit(1).cast("long").alias("item"), F.lit("g").alias("grp"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.lit(1.0).alias("value"))
    weights = features.select("name", F.lit(1.0).alias("weight"))
    assert linear.score_linear(items, features, weights).first()["prediction"] == n
    assert linear.contributions(features, weights).count() == n
    assert loops.with_small(features, weights, "name", most=10).count() == n
    assert abs(linear.group_distance(features, weights.withColumnRenamed("weight", "scale")).first()["distance"] - 1) < 1e-12


def test_unseen_elements_beyond_a_thousand(spark):
    rows = spark.range(1500).select(F.col("id").alias("item"), F.col("id").cast("string").alias("grp"), F.array(F.concat(F.lit("E"), F.col("id").cast("string"))).alias("elements"))
    assert prep.drop_unseen(rows, rows).count() == 1500
    assert prep.drop_unseen(rows, rows.where("item <> 7")).count() == 1499


def test_pi_rules(spark):
    """Atoms one by one: element, charge, hydrogens, aromatic, radical, order of the one bond."""
    cases = [
        ("C", 0, 1, True, 0, 1.0, 1, "aromatic_carbon"),
        ("C", 1, 1, True, 0, 1.0, 0, "aromatic_carbon"),
        ("C", -1, 1, True, 0, 1.0, 2, "aromatic_carbon"),
        ("N", 0, 0, True, 0, 1.0, 1, "pyridine_like"),
        ("N", 0, 1, True, 0, 1.0, 2, "pyrrole_like"),
        ("N", -1, 0, True, 0, 1.0, 2, "anionic_nitrogen"),
        ("O", 0, 0, True, 0, 1.0, 2, "aromatic_donor"),
        ("S", 0, 0, True, 0, 1.0, 2, "aromatic_donor"),
        ("C", 2, 0, True, 0, 1.0, None, "charge_out_of_range"),
        ("C", 0, 2, False, 0, 2.0, 1, "double_bond_carbon"),
        ("C", 1, 2, False, 0, 2.0, 0, "double_bond_carbon"),
        ("O", 0, 0, False, 0, 2.0, 1, "double_bond_hetero"),
        ("O", -1, 0, False, 0, 2.0, 2, "double_bond_hetero"),
        ("C", 0, 1, False, 0, 3.0, None, "triple_bond"),
        ("C", 0, 1, True, 1, 2.0, None, "open_shell"),
        ("P", 0, 0, True, 0, 2.0, None, "unsupported_element"),
        ("O", 0, 1, False, 0, 1.0, None, "none"),
    ]
    atoms = [(k, 0, e, q, h, a, r) for k, (e, q, h, a, r, *_) in enumerate(cases)] + [(k, 1, "C", 0, 3, False, 0) for k in range(len(cases))]
    atoms = spark.createDataFrame(atoms, "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, aromatic boolean, radical_electrons int")
    bonds = spark.createDataFrame([(k, 0, 1, c[5]) for k, c in enumerate(cases)], "mol_id long, a int, b int, bond_order double")
    got = {r["mol_id"]: r for r in graph.assign_pi(atoms, bonds).where("atom_id = 0").collect()}
    for k, c in enumerate(cases):
        assert (got[k]["electrons"], got[k]["reason"], got[k]["included"]) == (c[6], c[7], c[6] is not None)


def test_valence_and_radicals(spark):
    rows = [(1, 0, "B", 3, 0, True), (1, 1, "N", 3, 0, True), (1, 2, "O", 2, 0, True), (1, 3, "C", 4, 0, False), (1, 4, "C", 0, 1, False), (1, 5, "Xx", 0, 0, False), (1, 6, "F", 1, 0, False)]
    atoms = spark.createDataFrame([r[:5] for r in rows], "mol_id long, atom_id int, element string, total_hcount int, radical_electrons int")
    none = spark.createDataFrame([], "mol_id long, a int, b int, bond_order double")
    assert {r["atom_id"]: r["allowed"] for r in reactions.valence_allowed(atoms, none).collect()} == {r[1]: r[5] for r in rows}


def test_pair_scores_add_both_directions(spark):
    row = (1, 0, 1, -1.0, 0.5, 0.4, 0.3, 0.2, 1.0, -1.0, 0.5, 0.4, 0.3, -0.1, 0.5)
    names = ["mol_id", "a", "b"] + [f"{c}_{x}" for x in "ab" for c in ("homo", "lumo", "hd", "ld", "q", "acc")]
    got = reactions.score_pairs(spark.createDataFrame([row], names)).first()
    fmo, soft = 0.4 * 0.3 / 1.5, 1 / 0.75
    assert abs(got["fmo_a_to_b"] - fmo) < 1e-12 and got["direction"] == "mixed" and got["codes"] == []
    assert abs(got["score"] - (2 * fmo + 0.25 * soft * soft * 2 * 0.12 + 0.05 * 0.02 + 0.1 * 1.5)) < 1e-12


def test_concordance_against_pairs(spark):
    rnd = random.Random(2)
    rows = [(g, k, float(rnd.randint(0, n)), rnd.randint(0, n) / 3) for g, n in (("a", 40), ("b", 3), ("c", 1), (None, 9)) for k in range(n * 3)] + [("one", 1, 1.0, 2.0)]
    got = {r["grp"]: r["concordance"] for r in metrics.concordance(spark.createDataFrame(rows, "grp string, item long, label double, prediction double")).collect()}
    for g in {r[0] for r in rows}:
        own = [r[2:] for r in rows if r[0] == g]
        scores = [0.5 if p == q or x == y else float((x < y) == (p < q)) for i, (x, p) in enumerate(own) for y, q in own[:i]]
        assert (g in got) == bool(scores) and (not scores or abs(got[g] - sum(scores) / len(scores)) < 1e-12)


def test_quantiles_and_ranks_of_groups_over_many_ranges(spark):
    rnd = random.Random(4)
    rows = [("big", float(rnd.randint(0, 300))) for _ in range(3000)] + [("small", 5.0), (None, 1.0), (None, 2.0), ("small", None)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    got = {r["grp"]: r for r in ordering.quantiles(df, "v", {"q1": 0.25, "q9": 0.99}, "grp").collect()}
    big = [v for g, v in rows if g == "big"]
    assert np.allclose([got["big"]["q1"], got["big"]["q9"]], np.quantile(big, [0.25, 0.99])) and got[None]["q1"] == 1.25 and got["small"]["q9"] == 5.0
    ranks = {(r["grp"], r["v"]): r["rank"] for r in ordering.average_ranks(df, ["grp"], "v", "rank").collect()}
    assert all(ranks["big", v] == sum(x < v for x in big) + (big.count(v) + 1) / 2 for v in set(big[:50]))


@pytest.mark.parametrize("run", [65_536, 2])
def test_assign_components_is_the_greedy_choice(spark, monkeypatch, run):
    monkeypatch.setattr(cohort, "RUN", run)
    sizes = [9, 7, 7, 7, 4, 4, 4, 4, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    rows = [(c * 100 + k, c) for c, n in enumerate(sizes) for k in range(n)]
    shares = {"training": 0.7, "validation": 0.1, "external": 0.2}
    got = {r["comp"]: r["split"] for r in cohort.assign_components(spark.createDataFrame(rows, "grp long, comp long"), shares).collect()}
    order = sorted(range(len(sizes)), key=lambda c: (-sizes[c], hashlib.sha256(f"component: {c}".encode()).hexdigest()))
    total, held, want = sum(sizes), dict.fromkeys(shares, 0), {}
    for c in order:
        want[c] = min(shares, key=lambda s: (held[s] + sizes[c] - total * shares[s]) ** 2 - (held[s] - total * shares[s]) ** 2)
        held[want[c]] += sizes[c]
    assert got == want


def test_nearest_similarity_in_blocks(spark):
    rnd = random.Random(8)
    sets = {k: set(rnd.sample(range(40), rnd.randint(1, 12))) for k in range(60)}
    df = spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "item long, bit int")
    got = {r["item"]: r["nearest"] for r in cohort.nearest_similarity(df.where("item < 20"), df, block=7).collect()}
    want = {k: max(len(sets[k] & s) / len(sets[k] | s) for j, s in sets.items() if j != k) for k in range(20)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_candidates_without_an_energy_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 1, None)], "item long, candidate long, energy double")
    assert reactions.lowest_per_item(df.where("item = 1")).first()["candidate"] == 2
    with pytest.raises(Exception, match="no candidate"):
        reactions.lowest_per_item(df).collect()


def test_a_cluster_must_name_its_folder(spark):
    from types import SimpleNamespace as Stand

    assert loops.shared_folder(spark, "x").split("/")[-1].startswith("x-")
    context = Stand(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = Stand(sparkContext=context, conf=Stand(get=lambda name, default: default))
    with pytest.raises(ValueError, match="all executors share"):
        loops.checkpointed(Stand(sparkSession=session))
