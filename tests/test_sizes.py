"""Cases that only larger tables meet: labels that no term follows, many small molecules, tables that are small on disk only."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortal.operators import cohort, graph, linear, metrics, motifs, nested, packed, prep, studies
from cohortal.plans import bindings as B
from cohortal.plans import queries as Q


def _unrelated(spark):
    """Items whose labels no term follows: every label stands at both values of the term."""
    rows = spark.range(400).select(F.col("id").alias("item"), (F.col("id") % 10).cast("string").alias("grp"), (F.floor(F.col("id") / 10) % 2).cast("double").alias("value"), (F.floor(F.col("id") / 20) % 4).cast("double").alias("label"))
    return rows.select("item", "grp", "label"), rows.where("value <> 0").select("item", "grp", F.lit("t").alias("name"), "value")


def test_without_a_stable_term(spark):
    items, features = _unrelated(spark)
    found = studies.tune_support(items, features, [0.05, 0.1], [1.0], 2).collect()
    assert sorted((r["lasso"], r["alpha"], r["terms"]) for r in found) == [(0.05, 1.0, 0), (0.1, 1.0, 0)]
    weights, q99 = studies.fit_final(items, features, 0.05, 1.0, 2)
    assert weights.columns == ["name", "weight", "mean", "scale"] and weights.collect() == [] and q99 is None
    study = nested.nested_study(items, features, {"t": 1.0}, [0.05], [1.0], 2, 2)
    assert all(c["terms"] == [] and c["lasso"] is None for c in study.choices)
    assert {r["prediction"] for r in study.predictions.where("model = 'expanded'").collect()} == {0.0}
    assert study.predictions.where("model = 'expanded'").count() == 400


def test_molecules_as_rows_and_by_joins(spark, sf_dir):
    atoms, bonds = B.atoms(spark, sf_dir).where("mol_id < 400"), B.bonds(spark, sf_dir, several=True).where("mol_id < 400")
    every = lambda df: sorted(map(tuple, df.collect()))
    assert every(graph.graph_components(atoms, bonds)) == every(graph.graph_components(atoms, bonds, most=3))
    assert every(graph.neighbourhood_labels(atoms, bonds, 2)) == every(graph.neighbourhood_labels(atoms, bonds, 2, most=3))
    assert every(graph.symmetry_terms(graph.stable_classes(atoms, bonds))) == every(graph.symmetry_terms(graph.stable_classes(atoms, bonds, most=3)))


def test_rigid_pairs_as_rows_and_by_joins(spark, sf_dir):
    atoms, bonds = B.atoms(spark, sf_dir).where("mol_id < 900"), B.bonds(spark, sf_dir).where("mol_id < 900")
    rings = graph.rings_of_closures(bonds)
    every = lambda df: sorted(map(tuple, df.collect()))
    want = every(motifs.rigid_pairs(atoms, bonds, rings, most=4))
    packed = motifs.rigid_pairs(atoms, bonds, rings)
    assert want and every(packed) == want
    assert "Exchange hashpartitioning(mol_id" not in _plan(Q.QUERIES["rigid_pairs"](spark, sf_dir))


def test_moments_as_rows_and_by_joins(spark):
    entries = [(1, 1, 1, 1, 0.5), (1, 1, 1, 2, -1.0), (1, 1, 2, 1, -1.0), (1, 1, 2, 2, 0.25), (1, 1, 2, 3, 2.0), (1, 1, 3, 2, 2.0), (1, 7, 7, 7, 3.0), (2, 4, 4, 4, -1.5), (2, 4, 4, 5, 1.0), (2, 4, 4, 5, 1.0), (2, 4, 5, 4, 2.0)]
    matrix = spark.createDataFrame(entries, "mol_id long, system int, i int, j int, value double")
    want = {}
    for m, s in {(e[0], e[1]) for e in entries}:
        at = {x: k for k, x in enumerate(sorted({e[2] for e in entries if e[:2] == (m, s)}))}
        a = np.zeros((len(at),) * 2)
        for e in entries:
            if e[:2] == (m, s):
                a[at[e[2]], at[e[3]]] += e[4]
        want[m] = want.get(m, np.zeros(3)) + [np.trace(np.linalg.matrix_power(a, k)) / len(at) for k in (2, 3, 4)]
    for most in (0, 4, 100):
        got = {r["mol_id"]: r[1:] for r in graph.spectral_moments(matrix, most=most).collect()}
        assert set(got) == {1, 2} and all(np.allclose(got[m], want[m]) for m in want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_inside_molecules_and_nothing_broadcast(spark, sf_dir):
    for name in ("graph_identity", "symmetry_terms", "exocyclic_bonds", "feature_families"):
        plan = _plan(Q.QUERIES[name](spark, sf_dir))
        assert "BroadcastExchange" not in plan, name
        assert name == "feature_families" or "Exchange hashpartitioning(mol_id" not in plan, name  # names of three kinds are put together first


def test_pairs_of_blocks(spark):
    sets = {k: {j for j in range(9) if (k * (j + 3)) % 5 < 2} for k in range(40)}
    rows = [(k, k % 3, j) for k, own in sets.items() for j in own]
    bits = spark.createDataFrame(rows, "item long, grp int, bit int")
    want = {(a % 3, a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and a % 3 == b % 3 and sets[a] & sets[b]}
    for block in (4, 512):
        found = cohort.tanimoto_pairs(bits, block)
        assert [f.dataType.simpleString() for f in found.schema] == ["int", "bigint", "bigint", "double"]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_words(spark, sf_dir):
    """Sets of several words, some at their ends, give the pairs that matrix products give; null groups, items and bits give none."""
    near = lambda k: {-70, 57, 58, -7, 249} if k % 9 == 0 else {(k * (j + 3)) % 320 - 70 for j in range(11)}
    sets = {k: near(k) for k in range(60)}
    rows = [(k, "ab"[k % 2], j) for k, own in sets.items() for j in own] + [(90, None, 3), (91, "a", None), (None, "a", 3)]
    bits = spark.createDataFrame(rows, "item long, grp string, bit int")
    want = {("ab"[a % 2], a, b, math.floor(len(sets[a] & sets[b]) * 1e6 / len(sets[a] | sets[b]) + 0.5) / 1e6) for a in sets for b in sets if a < b and (a - b) % 2 == 0 and sets[a] & sets[b]}
    for block, most in ((4, 16), (None, 16), (7, 0), (None, 4)):
        got = [tuple(r) for r in cohort.tanimoto_pairs(bits, block, 6, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert cohort.tanimoto_pairs(bits.limit(0)).collect() == []
    plan = _plan(Q.QUERIES["tanimoto_pairs"](spark, sf_dir))
    assert "MapInArrow" not in plan and "round(" not in plan and "Generate inline" not in plan


ODD_ATOMS = [(1, k, "CNOS"[k % 4], k % 3 == 0, k % 2 - (k == 4), k % 2, ("SP", "SP3")[k % 2], k % 3) for k in range(1, 8)] + [(2, 9, "C", False, 0, 1, "SP2", 0), (3, 5, "O", True, -1, 0, "SP3", 1), (3, 2, "N", True, 0, 0, "SP3", 1)]
ODD_BONDS = [(1, a, b, o, a % 3 == 0, b % 2 == 0) for a, b, o in [(1, 2, 2.0), (2, 3, 1.5), (3, 1, 1.0), (3, 4, 2.0), (3, 4, 2.0), (4, 5, 2.0), (5, 6, 2.0), (6, 6, 2.0), (6, 2, 3.0), (7, 99, 2.0), (99, 1, 2.0)]] + [(3, 5, 2, 1.0, True, False), (4, 1, 2, 2.0, False, True)]


def _odd(spark, sf_dir):
    """Molecules of the tables beside some with rings, repeated bonds, bonds of one atom, bonds whose ends are no atoms, and none at all."""
    atoms = B.atoms(spark, sf_dir).where("mol_id < 900").select((F.col("mol_id") + 100).alias("mol_id"), "atom_id", "element", "aromatic", "formal_charge", "total_hcount", "hybridization", "lone_pairs")
    bonds = B.bonds(spark, sf_dir).where("mol_id < 900").select((F.col("mol_id") + 100).alias("mol_id"), "a", "b", "bond_order", "bond_aromatic", "conjugated")
    odd = spark.createDataFrame(ODD_ATOMS, "mol_id long, atom_id int, element string, aromatic boolean, formal_charge int, total_hcount int, hybridization string, lone_pairs int")
    return atoms.unionByName(odd), bonds.unionByName(spark.createDataFrame(ODD_BONDS, "mol_id long, a int, b int, bond_order double, bond_aromatic boolean, conjugated boolean"))


def _every(df):
    return sorted(map(tuple, df.collect()))


def test_signatures_inside_tasks_and_by_joins(spark, sf_dir, monkeypatch):
    atoms, bonds = _odd(spark, sf_dir)
    want = _every(graph.hashed_signatures(graph.local_signatures(atoms, bonds, graph.graph_distances(bonds, 4))))
    for rows, size in ((50, 256), (65_536, 256), (50, 4), (50, 0)):  # molecules over the end of a batch, and molecules by joins
        monkeypatch.setattr(packed, "ROWS", rows)
        assert want and _every(graph.signature_bins(atoms, bonds, size=size)) == want
    assert _every(graph.signature_bins(atoms.limit(0), bonds.limit(0))) == []
    plan = _plan(Q.QUERIES["local_signatures"](spark, sf_dir))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_resonance_inside_tasks_and_by_joins(spark, sf_dir, monkeypatch):
    atoms, bonds = _odd(spark, sf_dir)
    want = _every(graph.resonance_terms(atoms, bonds, most=0))
    for rows, most in ((50, 256), (65_536, 256), (50, 4)):
        monkeypatch.setattr(packed, "ROWS", rows)
        assert want and _every(graph.resonance_terms(atoms, bonds, most=most)) == want
    assert _every(graph.resonance_terms(atoms.limit(0), bonds.limit(0))) == []
    plan = _plan(Q.QUERIES["resonance_terms"](spark, sf_dir))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_symmetry_is_refined_to_the_end(spark, sf_dir, tmp_path, monkeypatch):
    atoms, bonds = _odd(spark, sf_dir)
    chain = spark.createDataFrame([(7, k, "C", False, 0, 0, "SP3", 0) for k in range(15)], atoms.schema)
    atoms, bonds = atoms.unionByName(chain), bonds.unionByName(spark.createDataFrame([(7, k, k + 1, 1.0, False, False) for k in range(14)], bonds.schema))
    rounded = lambda df: {r["mol_id"]: (r["classes"], r["equivalent_pairs"], round(r["entropy"], 9)) for r in df.collect()}
    want = rounded(graph.stable_symmetry(atoms, bonds, most=0))
    assert want[7][:2] == (8, 7) and len(want) == atoms.select("mol_id").distinct().count()
    for molecules, most in ((3, 256), (2_048, 256), (3, 4)):
        monkeypatch.setattr(packed, "MOLECULES", molecules)
        found = graph.stable_symmetry(atoms, bonds, most=most)
        assert rounded(found) == want and found.count() == len(want)
    assert graph.stable_symmetry(atoms.limit(0), bonds.limit(0)).collect() == []
    # an order of 31 equal lines, which two rounds leave with fewer classes; the query and its SQL
    lines = pq.read_table(f"{sf_dir}/lineitem.parquet").slice(0, 1)
    lines = pa.concat_tables([lines] * 31).set_column(lines.schema.get_field_index("l_partkey"), lines.schema.field("l_partkey"), pa.array(range(31), lines.schema.field("l_partkey").type))
    pq.write_table(lines, tmp_path / "lineitem.parquet")
    got = Q.QUERIES["symmetry_terms"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert [tuple(r) for r in got] == con.execute(Q.SQL["symmetry_terms"]).fetchall()
    twice = graph.symmetry_terms(graph.neighbourhood_labels(B.atoms(spark, str(tmp_path)), B.bonds(spark, str(tmp_path)), 2)).first()
    assert got[0]["classes"] > twice["classes"]


def test_paths_of_dense_molecules_in_parts(monkeypatch):
    n = 9  # of n atoms that are all bonded, any k + 1 in a row are a path
    ends = [(a, b) for a in range(n) for b in range(a)]
    table = pa.table({"mol_id": [7] * (n + len(ends)), "a": [*range(n), *(a for a, _ in ends)], "b": pa.array([None] * n + [b for _, b in ends], pa.int64()), "aromatic": [False] * (n + len(ends)), "bond": [False] * n + [True] * len(ends)})
    monkeypatch.setattr(packed, "MOST_WALKS", 100)
    assert packed._resonance(table, np.array([0])).to_pylist() == [{"mol_id": 7, "components": 1, "sites": n, "largest": n, "branch_centres": n, "cross_conjugated": n} | {f"paths_{k}": math.perm(n, k + 1) // 2 for k in (2, 3, 4)}]


def test_pi_systems_make_pi_once(spark, sf_dir):
    atoms, bonds = _odd(spark, sf_dir)
    pi = graph.assign_pi(atoms, bonds)
    want = _every(graph.pi_systems(pi, bonds))
    assert want and _every(graph.pi_systems(pi, bonds, graph.molecule_sizes(atoms, bonds))) == want
    on = pi.where("included").select("mol_id", "atom_id", "electrons")
    by_joins = graph.graph_components(on, graph.coupled(pi, bonds), most=0, keep=("electrons",))
    assert _every(by_joins) == _every(graph.graph_components(on, graph.coupled(pi, bonds), keep=("electrons",)))
    plan = _plan(Q.QUERIES["pi_systems"](spark, sf_dir))
    assert plan.count("SortMergeJoin") == 6 and "Exchange" not in plan  # pi three times, two ends of bonds, and a molecule's atoms with its bonds


def test_components_take_a_bond_once(spark, sf_dir):
    atoms, bonds = _odd(spark, sf_dir)
    assert _every(graph.graph_components(atoms, bonds)) == _every(graph.graph_components(atoms, bonds, most=0))
    plan = _plan(Q.QUERIES["graph_components"](spark, sf_dir))
    assert plan.count("Generate") == 1 and "Exchange" not in plan


def test_external_evaluation_sums_features_of_sampled_items_alone(spark, sf_dir):
    items, features, weights = B.mol_items(spark, sf_dir), B.features(spark, sf_dir), linear.weights_frame(spark, Q.WEIGHTS)
    split = items.withColumn("split", cohort.split_of(F.col("grp")))
    clean = prep.apply_firewall(prep.rankable_groups(split.where("split = 'external'")), split.where("split = 'training'"), "item", by_group_first=True)
    plain = linear.score_linear(prep.rankable_groups(cohort.sample_group(prep.rankable_groups(clean), "evaluation", 3).drop("place")), features, weights)
    columns = ["item", "grp", "label", "split", "prediction"]
    found = studies.external_scores(items, features, weights, 3)
    want = _every(metrics.gates(metrics.summarize_groups(metrics.rank_metrics(plain)), {"has_groups": F.col("groups") > 0, "positive_pearson": F.col("pearson") > 0, "beats_chance": F.col("top1") > F.col("chance_top1")}))
    assert found.count() > 20 and _every(found.select(*columns)) == _every(plain.select(*columns))
    assert want and _every(studies.evaluate_external(items, features, weights, 3)) == want
    plan = _plan(studies.evaluate_external(items, features, weights, 3))
    assert "molecules_" not in plan and "features_" not in plan  # later steps read what was sampled and scored
