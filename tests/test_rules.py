"""Hand-made cases of the graph and pair rules."""

import math

import pytest
from pyspark.sql import functions as F

from cohortal.operators import graph, motifs, reactions


def bonds_of(spark, rows):
    return spark.createDataFrame([(m, a, b, float(o)) for m, a, b, o in rows], "mol_id long, a int, b int, bond_order double")


def rings_of(spark, rings):
    return spark.createDataFrame([(m, r, atom, pos) for m, r, atoms in rings for pos, atom in enumerate(atoms)], "mol_id long, ring int, atom_id int, pos int")


def test_moments_are_sums_over_systems(spark):
    """Two systems of one molecule: each trace is over its own size."""
    matrix = spark.createDataFrame([(1, 1, 1, 1, 1.0), (1, 1, 1, 2, 2.0), (1, 1, 2, 1, 2.0), (1, 1, 2, 2, 0.0), (1, 5, 5, 5, 3.0)], "mol_id long, system int, i int, j int, value double")
    got = graph.spectral_moments(matrix).first()
    # [[1, 2], [2, 0]]: traces of its powers are 9, 13 and 49
    assert (got["m2"], got["m3"], got["m4"]) == (9 / 2 + 9, 13 / 2 + 27, 49 / 2 + 81)


def test_matrix_names_systems_and_refuses_unknown_parameters(spark):
    atoms = spark.createDataFrame([(1, k, e, 0, 0, False) for k, e in enumerate("CCSCC")], "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, aromatic boolean")
    bonds = bonds_of(spark, [(1, 0, 1, 2), (1, 1, 2, 1), (1, 2, 3, 1), (1, 3, 4, 2)])
    pi = graph.assign_pi(atoms, bonds)
    rows = graph.pi_matrix(pi, atoms, bonds, {"C": 0.5}, {2.0: -1.0}).collect()
    assert sorted((r["system"], r["i"], r["j"], r["value"]) for r in rows) == [(0, 0, 0, 0.5), (0, 0, 1, -1.0), (0, 1, 0, -1.0), (0, 1, 1, 0.5), (3, 3, 3, 0.5), (3, 3, 4, -1.0), (3, 4, 3, -1.0), (3, 4, 4, 0.5)]
    for alpha, beta, what in (({"N": 1.0}, {2.0: -1.0}, "element C"), ({"C": 0.0}, {1.0: -1.0}, "bond order 2.0")):
        with pytest.raises(Exception, match=f"no parameter for {what}"):
            graph.pi_matrix(pi, atoms, bonds, alpha, beta).collect()


def test_ring_tables(spark):
    """Three squares around one side, and a nine-ring: a shared side counts once, strain by further memberships of atoms."""
    rings = rings_of(spark, [(1, 1, [1, 2, 3, 4]), (1, 2, [1, 2, 5, 6]), (1, 3, [1, 2, 7, 8]), (2, 1, list(range(9)))])
    terms = {r["mol_id"]: r for r in graph.ring_terms(rings).collect()}
    assert (terms[1]["shared_sides"], terms[1]["junctions"], terms[1]["fused"]) == (1, 2, 3) and terms[2]["shared_sides"] == 0
    strain = {r["mol_id"]: r["strain"] for r in graph.ring_strain(rings, {4: 1.5}, 0.25, 0.75).collect()}
    assert strain == {1: 3 * 1.5 + 4 * 0.25, 2: 0.75}
    bonds = bonds_of(spark, [(1, 1, 2, 2), (2, 0, 1, 1)])
    small = {r["mol_id"]: r for r in graph.small_ring_terms(rings, bonds).collect()}
    assert small[1]["size_deviation"] == 12.0 and small[1]["size_variance"] == 0.0 and small[2]["size_deviation"] == 9.0
    mixed = graph.small_ring_terms(rings_of(spark, [(1, 1, [1, 2, 3]), (1, 2, [3, 4, 5, 6, 7])]), bonds).first()
    assert mixed["size_deviation"] == 10.0 and mixed["size_variance"] == 1.0


def test_charges_beyond_one(spark):
    atoms = spark.createDataFrame([(1, 0, "N", 2), (1, 1, "C", 0), (1, 2, "O", -1), (1, 3, "N", 1)], "mol_id long, atom_id int, element string, formal_charge int")
    d = spark.createDataFrame([(1, 0, 2, 2), (1, 0, 3, 3), (1, 2, 3, 1)], "mol_id long, a int, b int, d int")
    got = graph.formal_charge_terms(atoms, d, {"N": 1.0}).first()
    assert got["magnitude"] == 4 and got["hardness"] == 5.0
    assert math.isclose(got["like"], 2 / 3) and math.isclose(got["unlike"], 2 / 2 + 1) and math.isclose(got["coulomb"], 2 / 3 - 2)


def test_distances_are_a_half_at_least(spark):
    rows = [(1, 0, 1.0, 0.0, 0.0, 0.0), (1, 1, -1.0, 0.3, 0.0, 0.0), (1, 2, 0.5, 0.0, 2.0, 0.0)]
    coords = spark.createDataFrame(rows, "mol_id long, atom_id int, q double, x double, y double, z double")
    got = graph.pair_distance_terms(coords, bonds_of(spark, [(1, 1, 2, 1)])).first()
    assert math.isclose(got["coulomb"], -1 / 0.5 + 0.5 / 2) and math.isclose(got["overlap"], math.exp(-0.5) + math.exp(-2))


def test_entropy_is_natural(spark):
    labels = spark.createDataFrame([(1, k, "ab"[k > 0]) for k in range(4)], "mol_id long, atom_id int, label string")
    got = graph.symmetry_terms(labels).first()
    assert (got["classes"], got["equivalent_pairs"]) == (2, 3) and math.isclose(got["entropy"], -(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))


def test_a_missing_partial_charge_is_the_formal_one(spark):
    names = ("homo", "lumo", "hd", "ld", "q", "acc", "charge")
    row = (1, 1, 2, *(-1.0, 1.0, 0.5, 0.5, None, 1.0, 1), *(-1.0, 1.0, 0.5, 0.5, -0.25, 1.0, 3))
    schema = "mol_id long, a int, b int, " + ", ".join(f"{n}_{s} {'int' if n == 'charge' else 'double'}" for s in "ab" for n in names)
    got = reactions.score_pairs(spark.createDataFrame([row], schema)).first()
    assert got["charge"] == 0.25 and got["score"] is not None


def test_rigid_pairs_rules(spark):
    """S gives and takes, charge and lone pairs count, conjugated bonds are rigid, and pairs are taken in the order of their text."""
    chain = lambda m: [(m, k, k + 1) for k in range(4)]
    rows = [(m, a, b, 1.0, False, not (m == 3 and a < 2)) for m in (1, 2, 3, 4) for _, a, b in chain(m)]
    bonds = spark.createDataFrame(rows, "mol_id long, a int, b int, bond_order double, bond_aromatic boolean, conjugated boolean")
    ends = {1: (("S", 0, 1, 2), ("O", 0, 0, 2)), 2: (("N", 1, 1, 0), ("O", 0, 0, 2)), 3: (("O", 0, 1, 2), ("O", 0, 0, 2)), 4: (("O", 0, 1, 2), ("N", 0, 0, 0))}
    atoms = [(m, k, *(e[0] if k == 0 else e[1] if k == 4 else ("C", 0, 0, 0))) for m, e in ends.items() for k in range(5)]
    df = spark.createDataFrame(atoms, "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, lone_pairs int")
    got = motifs.rigid_pairs(df, bonds, rings_of(spark, [(9, 1, [0, 1, 2, 3])]))
    # 2: the donor is charged; 3: two flexible bonds; 4: the acceptor has no lone pair
    assert [tuple(r) for r in got.collect()] == [(1, 0, 4, 4)]
    # a twelve-atom path: 10 before 2 in the order of text, so that (10, 6) is taken before (2, 6)
    long = spark.createDataFrame([(1, k, k + 1, 1.0, False, True) for k in range(1, 11)], "mol_id long, a int, b int, bond_order double, bond_aromatic boolean, conjugated boolean")
    marked = {2: ("N", 1, 0), 6: ("O", 0, 2), 10: ("N", 1, 0)}
    df = spark.createDataFrame([(1, k, marked.get(k, ("C", 0, 0))[0], 0, *marked.get(k, ("C", 0, 0))[1:]) for k in range(1, 12)], "mol_id long, atom_id int, element string, formal_charge int, total_hcount int, lone_pairs int")
    found = motifs.rigid_pairs(df, long, rings_of(spark, [(9, 1, [0, 1, 2, 3])])).select("donor", "acceptor", F.col("d")).collect()
    assert [tuple(r) for r in found] == [(10, 6, 4)]
