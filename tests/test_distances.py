"""Shortest paths of any length against plain breadth-first search, in one task a molecule and by joins."""

import random
from collections import Counter, deque

import pytest

from cohortal.operators import distances, graph


def brute(bonds):
    near = {}
    for m, a, b in bonds:
        if a is not None and b is not None and a != b:
            near.setdefault((m, a), set()).add(b)
            near.setdefault((m, b), set()).add(a)
    out = {}
    for m, a in near:
        seen, queue = {a: 0}, deque([a])
        while queue:
            x = queue.popleft()
            for y in near[(m, x)]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        out |= {(m, a, b): d for b, d in seen.items() if a < b}
    return out


def graphs(seed):
    rnd = random.Random(seed)
    bonds = [(1, k, k + 1) for k in range(70)] + [(2, k, (k + 1) % 9) for k in range(9)] + [(3, 5, 5), (4, 1, None), (5, 1, 2), (5, 2, 1), (5, 1, 2), (6, -3, 7), (6, 7, 100)]
    for m in range(10, 16):
        n = rnd.randint(2, 14)
        bonds += [(m, rnd.randrange(n), rnd.randrange(n)) for _ in range(n)]
    return bonds


def frame(spark, bonds):
    return spark.createDataFrame(bonds, "mol_id long, a int, b int")


@pytest.mark.parametrize("most", [4096, 12, 0])
def test_distances_of_any_length(spark, most):
    bonds = graphs(1)
    if most != 4096:
        bonds = [b for b in bonds if b[0] != 1 or b[1] < 6]  # joins go a length a round
    got = distances.graph_distances(frame(spark, bonds), None, most)
    assert [f.name for f in got.schema] == ["mol_id", "a", "b", "d"]
    rows = got.collect()
    want = brute(bonds)
    assert {(r["mol_id"], r["a"], r["b"]): r["d"] for r in rows} == want and len(rows) == len(want)
    assert most != 4096 or max(want.values()) == 70


@pytest.mark.parametrize("most", [4096, 0])
def test_cutoff_and_profile(spark, most):
    bonds = [b for b in graphs(2) if b[0] != 1]
    want = {k: d for k, d in brute(bonds).items() if d <= 3}
    got = {(r["mol_id"], r["a"], r["b"]): r["d"] for r in distances.graph_distances(frame(spark, bonds), 3, most).collect()}
    assert got == want
    profile = {(r["mol_id"], r["d"]): r["n"] for r in distances.path_profile(frame(spark, bonds), 3, most).collect()}
    assert profile == Counter((m, d) for (m, _, _), d in want.items())


def test_indices_of_a_long_chain(spark):
    n = 40
    got = distances.path_indices(distances.path_profile(frame(spark, [(1, k, k + 1) for k in range(n - 1)]))).first()
    assert got["wiener"] == n * (n * n - 1) // 6
    assert abs(got["harary"] - sum((n - d) / d for d in range(1, n))) < 1e-9
    assert abs(got["mean_distance"] - (n + 1) / 3) < 1e-9


def test_empty_table(spark):
    none = frame(spark, [(1, 0, 1)]).limit(0)
    assert distances.graph_distances(none).count() == distances.path_profile(none).count() == 0


def test_skeleton_has_no_path_through_other_elements(spark):
    atoms = spark.createDataFrame([(1, k, e) for k, e in enumerate("CCCNCC")] + [(2, 0, "N"), (2, 1, "C")], "mol_id long, atom_id int, element string")
    bonds = frame(spark, [(1, k, k + 1) for k in range(5)] + [(2, 0, 1)])
    got = {r["mol_id"]: (r["pairs"], r["mean_distance"]) for r in distances.skeleton_indices(atoms, bonds).collect()}
    assert got == {1: (4, 1.25), 2: (0, 0.0)}  # C-C-C: 1, 1, 2; C-C: 1


def test_charge_decay(spark):
    rows = [(1, 0, 0.25, True, False), (1, 1, -0.25, False, False), (1, 2, -0.5, False, True), (2, 0, 0.1, True, True)]
    atoms = spark.createDataFrame(rows, "mol_id long, atom_id int, partial_charge double, donor boolean, acceptor boolean")
    bonds = frame(spark, [(1, 0, 1), (1, 1, 2)])
    got = {r["mol_id"]: tuple(r)[1:] for r in graph.charge_decay(atoms, bonds, distances.graph_distances(bonds)).collect()}
    assert got[1] == (0.5 * 0.5 + 0.25 * 0.5 + 0.75 * 0.25, -0.0625 * 0.5 + 0.125 * 0.5 - 0.125 * 0.25, 0.75, 0.0, 0.0, 1)
    assert got[2] == (0.0, 0.0, 0.0, 0.0, 0.0, 0)


def classes(n, bonds):
    """Sorted class sizes of plain colour refinement from degrees, and the number of rounds that split something."""
    near = [[b for a, b in [*bonds, *((y, x) for x, y in bonds)] if a == k] for k in range(n)]
    colour, rounds = [len(x) for x in near], 0
    while True:
        new = [(colour[k], tuple(sorted(colour[j] for j in near[k]))) for k in range(n)]
        if len(set(new)) == len(set(colour)):
            return sorted(Counter(colour).values()), rounds
        names = {c: k for k, c in enumerate(sorted(set(new)))}
        colour, rounds = [names[c] for c in new], rounds + 1


def test_classes_are_refined_until_none_splits(spark):
    shapes = {1: (15, [(k, k + 1) for k in range(14)]), 2: (6, [(k, (k + 1) % 6) for k in range(6)]), 3: (7, [(0, 1), (1, 2), (2, 3), (3, 4), (2, 5), (5, 6)]), 4: (1, [])}
    atoms = spark.createDataFrame([(m, k, "C", 0, 0, False) for m, (n, _) in shapes.items() for k in range(n)], "mol_id long, atom_id int, element string, total_hcount int, formal_charge int, aromatic boolean")
    bonds = spark.createDataFrame([(m, a, b, 1.0) for m, (_, e) in shapes.items() for a, b in e], "mol_id long, a int, b int, bond_order double")
    got = graph.stable_classes(atoms, bonds).collect()
    for m, (n, e) in shapes.items():
        assert sorted(Counter(r["label"] for r in got if r["mol_id"] == m).values()) == classes(n, e)[0]
    assert classes(*shapes[1])[1] > 2 and len(got) == 29
    terms = {r["mol_id"]: (r["classes"], r["equivalent_pairs"]) for r in graph.symmetry_terms(graph.stable_classes(atoms, bonds)).collect()}
    assert terms == {1: (8, 7), 2: (1, 15), 3: (3, 6), 4: (1, 0)}
