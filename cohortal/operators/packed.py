"""Work on whole small molecules inside tasks: rows of many molecules at a time, as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ROWS = 65_536  # rows that are worked on together
MOST_WALKS = 2_000_000  # paths that are held together
MOST_HASHED = 200_000  # signatures whose bins a task remembers
MOLECULES = 2_048  # molecules that are rows of arrays and worked on together
SYMMETRY = {"classes": LongType, "equivalent_pairs": LongType, "entropy": DoubleType}
RESONANCE = ("components", "sites", "largest", "branch_centres", "cross_conjugated", "paths_2", "paths_3", "paths_4")


def in_molecules(rows: DataFrame, schema: StructType, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """work(table, starts) on rows(mol_id, ...) of whole molecules, one molecule's after another's; starts are their first places.

    The window has a molecule's rows brought together and leaves them so. A task holds ROWS rows and one molecule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            cut = int(starts[-1])  # the last molecule may go on in the next batch
            if cut:
                yield work(table.slice(0, cut), starts[:-1])
            held, n = table.slice(cut).to_batches(), n - cut
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield work(table, _starts(table))

    return rows.withColumn("_rows", F.count("*").over(Window.partitionBy("mol_id"))).mapInArrow(run, schema)


def _starts(table: pa.Table) -> np.ndarray:
    mol = table.column("mol_id").combine_chunks()
    new = pc.not_equal(mol.slice(1), mol.slice(0, len(mol) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], new]))


class Graph:
    """The rows' atoms (`own`) and bonds (`x`, `y`) as places among all different (molecule, atom), in the order of both.

    Atoms are the rows without a b. Bonds with an end that is null are none.
    """

    def __init__(self, table: pa.Table, starts: np.ndarray) -> None:
        self.mol = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        self.bond = table.column("bond").to_numpy()
        a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
        named = pa.concat_arrays([a, b]).dictionary_encode()
        rank = np.empty(len(named.dictionary) + 1, np.int64)
        rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(named.dictionary))
        rank[-1] = -1
        place = rank[named.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        a, b = place[: len(table)], place[len(table) :]
        self.lines = np.flatnonzero(self.bond & (a >= 0) & (b >= 0))  # rows of bonds
        self.atoms = np.flatnonzero(~self.bond & (a >= 0))  # rows of atoms
        key = lambda rows, c: self.mol[rows] * len(rank) + c[rows]
        keys = np.concatenate([key(self.atoms, a), key(self.lines, a), key(self.lines, b)])
        nodes, at = np.unique(keys, return_inverse=True)
        self.n, self.node_mol = len(nodes), nodes // len(rank)
        self.own, self.x, self.y = np.split(at.reshape(-1), [len(self.atoms), len(self.atoms) + len(self.lines)])

    def steps(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, first): the different bonds both ways in order, and where each place's begin."""
        n = max(self.n, 1)
        key = np.unique(np.concatenate([x * n + y, y * n + x]))
        return key // n, key % n, np.searchsorted(key // n, np.arange(self.n + 1))


def _further(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, step): for each place of `at`, the steps that begin there."""
    many = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)


def least_reached(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over the bonds x, y: labels of both ends meet, and then follow their labels."""
    label = np.arange(n)
    while True:
        p, q = label[x], label[y]
        if np.array_equal(p, q):
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(label, label[label]):
            label = label[label]


def resonance_rows(sites: DataFrame, links: DataFrame) -> DataFrame:
    """graph.resonance_terms() from sites(mol_id, atom_id, aromatic) and links(mol_id, a, b), of which those between sites count."""
    one = sites.select("mol_id", F.col("atom_id").alias("a"), F.lit(None).cast(sites.schema["atom_id"].dataType).alias("b"), "aromatic", F.lit(False).alias("bond"))
    two = links.select("mol_id", "a", "b", F.lit(False).alias("aromatic"), F.lit(True).alias("bond"))
    return in_molecules(one.unionByName(two), StructType([sites.schema["mol_id"], *(StructField(c, LongType()) for c in RESONANCE)]), _resonance)


def _resonance(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    g = Graph(table, starts)
    site = np.zeros(g.n, bool)
    site[g.own] = True
    both = site[g.x] & site[g.y]
    x, y = g.x[both], g.y[both]
    label = least_reached(g.n, x, y)
    size = np.bincount(label[g.own], minlength=g.n)  # at a component's least place
    count = lambda of: np.bincount(g.node_mol[of], minlength=len(starts))
    own = np.bincount(g.mol[g.atoms], minlength=len(starts))
    largest = np.zeros(len(starts), np.int64)
    np.maximum.at(largest, g.node_mol, size)
    start, end, first = g.steps(x, y)
    branch = np.diff(first)[g.own] >= 3
    cross = branch & ~table.column("aromatic").to_numpy()[g.atoms]
    paths = {k: np.zeros(len(starts), np.int64) for k in (2, 3, 4)}

    def walk(path: list[np.ndarray]) -> None:
        """Counts the simple paths that go on from these; half of them at a time where these are many."""
        last = path[-1]
        if int((first[last + 1] - first[last]).sum()) > MOST_WALKS and len(last) > 1:
            for part in (slice(None, len(last) // 2), slice(len(last) // 2, None)):
                walk([p[part] for p in path])
            return
        which, step = _further(last, first)
        to = end[step]
        new = np.logical_and.reduce([p[which] != to for p in path])
        path, to = [p[which[new]] for p in path], to[new]
        paths[len(path)] += count(to[path[0] < to])
        if len(path) < 4 and len(to):
            walk([*path, to])

    walk([start, end])
    keep = np.flatnonzero(own)
    found = [count(np.flatnonzero(size)), own, largest, count(g.own[branch]), count(g.own[cross]), *paths.values()]
    return pa.RecordBatch.from_arrays([table.column("mol_id").combine_chunks().take(pa.array(starts[keep])), *(pa.array(v[keep].astype(np.int64)) for v in found)], names=["mol_id", *RESONANCE])


def signature_rows(own: DataFrame, lines: DataFrame, least: int, most: int, bins: int) -> DataFrame:
    """graph.signature_bins() from own(mol_id, atom_id, seed, brief), an atom once, and lines(mol_id, a, b, kind)."""
    one = own.select("mol_id", F.col("atom_id").alias("a"), F.lit(None).cast(own.schema["atom_id"].dataType).alias("b"), F.col("seed").alias("s"), "brief", F.lit(False).alias("bond"))
    two = lines.select("mol_id", "a", "b", F.col("kind").alias("s"), F.lit(None).cast("string").alias("brief"), F.lit(True).alias("bond"))
    hashed: dict[str, tuple[int, float]] = {}

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        if len(hashed) > MOST_HASHED:
            hashed.clear()
        return _signature_bins(table, starts, least, most, bins, hashed)

    schema = StructType([own.schema["mol_id"], StructField("name", StringType()), StructField("value", DoubleType())])
    return in_molecules(one.unionByName(two), schema, work)


def _ranked(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each string's place among the different ones, in their order."""
    coded = strings.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _different(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, at): a row of each different combination, and each row's combination."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        key = key * (int(c.max(initial=0)) + 1) + c
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return first, at.reshape(-1)


def _signature_bins(table: pa.Table, starts: np.ndarray, least: int, most: int, bins: int, hashed: dict) -> pa.RecordBatch:
    g = Graph(table, starts)
    text = table.column("s").combine_chunks()
    seed_of, seeds = _ranked(text.take(pa.array(g.atoms)))
    kind_of, kinds = _ranked(text.take(pa.array(g.lines)))
    seeds, kinds = seeds.to_pylist(), kinds.to_pylist()
    seed, row = np.full(g.n, -1), np.full(g.n, -1)
    seed[g.own], row[g.own] = seed_of, g.atoms
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # molecule, bin of its kind, sign

    def put(family: int, mol: np.ndarray, at: np.ndarray, signatures: list[str]) -> None:
        for s in signatures:
            if s not in hashed:
                digest = hashlib.sha256(s.encode()).digest()
                hashed[s] = int.from_bytes(digest[:8], "big") % bins, -1.0 if digest[8] % 2 else 1.0
        places = np.array([hashed[s] for s in signatures], np.float64).reshape(-1, 2)[at]
        found.append((mol, family * bins + places[:, 0].astype(np.int64), places[:, 1]))

    # atoms: neighbours in the order of their texts, those that are no atoms left out
    x, y, kind = np.concatenate([g.x, g.y]), np.concatenate([g.y, g.x]), np.concatenate([kind_of, kind_of])
    near = seed[y] >= 0
    x, y, kind = x[near], y[near], kind[near]
    brief_of, briefs = _ranked(table.column("brief").combine_chunks().take(pa.array(row[y])))
    first, at = _different(kind, brief_of)
    briefs = briefs.to_pylist()
    near_of, nears = _ranked(pa.array([f"{kinds[kind[k]]}:{briefs[brief_of[k]]}" for k in first], pa.string()))
    near_of = near_of[at]
    order = np.lexsort((near_of, x))
    edge = np.searchsorted(x[order], np.arange(g.n + 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), nears.take(pa.array(near_of[order]))), ",")
    around, arounds = _ranked(joined)
    degree, around = np.diff(edge)[g.own], around[g.own]
    first, at = _different(seed_of, degree, around)
    arounds = arounds.to_pylist()
    put(0, g.node_mol[g.own], at, [f"{seeds[seed_of[k]]}|{degree[k]}|{arounds[around[k]]}" for k in first])

    def pairs(family: int, x: np.ndarray, y: np.ndarray, head: np.ndarray, heads: list[str]) -> None:
        both = (seed[x] >= 0) & (seed[y] >= 0)
        x, y, head = x[both], y[both], head[both]
        less, more = np.minimum(seed[x], seed[y]), np.maximum(seed[x], seed[y])
        first, at = _different(head, less, more)
        put(family, g.node_mol[x], at, [f"{heads[head[k]]}~{seeds[less[k]]}~{seeds[more[k]]}" for k in first])

    pairs(1, g.x, g.y, kind_of, kinds)

    # pairs of atoms: what is new at d + 1 bonds was not reached at d or d - 1
    other = g.x != g.y
    start, end, first = g.steps(g.x[other], g.y[other])
    n = max(g.n, 1)
    before, now = np.empty(0, np.int64), start * n + end
    far = []
    for d in range(1, most + 1):
        if d > 1:
            which, step = _further(now % n, first)
            further = np.unique((now // n)[which] * n + end[step])
            further = further[further // n != further % n]
            before, now = now, further[~np.isin(further, np.concatenate([before, now]))]
        if d >= least:
            once = now[now // n < now % n]
            far.append((once // n, once % n, np.full(len(once), d)))
    pairs(2, *(np.concatenate(c) for c in zip(*far, strict=True)), [str(d) for d in range(most + 1)])

    mol, place, sign = (np.concatenate(c) for c in zip(*found, strict=True))
    key, at = np.unique(mol * (3 * bins) + place, return_inverse=True)
    value = np.bincount(at.reshape(-1), sign, len(key))
    key, value = key[value != 0], value[value != 0]
    names = pa.array([f"{family}_{str(k).rjust(3, '0')[:3]}" for family in ("atom", "bond", "atom_pair") for k in range(bins)])
    ids = table.column("mol_id").combine_chunks().take(pa.array(starts[key // (3 * bins)]))
    return pa.RecordBatch.from_arrays([ids, names.take(pa.array(key % (3 * bins))), pa.array(value)], names=["mol_id", "name", "value"])


def symmetry_rows(rows: DataFrame) -> DataFrame:
    """(mol_id, *SYMMETRY) of rows(mol_id, atoms, bonds): each atom's (atom_id, label) and each bond's (a, b, kind), as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, MOLECULES):
                yield _symmetry(batch.slice(k, MOLECULES))

    return rows.select("mol_id", "atoms", "bonds").mapInArrow(run, StructType([rows.schema["mol_id"], *(StructField(c, t()) for c, t in SYMMETRY.items())]))


def _refined(colour: np.ndarray, x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Atoms of one colour stay together where their bonds x to y, as kinds and colours of y in order, are the same."""
    near = kind * len(colour) + colour[y] + 1
    order = np.lexsort((near, x))
    near, many = near[order], np.bincount(x, minlength=len(colour))
    first = np.cumsum(many) - many
    for place in range(int(many.max(initial=0))):
        has = np.flatnonzero(many > place)
        part = np.zeros(len(colour), np.int64)  # no further bond
        part[has] = np.unique(near[first[has] + place], return_inverse=True)[1].reshape(-1) + 1
        colour = _different(colour, part)[1]
    return colour


def _symmetry(batch: pa.RecordBatch) -> pa.RecordBatch:
    atoms, bonds = batch.column("atoms"), batch.column("bonds")
    mol, line_mol = (np.repeat(np.arange(len(batch)), pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False)) for c in (atoms, bonds))
    atoms, bonds = atoms.flatten(), bonds.flatten()
    ids, label = atoms.field("atom_id"), atoms.field("label").dictionary_encode().indices.to_numpy()
    named = pa.concat_arrays([ids, bonds.field("a").cast(ids.type), bonds.field("b").cast(ids.type)]).dictionary_encode()
    place = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, a, b = np.split(place, [len(atoms), len(atoms) + len(bonds)])
    key, width = mol * (len(named.dictionary) + 1) + own, len(named.dictionary) + 1
    order = np.argsort(key, kind="stable")

    def at(ends: np.ndarray) -> np.ndarray:
        """The atom of each bond's end, -1 where it is none."""
        wanted = line_mol * width + ends
        found = order[np.minimum(np.searchsorted(key, wanted, sorter=order), len(key) - 1)]
        return np.where((key[found] == wanted) & (ends >= 0), found, -1)

    kind = bonds.field("kind")
    x, y, known = at(a), at(b), kind.is_valid().to_numpy(zero_copy_only=False)
    on = (x >= 0) & (y >= 0) & known
    kind = np.unique(kind.fill_null(0).to_numpy(zero_copy_only=False)[on], return_inverse=True)[1].reshape(-1)
    x, y, kind = np.concatenate([x[on], y[on]]), np.concatenate([y[on], x[on]]), np.concatenate([kind, kind])
    colour = _different(mol, label)[1]
    while True:  # classes only split; where none does, no later round splits one
        further = _refined(colour, x, y, kind)
        if further.max(initial=-1) == colour.max(initial=-1):
            break
        colour = further
    first, at_class = _different(colour)
    size, of = np.bincount(at_class, minlength=len(first)), mol[first]
    added = lambda v: np.bincount(of, v, len(batch))
    share = size / np.bincount(mol, minlength=len(batch))[of]
    found = np.bincount(of, minlength=len(batch)), added(size * (size - 1) / 2), -added(share * np.log(share))
    return pa.RecordBatch.from_arrays([batch.column("mol_id"), pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2])], names=["mol_id", *SYMMETRY])
