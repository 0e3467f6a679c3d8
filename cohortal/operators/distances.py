"""Shortest paths inside many graphs, of any length: atoms reached are bits of one whole number an atom."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortal.operators.loops import checkpointed, joined_in_place

MOST_BONDS = 4096  # of a molecule whose paths one task finds
ROWS = 65_536  # rows of a batch
MERGED = 32  # frontiers that stay tables of their own


def graph_distances(bonds: DataFrame, cutoff: int | None = None, most: int = MOST_BONDS) -> DataFrame:
    """(mol_id, a, b, d), a < b: shortest paths of at most `cutoff` bonds, or of any length.

    A molecule of up to `most` bonds is one row, whose atoms' frontiers are bits; larger ones join frontiers with bonds, one
    join a length. Repeated bonds count once; a bond of an atom with itself, or with a null end, is none.
    """
    return _both_ways(bonds, most, lambda few: _packed_distances(few, cutoff), lambda many: _joined_distances(many, cutoff))


def path_profile(bonds: DataFrame, cutoff: int | None = None, most: int = MOST_BONDS) -> DataFrame:
    """(mol_id, d, n): how many pairs of atoms lie d bonds apart; small molecules list no pair."""
    profile = lambda many: _joined_distances(many, cutoff).groupBy("mol_id", "d").agg(F.count("*").alias("n"))
    return _both_ways(bonds, most, lambda few: _packed_profile(few, cutoff), profile)


def path_indices(profile: DataFrame) -> DataFrame:
    """Per molecule, over pairs that a path joins: sum of d, sum of 1/d, mean of d."""
    total = F.sum(F.col("d") * F.col("n"))
    return profile.groupBy("mol_id").agg(total.alias("wiener"), F.sum(F.col("n") / F.col("d")).alias("harary"), (total / F.sum("n")).alias("mean_distance"))


def skeleton_indices(atoms: DataFrame, bonds: DataFrame, element: str = "C") -> DataFrame:
    """(mol_id, pairs, mean_distance) over the bonds between atoms of one element, paths through others being none; 0 without a pair."""
    kept = atoms.where(F.col("element") == element)
    end = lambda c: kept.select("mol_id", F.col("atom_id").alias(c)).hint("merge")
    inner = bonds.join(end("a"), ["mol_id", "a"], "left_semi").join(end("b"), ["mol_id", "b"], "left_semi")
    per = path_profile(inner).groupBy("mol_id").agg(F.sum("n").alias("pairs"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_distance"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return atoms.select("mol_id").distinct().join(per.hint("merge"), "mol_id", "left").select("mol_id", zero("pairs", 0), zero("mean_distance", 0.0))


def _both_ways(bonds: DataFrame, most: int, packed, joined) -> DataFrame:
    """packed on molecules of up to `most` bonds and joined on the others; tasks count bonds before any are gathered."""
    clean = bonds.where("a <> b").select("mol_id", "a", "b")
    large = checkpointed(clean.groupBy("mol_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mol_id"))
    if not large.limit(1).count():
        return packed(clean)
    many = clean.join(large.hint("merge"), "mol_id", "left_semi")
    return packed(clean.join(large.hint("merge"), "mol_id", "left_anti")).unionByName(joined(many))


def _joined_distances(bonds: DataFrame, cutoff: int | None) -> DataFrame:
    """Paths by joins of the frontier with the bonds, until it is empty: what is new at d + 1 was not reached at d or d - 1."""
    step = bonds.select("mol_id", F.col("a").alias("mid"), "b").union(bonds.select("mol_id", F.col("b").alias("mid"), F.col("a").alias("b"))).distinct()
    with joined_in_place(bonds.sparkSession, ["mol_id"], step) as (step,):
        step = checkpointed(step)
        frontier = step.select("mol_id", F.col("mid").alias("a"), "b").withColumn("d", F.lit(1))
        before, found, d = frontier.limit(0), [frontier], 1
        while cutoff is None or d < cutoff:
            d += 1
            known = frontier.unionByName(before).select("mol_id", "a", "b")
            further = frontier.select("mol_id", "a", F.col("b").alias("mid")).join(step.hint("merge"), ["mol_id", "mid"]).where("a <> b").select("mol_id", "a", "b").distinct()
            before, frontier = frontier, checkpointed(further.join(known.hint("merge"), ["mol_id", "a", "b"], "left_anti").withColumn("d", F.lit(d)))
            if not frontier.limit(1).count():
                break
            found.append(frontier)
            if len(found) > MERGED:
                found = [checkpointed(_union(found))]
        return _union(found).where("a < b")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _molecules(bonds: DataFrame) -> DataFrame:
    """(mol_id, a, b): a row a molecule, with the ends of its bonds."""
    return bonds.groupBy("mol_id").agg(F.collect_list(F.struct("a", "b")).alias("ends")).select("mol_id", F.col("ends.a").alias("a"), F.col("ends.b").alias("b"))


def _frontiers(a: list[int], b: list[int]) -> tuple[list[int], Iterator[tuple[int, list[int]]]]:
    """The atoms in order and, for d = 1, 2, ..., for each atom the bits of the places of those d bonds away, until there are none."""
    atoms = sorted({*a, *b})
    place = {x: k for k, x in enumerate(atoms)}
    around: list[set[int]] = [set() for _ in atoms]
    for x, y in zip(a, b, strict=True):
        around[place[x]].add(place[y])
        around[place[y]].add(place[x])

    def walk() -> Iterator[tuple[int, list[int]]]:
        new = [sum(1 << j for j in near) for near in around]
        seen = [1 << k | m for k, m in enumerate(new)]
        d = 1
        while any(new):
            yield d, new
            further = []
            for k, near in enumerate(around):
                bits = 0
                if new[k]:  # an atom without atoms at d bonds has none further
                    for j in near:
                        bits |= new[j]
                    bits &= ~seen[k]
                    seen[k] |= bits
                further.append(bits)
            new, d = further, d + 1

    return atoms, walk()


def _packed_distances(bonds: DataFrame, cutoff: int | None) -> DataFrame:
    kinds = {f.name: f.dataType for f in bonds.schema.fields}
    schema = StructType([StructField("mol_id", kinds["mol_id"]), StructField("a", kinds["a"]), StructField("b", kinds["b"]), StructField("d", IntegerType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for mol, a, b in zip(*(batch.column(c).to_pylist() for c in ("mol_id", "a", "b")), strict=True):
                atoms, steps = _frontiers(a, b)
                for d, new in steps:
                    if cutoff is not None and d > cutoff:
                        break
                    for k, bits in enumerate(new):
                        bits >>= k + 1
                        while bits:
                            low = bits & -bits
                            for cells, value in zip(rows, (mol, atoms[k], atoms[k + low.bit_length()], d), strict=True):
                                cells.append(value)
                            bits ^= low
                        if len(rows[0]) >= ROWS:
                            yield _batch(rows, arrow, schema.names)
                            rows = ([], [], [], [])
            yield _batch(rows, arrow, schema.names)

    return _molecules(bonds).mapInArrow(paths, schema)


def _packed_profile(bonds: DataFrame, cutoff: int | None) -> DataFrame:
    schema = StructType([StructField("mol_id", bonds.schema["mol_id"].dataType), StructField("d", IntegerType()), StructField("n", LongType())])
    arrow = [to_arrow_type(f.dataType) for f in schema.fields]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [])
            for mol, a, b in zip(*(batch.column(c).to_pylist() for c in ("mol_id", "a", "b")), strict=True):
                for d, new in _frontiers(a, b)[1]:
                    if cutoff is not None and d > cutoff:
                        break
                    for cells, value in zip(rows, (mol, d, sum(map(int.bit_count, new)) // 2), strict=True):
                        cells.append(value)
            yield _batch(rows, arrow, schema.names)

    return _molecules(bonds).mapInArrow(profile, schema)


def _batch(rows: tuple[list, ...], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)
