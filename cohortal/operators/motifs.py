"""Local motifs, rigid donor-acceptor pairs, orbital expansion, and the gate of the expensive step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortal.operators.distances import MOST_BONDS
from cohortal.operators.graph import count_of, directed, flag, ring_edges
from cohortal.operators.loops import checkpointed

MOST_ROUNDS = 50
#: How many bonds donors and acceptors are apart, and more flexible bonds than any path may have.
NEAREST, FARTHEST, FAR = 4, 5, 1000


def should_run(mode: str, rotatable: Column, margin: Column, near: float = 0.1) -> Column:
    """always, never, or auto: if a bond can rotate or the margin is small."""
    if mode not in ("always", "never", "auto"):
        raise ValueError(f"unknown mode {mode}")
    auto = (F.coalesce(rotatable, F.lit(0)) > 0) | F.coalesce(margin < near, F.lit(False))
    return auto if mode == "auto" else F.lit(mode == "always")


def motif_terms(atoms: DataFrame, bonds: DataFrame, rewards: dict[str, float]) -> DataFrame:
    """(mol_id, lone_pair, substitution, hyperconjugation, reward): counts around double bonds, and their weighted sum.

    lone_pair: N, O or S without a double bond beside an atom with one. substitution: single bonds from carbon to the
    ends of C=C. hyperconjugation: those of them whose other end is a carbon with hydrogen.
    """
    step = directed(bonds)
    double = step.where("bond_order >= 2").select("mol_id", F.col("a").alias("atom_id")).distinct()
    beside = step.where("bond_order < 2").join(double.withColumnRenamed("atom_id", "b").hint("merge"), ["mol_id", "b"], "left_semi").select("mol_id", F.col("a").alias("atom_id")).distinct()
    hetero = atoms.where(F.col("element").isin("N", "O", "S")).join(double.hint("merge"), ["mol_id", "atom_id"], "left_anti").join(beside.hint("merge"), ["mol_id", "atom_id"], "left_semi")
    lone = hetero.groupBy("mol_id").agg(F.count("*").alias("lone_pair"))
    carbon = atoms.where("element = 'C'").select("mol_id", "atom_id", "total_hcount")
    ends = step.where("bond_order >= 2").join(carbon.select("mol_id", F.col("atom_id").alias("a")).hint("merge"), ["mol_id", "a"], "left_semi").join(carbon.select("mol_id", F.col("atom_id").alias("b")).hint("merge"), ["mol_id", "b"], "left_semi").select("mol_id", "a").distinct()
    arms = step.where("bond_order < 2").join(ends.hint("merge"), ["mol_id", "a"], "left_semi").join(carbon.select("mol_id", F.col("atom_id").alias("b"), "total_hcount").hint("merge"), ["mol_id", "b"])
    counted = arms.groupBy("mol_id").agg(F.count("*").alias("substitution"), F.sum((F.col("total_hcount") > 0).cast("int")).alias("hyperconjugation"))
    names = ("lone_pair", "substitution", "hyperconjugation")
    j = atoms.select("mol_id").distinct().join(lone.hint("merge"), "mol_id", "left").join(counted.hint("merge"), "mol_id", "left").select("mol_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return j.withColumn("reward", sum((F.col(n) * F.lit(float(rewards.get(n, 0.0))) for n in names), F.lit(0.0)))


def marked_bonds(bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """(mol_id, a, b, f): whether a bond is flexible (1) or rigid (0), as aromatic and conjugated bonds, sides of a ring and bonds of order
    1.5 or more are."""
    inside = ring_edges(rings).select("mol_id", F.col("a").alias("_x"), F.col("b").alias("_y")).distinct().withColumn("_side", F.lit(True))
    near = bonds.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
    marked = near.join(inside.hint("merge"), ["mol_id", "_x", "_y"], "left")
    rigid = flag(bonds, "bond_aromatic") | flag(bonds, "conjugated") | F.col("_side").isNotNull() | (F.col("bond_order") >= 1.5)
    return marked.select("mol_id", "a", "b", (~rigid).cast("int").alias("f"))


def flexible_distances(marked: DataFrame, cutoff: int) -> DataFrame:
    """(mol_id, a, b, d, flexible): shortest paths over marked_bonds(), with the fewest flexible bonds on one."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "f")
    step = marked.select("mol_id", F.inline(F.array(way("a", "b"), way("b", "a"))))
    step = checkpointed(step)
    seen = frontier = step.groupBy("mol_id", "a", "b").agg(F.min("f").alias("flexible")).withColumn("d", F.lit(1))
    for d in range(2, cutoff + 1):
        further = frontier.select("mol_id", "a", F.col("b").alias("mid"), "flexible").join(step.select("mol_id", F.col("a").alias("mid"), "b", "f").hint("merge"), ["mol_id", "mid"]).where("a <> b")
        frontier = checkpointed(further.groupBy("mol_id", "a", "b").agg(F.min(F.col("flexible") + F.col("f")).alias("flexible")).join(seen.hint("merge"), ["mol_id", "a", "b"], "left_anti").withColumn("d", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def rigid_pairs(atoms: DataFrame, bonds: DataFrame, rings: DataFrame, most: int = MOST_BONDS) -> DataFrame:
    """(mol_id, donor, acceptor, d): donors and acceptors four or five bonds apart over at most one flexible bond.

    Donors are N, O and S with hydrogen and without a positive charge; acceptors N, O and S without a positive charge that have a
    lone pair (lone_pairs, where atoms has that column). Greedy in the order of the pair written as text; an atom serves once. A
    molecule of up to `most` bonds is one row; larger ones are joined.
    """
    hetero = F.col("element").isin("N", "O", "S") & (F.coalesce("formal_charge", F.lit(0)) <= 0)
    free = F.coalesce(F.col("lone_pairs"), F.lit(0)) > 0 if "lone_pairs" in atoms.columns else F.lit(True)
    able = atoms.where(hetero).select("mol_id", "atom_id", (F.col("total_hcount") > 0).alias("gives"), free.alias("takes"))
    marked = marked_bonds(bonds, rings)
    large = checkpointed(bonds.groupBy("mol_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mol_id"))
    if not large.limit(1).count():
        return _packed_pairs(able, marked)
    cut = lambda df, how: df.join(large.hint("merge"), "mol_id", how)
    return _packed_pairs(able, cut(marked, "left_anti")).unionByName(_joined_pairs(able, cut(marked, "left_semi")))


def _packed_pairs(able: DataFrame, marked: DataFrame) -> DataFrame:
    """rigid_pairs() of able(mol_id, atom_id, gives, takes), a row a molecule."""
    kinds = {"mol_id": marked.schema["mol_id"].dataType, "donor": able.schema["atom_id"].dataType, "acceptor": able.schema["atom_id"].dataType, "d": IntegerType()}
    lists = lambda df, **of: df.groupBy("mol_id").agg(*(F.collect_list(c).alias(n) for n, c in of.items()))
    line = F.struct("a", "b", F.coalesce("f", F.lit(FAR)).alias("f"))
    rows = lists(marked.where("a is not null and b is not null"), lines=line).where(F.size("lines") >= NEAREST)
    ends = lists(able, donors=F.when(F.col("gives"), F.col("atom_id")), acceptors=F.when(F.col("takes"), F.col("atom_id"))).where((F.size("donors") > 0) & (F.size("acceptors") > 0))
    rows = rows.join(ends.hint("merge"), "mol_id").select("mol_id", F.col("lines.a").alias("a"), F.col("lines.b").alias("b"), F.col("lines.f").alias("f"), "donors", "acceptors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m, *p) for m, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in _greedy_pairs(*row)]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(t)) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return rows.mapInArrow(run, StructType([StructField(n, t) for n, t in kinds.items()]))


def _greedy_pairs(a: list, b: list, f: list, donors: list, acceptors: list) -> list[tuple]:
    """(donor, acceptor, d) of one molecule, whose bonds are (a, b, flexible)."""
    steps: dict = {}
    for x, y, cost in zip(a, b, f, strict=True):
        steps.setdefault(x, []).append((y, cost))
        steps.setdefault(y, []).append((x, cost))
    ends, found = set(acceptors), []
    for donor in donors:
        seen, frontier = {donor}, {donor: 0}
        for d in range(1, FARTHEST + 1):
            further: dict = {}
            for x, so_far in frontier.items():
                for y, cost in steps.get(x, ()):
                    if y not in seen:
                        further[y] = min(further.get(y, FAR), so_far + cost)
            if d >= NEAREST:
                found += [(f"({donor}, {y})", donor, y, d) for y, cost in further.items() if cost <= 1 and y in ends]
            seen.update(further)
            frontier = further
    used, out = set(), []
    for _, donor, acceptor, d in sorted(found):
        if donor not in used and acceptor not in used:
            used |= {donor, acceptor}
            out.append((donor, acceptor, d))
    return out


def _joined_pairs(able: DataFrame, marked: DataFrame) -> DataFrame:
    """rigid_pairs() by joins. In each round the pairs that are first for both of their atoms are taken and what they touch goes, which is
    what the one-by-one choice gives."""
    donor, acceptor = able.where("gives").select("mol_id", F.col("atom_id").alias("donor")), able.where("takes").select("mol_id", F.col("atom_id").alias("acceptor"))
    far = flexible_distances(marked, FARTHEST).where((F.col("d") >= NEAREST) & (F.col("flexible") <= 1)).select("mol_id", F.col("a").alias("donor"), F.col("b").alias("acceptor"), "d")
    left = checkpointed(far.join(donor.hint("merge"), ["mol_id", "donor"], "left_semi").join(acceptor.hint("merge"), ["mol_id", "acceptor"], "left_semi").select("mol_id", "donor", "acceptor", "d"))
    picked = None
    for _ in range(MOST_ROUNDS):
        order = F.struct(F.concat(F.lit("("), F.col("donor").cast("string"), F.lit(", "), F.col("acceptor").cast("string"), F.lit(")")).alias("text"), "donor", "acceptor")
        ends = left.select("mol_id", F.explode(F.array("donor", "acceptor")).alias("atom_id"), order.alias("o"))
        first = ends.groupBy("mol_id", "atom_id").agg(F.min("o").alias("first"))
        of = lambda side: first.select("mol_id", F.col("atom_id").alias(side), F.col("first").alias(f"first_{side}"))  # noqa: E731, B023
        now = checkpointed(left.join(of("donor").hint("merge"), ["mol_id", "donor"]).join(of("acceptor").hint("merge"), ["mol_id", "acceptor"]).where((F.col("first_donor") == order) & (F.col("first_acceptor") == order)).select("mol_id", "donor", "acceptor", "d"))
        picked = now if picked is None else picked.unionByName(now)
        used = now.select("mol_id", F.explode(F.array("donor", "acceptor")).alias("atom_id"))
        left = checkpointed(left.join(used.withColumnRenamed("atom_id", "donor").hint("merge"), ["mol_id", "donor"], "left_anti").join(used.withColumnRenamed("atom_id", "acceptor").hint("merge"), ["mol_id", "acceptor"], "left_anti"))
        if not left.limit(1).count():
            return picked
    raise RuntimeError("pairs are still left")


def expand_orbitals(atoms: DataFrame, bonds: DataFrame, pi: DataFrame) -> DataFrame:
    """(mol_id, atom_id, orbital, electrons, scale): the p orbitals of each atom, numbered from 0.

    An included atom has one, with its electrons. With one electron each: two at either end of a triple bond, two at the SP
    middle of two double bonds, and one for each multiple bond of a sulfur that has two to oxygen. N, O or S with a lone
    pair and none of these, single-bonded to an orbital over a conjugated bond or to such a sulfur, gives one of two electrons;
    scale is what its coupling shrinks by when it meets several orbitals of one sulfur.
    """
    flags = bonds.select("mol_id", "a", "b", "bond_order", flag(bonds, "bond_aromatic").alias("ring"), flag(bonds, "conjugated").alias("conjugated"))
    ways = flags.unionByName(flags.select("mol_id", F.col("b").alias("a"), F.col("a").alias("b"), "bond_order", "ring", "conjugated"))
    element = atoms.select("mol_id", "atom_id", "element")
    around = ways.join(element.select("mol_id", F.col("atom_id").alias("b"), F.col("element").alias("other")).hint("merge"), ["mol_id", "b"])
    order = F.col("bond_order")
    counted = around.groupBy("mol_id", F.col("a").alias("atom_id")).agg(
        F.bool_or(order >= 2.5).alias("triple"),
        F.sum(((order >= 1.5) & (order < 2.5) & ~F.col("ring")).cast("int")).alias("doubles"),
        F.sum(((order >= 1.5) & (F.col("other") == "O")).cast("int")).alias("oxygens"),
    )
    own = atoms.join(pi.select("mol_id", "atom_id", "electrons").hint("merge"), ["mol_id", "atom_id"]).join(counted.hint("merge"), ["mol_id", "atom_id"], "left")
    hybrid = F.col("hybridization") if "hybridization" in atoms.columns else F.lit(None).cast("string")
    triple = F.coalesce("triple", F.lit(False))
    middle = F.coalesce((F.col("doubles") == 2) & (hybrid == "SP"), F.lit(False)) & (triple | F.col("electrons").isNotNull())
    sulfur = F.when((F.col("element") == "S") & (F.col("oxygens") >= 2), F.col("oxygens")).otherwise(0)
    many = F.greatest(F.col("electrons").isNotNull().cast("int"), F.when(triple, 2).otherwise(0), F.when(middle, 2).otherwise(0), sulfur)
    donor = F.col("element").isin("N", "O", "S") & (F.col("formal_charge") <= 0) & (count_of(atoms, "lone_pairs") > 0)
    own = own.select("mol_id", "atom_id", "electrons", many.alias("many"), sulfur.alias("sulfur"), (triple | F.coalesce((F.col("doubles") == 2) & (hybrid == "SP"), F.lit(False)) | (sulfur > 0)).alias("ones"), donor.alias("donor"))
    own = checkpointed(own)
    plain = own.where("many > 0").select("mol_id", "atom_id", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)).alias("orbital"), F.when(F.col("ones"), 1).otherwise(F.col("electrons")).alias("electrons"), F.lit(1.0).alias("scale"))
    targets = own.where("many > 0").select("mol_id", F.col("atom_id").alias("b"), "sulfur")
    near = ways.where(order < 1.5).join(targets.hint("merge"), ["mol_id", "b"]).where((F.col("sulfur") > 0) | F.col("conjugated"))
    scale = 1 / F.sqrt(F.max(F.greatest("sulfur", F.lit(1))).cast("double"))
    near = near.groupBy("mol_id", F.col("a").alias("atom_id")).agg(scale.alias("scale"))
    donors = own.where("many = 0 and donor").join(near.hint("merge"), ["mol_id", "atom_id"]).select("mol_id", "atom_id", F.lit(0).alias("orbital"), F.lit(2).alias("electrons"), "scale")
    return plain.unionByName(donors)
