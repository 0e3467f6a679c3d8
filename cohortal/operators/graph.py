"""Operators over many small graphs at once, held as atoms(mol_id, atom_id, ...) and bonds(mol_id, a, b, bond_order)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortal.functions.hashing import signed_bin
from cohortal.functions.scalars import SUPPORTED, bond_class
from cohortal.operators.distances import graph_distances, path_indices, path_profile, skeleton_indices  # noqa: F401  stand beside the other graph operators
from cohortal.operators.loops import checkpointed, joined_in_place, settle
from cohortal.operators.packed import resonance_rows, signature_rows, symmetry_rows

#: The attribute names that other tools use, and ours.
ALIASES = {"charge": "formal_charge", "hcount": "total_hcount", "is_aromatic": "aromatic", "symbol": "element"}
MOST_PACKED = 256  # atoms, or bonds, of a molecule that is one row; its work grows with the product of both
MOST_ENTRIES = 16_384  # of the matrices of a molecule that is one row
MOST_REFINED = 10_000  # rounds of refinement; each splits a class of every molecule that is left


def directed(bonds: DataFrame) -> DataFrame:
    """Each bond both ways."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("bond_order").alias("bond_order"))
    return bonds.select("mol_id", F.inline(F.array(way("a", "b"), way("b", "a"))))


def molecule_sizes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, n): the numbers of a molecule's atoms and of its bonds, in a row each."""
    counted = lambda df: df.groupBy("mol_id").agg(F.count("*").alias("n"))
    return counted(atoms).unionByName(counted(bonds))


def _both_ways(atoms: DataFrame, bonds: DataFrame, packed, joined, most: int, sizes: DataFrame | None = None) -> DataFrame:
    """packed on molecules of up to `most` atoms and bonds, joined on the others, if there are any; counted before any row is made.

    sizes: (mol_id, n), bounds of these numbers, where atoms and bonds are themselves results.
    """
    sizes = molecule_sizes(atoms, bonds) if sizes is None else sizes
    large = checkpointed(sizes.where(F.col("n") > most).select("mol_id").distinct())
    if not large.limit(1).count():
        return packed(atoms, bonds)
    cut = lambda df, how: df.join(large.hint("merge"), "mol_id", how)
    return packed(cut(atoms, "left_anti"), cut(bonds, "left_anti")).unionByName(joined(cut(atoms, "left_semi"), cut(bonds, "left_semi")))


def _molecule_rows(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, atoms, ends): a row a molecule, with its atoms' structs as they are and its bonds both ways.

    No row is without an atom, so results are taken apart by inline_outer: inline would have them computed once more to drop empty ones.
    """
    ends = directed(bonds).groupBy("mol_id").agg(F.collect_list(F.struct("a", "b", "bond_order")).alias("ends"))
    rows = atoms.groupBy("mol_id").agg(F.collect_list(F.struct(*(c for c in atoms.columns if c != "mol_id"))).alias("atoms"))
    return rows.join(ends.hint("merge"), "mol_id", "left").withColumn("ends", F.coalesce("ends", F.array()))


def normalize_atoms(atoms: DataFrame, strict: bool = False) -> DataFrame:
    """Aliases resolved, attributes cast and given defaults, a warnings array; strict raises on what can't be kept."""
    for old, new in ALIASES.items():
        if old in atoms.columns and new not in atoms.columns:
            atoms = atoms.withColumnRenamed(old, new)
    defaults = {"formal_charge": ("int", 0), "total_hcount": ("int", 0), "aromatic": ("boolean", False), "radical_electrons": ("int", 0)}
    for name, (kind, value) in defaults.items():
        have = F.col(name).try_cast(kind) if name in atoms.columns else F.lit(None).cast(kind)
        atoms = atoms.withColumn(name, F.coalesce(have, F.lit(value)))
    charge = F.col("partial_charge").try_cast("double") if "partial_charge" in atoms.columns else F.lit(None).cast("double")
    broken = charge.isNotNull() & (F.isnan(charge) | (F.abs(charge) == float("inf")))
    element = F.trim(F.col("element"))
    none = element.isNull() | (element == "")
    codes = F.array_compact(
        F.array(
            F.when(none, F.lit("MISSING_ELEMENT")),
            F.when(~none & ~element.isin(*SUPPORTED), F.lit("UNSUPPORTED_ELEMENT")),
            F.when(broken, F.lit("NONFINITE_PARTIAL_CHARGE")),
            F.when(F.col("radical_electrons") > 0, F.lit("OPEN_SHELL_NOT_SUPPORTED")),
        )
    )
    out = atoms.withColumn("warnings", codes).withColumn("partial_charge", F.when(~broken, charge))
    if strict:
        bad = F.array_contains("warnings", "MISSING_ELEMENT")
        out = out.withColumn("element", F.when(bad, F.raise_error(F.concat(F.lit("atom without element in "), F.col("mol_id").cast("string"))).cast("string")).otherwise(element))
    return out


def normalize_bonds(bonds: DataFrame, strict: bool = False) -> DataFrame:
    """bonds(mol_id, a, b, bond_order or order) with the order as a double, flags with defaults, and a code; an order that is no number
    above 0 counts as 1, and is an error if strict."""
    if "order" in bonds.columns and "bond_order" not in bonds.columns:
        bonds = bonds.withColumnRenamed("order", "bond_order")
    order = F.col("bond_order").try_cast("double")
    good = F.coalesce(~F.isnan(order) & (order > 0) & (order < float("inf")), F.lit(False))
    out = bonds.withColumn("warnings", F.array_compact(F.array(F.when(~good, F.lit("INVALID_BOND_ORDER")))))
    out = out.withColumn("bond_order", F.when(good, order).otherwise(1.0))
    for name in ("bond_aromatic", "conjugated"):
        out = out.withColumn(name, flag(bonds, name))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("invalid bond order in "), F.col("mol_id").cast("string"))).cast("double")
        out = out.withColumn("bond_order", F.when(F.size("warnings") > 0, wrong).otherwise(F.col("bond_order")))
    return out


def composition(atoms: DataFrame) -> DataFrame:
    """(mol_id, element, n): atoms and their implicit hydrogens; what does not stand there has no row."""
    one = atoms.select("mol_id", "element", F.lit(1).cast("long").alias("n"))
    hydrogen = atoms.select("mol_id", F.lit("H").alias("element"), F.col("total_hcount").cast("long").alias("n"))
    return one.unionByName(hydrogen).groupBy("mol_id", "element").agg(F.sum("n").alias("n")).where("n > 0")


def composition_features(atoms: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """Per molecule: a count of each element of `numbers`, atoms, the sum of atomic numbers, atoms squared."""
    of = [F.sum((F.col("element") == e).cast("int")).alias(e.lower()) for e in numbers]
    number = F.coalesce(*(F.when(F.col("element") == e, F.lit(z)) for e, z in numbers.items()))
    return atoms.groupBy("mol_id").agg(*of, F.count("*").alias("heavy"), F.sum(number).alias("electrons"), (F.count("*") * F.count("*")).alias("heavy_square"))


def bond_inventory(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, name, n): bonds by sorted elements and order, those to implicit hydrogens among them."""
    at = lambda c, x: atoms.select("mol_id", F.col("atom_id").alias(c), F.col("element").alias(x)).hint("merge")
    name = lambda x, y, order: F.concat(F.least(x, y), F.lit("-"), F.greatest(x, y), F.lit(";"), order)
    lines = bonds.join(at("a", "x"), ["mol_id", "a"]).join(at("b", "y"), ["mol_id", "b"]).select("mol_id", name(F.col("x"), F.col("y"), F.col("bond_order").cast("int").cast("string")).alias("name"), F.lit(1).alias("n"))
    h = atoms.where("total_hcount > 0").select("mol_id", name(F.lit("H"), F.col("element"), F.lit("1")).alias("name"), F.col("total_hcount").alias("n"))
    return lines.unionByName(h).groupBy("mol_id", "name").agg(F.sum("n").alias("n"))


def graph_components(atoms: DataFrame, bonds: DataFrame, most: int = MOST_PACKED, keep: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """(mol_id, atom_id, comp, *keep): comp is the least atom of the connected component; columns of atoms named in keep stay beside it.

    A molecule of up to `most` atoms and bonds is one row, whose bonds are taken one after the other; larger ones settle by joins.
    sizes: (mol_id, n), bounds of the numbers of atoms and of bonds that are cheaper than counting them.
    """
    two = bonds.select("mol_id", "a", "b")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        both = b.select("mol_id", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        found = settle(a.select("mol_id", F.col("atom_id").alias("node")), both, ["mol_id"]).withColumnRenamed("node", "atom_id")
        return found.join(a.hint("merge"), ["mol_id", "atom_id"]).select("mol_id", "atom_id", "comp", *keep) if keep else found

    def packed(a: DataFrame, b: DataFrame) -> DataFrame:
        ends = b.groupBy("mol_id").agg(F.collect_list(F.struct("a", "b")).alias("ends"))  # one way: either end renames the other
        rows = a.groupBy("mol_id").agg(F.collect_list(F.struct("atom_id", F.col("atom_id").alias("comp"), *keep)).alias("atoms"))
        rows = rows.join(ends.hint("merge"), "mol_id", "left").withColumn("ends", F.coalesce("ends", F.array()))
        met = lambda of, end: _met(of, end, keep)
        return rows.select("mol_id", F.inline_outer(F.aggregate("ends", F.col("atoms"), met)))

    return _both_ways(atoms.select("mol_id", "atom_id", *keep), two, packed, joined, most, sizes)


def _met(atoms: Column, end: Column, keep: tuple[str, ...] = ()) -> Column:
    """atoms(atom_id, comp, *keep) with the components of a bond's ends as one, by the lesser of their names."""
    of = lambda x: F.get(F.filter(atoms, lambda y: y["atom_id"] == x), F.lit(0))["comp"]
    both = F.array(F.struct(of(end["a"]).alias("a"), of(end["b"]).alias("b")))

    def named(p: Column) -> Column:
        less, more = F.least(p["a"], p["b"]), F.greatest(p["a"], p["b"])
        renamed = F.transform(atoms, lambda y: F.struct(y["atom_id"].alias("atom_id"), F.when(y["comp"] == more, less).otherwise(y["comp"]).alias("comp"), *(y[c].alias(c) for c in keep)))
        return F.when(p["a"] != p["b"], renamed).otherwise(atoms)  # a bond with an end that is no atom joins nothing

    return F.get(F.transform(both, named), F.lit(0))


def component_counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    return graph_components(atoms, bonds).groupBy("mol_id").agg(F.countDistinct("comp").alias("components"), F.count("*").alias("atoms"))


def degrees(bonds: DataFrame) -> DataFrame:
    """(mol_id, atom_id, degree) of atoms with a bond."""
    return directed(bonds).groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.count("*").alias("degree"))


def degree_features(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per molecule: atoms, bonds, charges, aromatic atoms, heavy degrees 1 to 4."""
    joined = atoms.join(degrees(bonds).hint("merge"), ["mol_id", "atom_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    counts = [F.sum((F.col("degree") == k).cast("int")).alias(f"degree_{k}") for k in range(1, 5)]
    return joined.groupBy("mol_id").agg(F.count("*").alias("atoms"), (F.sum("degree") / 2).cast("long").alias("bonds"), F.sum("formal_charge").alias("charge"), F.sum(F.abs("formal_charge")).alias("abs_charge"), F.sum(F.col("aromatic").cast("int")).alias("aromatic"), *counts)


def zagreb(bonds: DataFrame) -> DataFrame:
    """Per molecule: sum of d^2 over atoms, of d*d and of 1/sqrt(d*d) over bonds."""
    d = degrees(bonds)
    first = d.groupBy("mol_id").agg(F.sum(F.col("degree") * F.col("degree")).alias("m1"))
    ends = bonds.join(d.select("mol_id", F.col("atom_id").alias("a"), F.col("degree").alias("da")).hint("merge"), ["mol_id", "a"]).join(d.select("mol_id", F.col("atom_id").alias("b"), F.col("degree").alias("db")).hint("merge"), ["mol_id", "b"])
    product = F.col("da") * F.col("db")
    return first.join(ends.groupBy("mol_id").agg(F.sum(product).alias("m2"), F.sum(1 / F.sqrt(product.cast("double"))).alias("randic")).hint("merge"), "mol_id")


def atom_label(aromatic: str = "aromatic") -> Column:
    return F.concat("element", F.when(F.col(aromatic), "*").otherwise(""), F.lit("h"), F.col("total_hcount").cast("string"), F.lit("q"), F.col("formal_charge").cast("string"))


def env_counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, name, n): names of atoms, of atoms with their sorted neighbours, and of bonds with sorted ends."""
    named = atoms.select("mol_id", "atom_id", "element", atom_label().alias("label"))
    ends = directed(bonds).join(named.select("mol_id", F.col("atom_id").alias("b"), F.col("element").alias("other"), F.col("label").alias("other_label")).hint("merge"), ["mol_id", "b"])
    around = ends.groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.array_join(F.sort_array(F.collect_list("other")), ".").alias("around"))
    centred = named.join(around.hint("merge"), ["mol_id", "atom_id"], "left")
    states = named.select("mol_id", F.concat(F.lit("atom_state["), "label", F.lit("]")).alias("name"))
    groups = centred.select("mol_id", F.concat(F.lit("benson_nn["), "element", F.lit("|"), F.coalesce("around", F.lit("")), F.lit("]")).alias("name"))
    bonded = ends.where("a < b").join(named.select("mol_id", F.col("atom_id").alias("a"), "label").hint("merge"), ["mol_id", "a"])
    lines = bonded.select("mol_id", F.concat(F.lit("bond_environment["), F.least("label", "other_label"), F.lit(";"), F.col("bond_order").cast("int").cast("string"), F.lit(";"), F.greatest("label", "other_label"), F.lit("]")).alias("name"))
    return states.unionByName(groups).unionByName(lines).groupBy("mol_id", "name").agg(F.count("*").alias("n"))


def path_counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, name, n): simple paths of three and of four atoms, each once, under the lesser of its two readings."""
    e = atoms.select("mol_id", "atom_id", "element")
    step = directed(bonds).select("mol_id", "a", "b")
    of = lambda c: e.select("mol_id", F.col("atom_id").alias(c), F.col("element").alias(f"e_{c}"))
    named = step.join(of("a").hint("merge"), ["mol_id", "a"]).join(of("b").hint("merge"), ["mol_id", "b"])
    second = named.select("mol_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("e_b").alias("e_c"))
    three = named.join(second.hint("merge"), ["mol_id", "b"]).where("a <> c")
    third = named.select("mol_id", F.col("a").alias("c"), F.col("b").alias("d"), F.col("e_b").alias("e_d"))
    four = three.join(third.hint("merge"), ["mol_id", "c"]).where("d <> a and d <> b and a < d")

    def name(kind: str, *columns: str) -> Column:
        labels = F.array(*columns)
        return F.concat(F.lit(f"{kind}["), F.least(F.array_join(labels, "|"), F.array_join(F.reverse(labels), "|")), F.lit("]"))

    both = three.where("a < c").select("mol_id", name("path_1_3", "e_a", "e_b", "e_c").alias("name")).unionByName(four.select("mol_id", name("path_1_4", "e_a", "e_b", "e_c", "e_d").alias("name")))
    return both.groupBy("mol_id", "name").agg(F.count("*").alias("n"))


def neighbourhood_labels(atoms: DataFrame, bonds: DataFrame, rounds: int, most: int = MOST_PACKED) -> DataFrame:
    """(mol_id, atom_id, label): seed labels refined by hashing each with its sorted bonds and neighbours.

    A molecule of up to `most` atoms and bonds is one row; larger ones join bonds with labels.
    """

    def joined(labels: DataFrame, b: DataFrame) -> DataFrame:
        with joined_in_place(atoms.sparkSession, ["mol_id"], labels, directed(b)) as (labels, step):
            labels, step = checkpointed(labels), checkpointed(step)
            for _ in range(rounds):
                labels = checkpointed(_refined(labels, step))
        return labels

    def packed(labels: DataFrame, b: DataFrame) -> DataFrame:
        rows = _molecule_rows(labels, b)
        for _ in range(rounds):
            rows = rows.select("mol_id", "ends", _refined_atoms(F.col("atoms"), F.col("ends")).alias("atoms"))
        return rows.select("mol_id", F.inline_outer("atoms"))

    return _both_ways(atoms.select("mol_id", "atom_id", F.sha2(atom_label(), 256).alias("label")), bonds, packed, joined, most)


def _refined_atoms(atoms: Column, ends: Column) -> Column:
    """_refined() on the arrays of one molecule: atoms(atom_id, label) and its bonds both ways."""
    label = lambda x: F.get(F.filter(atoms, lambda y: y["atom_id"] == x), F.lit(0))["label"]

    def hashed(x: Column) -> Column:
        own = F.filter(ends, lambda e: e["a"] == x["atom_id"])
        around = F.array_compact(F.transform(own, lambda e: F.concat(e["bond_order"].cast("int").cast("string"), F.lit(":"), label(e["b"]))))
        return F.struct(x["atom_id"].alias("atom_id"), F.sha2(F.concat_ws(",", x["label"], F.array_join(F.sort_array(around), ",")), 256).alias("label"))

    return F.transform(atoms, hashed)


def _refined(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Each label hashed with its sorted bonds and neighbours' labels."""
    near = step.join(labels.select("mol_id", F.col("atom_id").alias("b"), "label").hint("merge"), ["mol_id", "b"])
    around = near.groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.sort_array(F.collect_list(F.concat(F.col("bond_order").cast("int").cast("string"), F.lit(":"), "label"))).alias("around"))  # an atom's bonds
    return labels.join(around.hint("merge"), ["mol_id", "atom_id"], "left").select("mol_id", "atom_id", F.sha2(F.concat_ws(",", "label", F.array_join(F.coalesce("around", F.array().cast("array<string>")), ",")), 256).alias("label"))


def stable_classes(atoms: DataFrame, bonds: DataFrame, most: int = MOST_PACKED) -> DataFrame:
    """(mol_id, atom_id, label): labels refined until no class of any molecule splits further; equal labels are one class.

    Seeds hold element, hydrogens, charge, aromaticity, hybridization (where there is one) and degree. Labels are hashed with their
    own last one, so classes only split; a molecule whose number of classes stays is settled and leaves the rounds. The
    longest way that a difference travels bounds their number. Nulls in a seed count as absent. A molecule of up to `most` atoms and
    bonds is one row.
    """
    parts = ["element", "total_hcount", "formal_charge", "aromatic", *(["hybridization"] if "hybridization" in atoms.columns else []), "degree"]
    known = atoms.join(degrees(bonds).hint("merge"), ["mol_id", "atom_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    seeds = known.select("mol_id", "atom_id", F.sha2(F.array_join(F.array(*(F.col(c).cast("string") for c in parts)), "|", "-"), 256).alias("label"))

    def packed(a: DataFrame, b: DataFrame) -> DataFrame:
        rows = _molecule_rows(a, b)
        start = F.struct(F.col("atoms").alias("atoms"), F.lit(False).alias("settled"))
        found = F.aggregate(F.sequence(F.lit(1), F.size("atoms")), start, lambda now, _: _split(now, F.col("ends")))  # each round splits a class
        return rows.select("mol_id", F.inline_outer(found["atoms"]))

    return _both_ways(seeds, bonds, packed, _stable_joined, most)


def _split(now: Column, ends: Column) -> Column:
    """(atoms, settled) after a further round, which is the last where no class splits."""
    many = lambda atoms: F.size(F.array_distinct(F.transform(atoms, lambda x: x["label"])))
    further = lambda p: F.struct(F.when(many(p) > many(now["atoms"]), p).otherwise(now["atoms"]).alias("atoms"), (many(p) <= many(now["atoms"])).alias("settled"))
    return F.when(now["settled"], now).otherwise(F.get(F.transform(F.array(_refined_atoms(now["atoms"], ends)), further), F.lit(0)))


def _stable_joined(seeds: DataFrame, bonds: DataFrame) -> DataFrame:
    """stable_classes() by joins of bonds and labels, round by round."""
    counted = lambda df: df.join(df.groupBy("mol_id").agg(F.countDistinct("label").alias("classes")).hint("merge"), "mol_id")
    with joined_in_place(seeds.sparkSession, ["mol_id"], seeds, directed(bonds)) as (labels, step):
        step, active = checkpointed(step), checkpointed(counted(checkpointed(labels)))
        settled = active.limit(0).select("mol_id", "atom_id", "label")
        for k in range(1, MOST_REFINED + 1):
            refined = counted(_refined(active.select("mol_id", "atom_id", "label"), step)).withColumnsRenamed({"label": "next", "classes": "more"})
            both = checkpointed(active.join(refined.hint("merge"), ["mol_id", "atom_id"]))
            settled = settled.unionByName(both.where("more = classes").select("mol_id", "atom_id", "label"))
            active = both.where("more > classes").select("mol_id", "atom_id", F.col("next").alias("label"), F.col("more").alias("classes"))
            if not active.limit(1).count():
                return settled
            if k % 32 == 0:
                settled = checkpointed(settled)
    raise RuntimeError(f"classes still split after {MOST_REFINED} rounds")


def hashed_environments(labels: DataFrame, bins: int = 128, prefix: str = "wl") -> DataFrame:
    """(mol_id, name, value): labels counted into signed bins."""
    place, sign = signed_bin(F.col("label"), bins)
    found = labels.select("mol_id", F.concat(F.lit(f"{prefix}_"), F.lpad(place.cast("string"), 3, "0")).alias("name"), sign.alias("sign"))
    return found.groupBy("mol_id", "name").agg(F.sum("sign").alias("value")).where("value <> 0")


def graph_identity(labels: DataFrame, components: DataFrame) -> DataFrame:
    """(mol_id, identity): a digest of the sorted digests of the components' sorted labels; ids play no part."""
    per = labels.join(components.hint("merge"), ["mol_id", "atom_id"]).groupBy("mol_id", "comp").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("label")), ","), 256).alias("part"))
    return per.groupBy("mol_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "."), 256).alias("identity"))


def symmetry_terms(labels: DataFrame) -> DataFrame:
    """Per molecule: number of label classes, pairs of equal atoms, natural entropy of the classes."""
    per = labels.groupBy("mol_id", "label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("mol_id"))
    return per.withColumn("p", share).groupBy("mol_id").agg(F.count("*").alias("classes"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("equivalent_pairs"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def stable_symmetry(atoms: DataFrame, bonds: DataFrame, most: int = MOST_PACKED) -> DataFrame:
    """symmetry_terms() of neighbourhood labels refined until no class of any molecule splits; a null in a seed makes it empty.

    Classes of molecules of up to `most` atoms and bonds are numbers and refined inside tasks; larger ones join bonds with hashed labels.
    """

    def in_tasks(seeds: DataFrame, b: DataFrame) -> DataFrame:
        lines = b.groupBy("mol_id").agg(F.collect_list(F.struct("a", "b", F.col("bond_order").cast("int").alias("kind"))).alias("bonds"))
        rows = seeds.groupBy("mol_id").agg(F.collect_list(F.struct("atom_id", "label")).alias("atoms"))
        return symmetry_rows(rows.join(lines.hint("merge"), "mol_id", "left"))

    def joined(seeds: DataFrame, b: DataFrame) -> DataFrame:
        return symmetry_terms(_stable_joined(seeds.withColumn("label", F.sha2("label", 256)), b))

    seeds = atoms.select("mol_id", "atom_id", F.coalesce(atom_label(), F.lit("")).alias("label"))
    return _both_ways(seeds, bonds, in_tasks, joined, most)


def cycle_rank(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, cycle_rank): bonds - atoms + components."""
    edges = bonds.groupBy("mol_id").agg(F.count("*").alias("edges"))
    return component_counts(atoms, bonds).join(edges.hint("merge"), "mol_id", "left").select("mol_id", (F.coalesce("edges", F.lit(0)) - F.col("atoms") + F.col("components")).alias("cycle_rank"))


def flag(df: DataFrame, name: str) -> Column:
    """A boolean column, false where the frame has none of that name."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def count_of(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def assign_pi(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, atom_id, included, electrons, reason, confidence): one p orbital an atom, by rules in this order.

    Open-shell atoms, ends of triple bonds, elements but C, N, O and S, and charges beyond one are left out, as is what has
    neither an aromatic flag nor a double bond. Electrons are null for what is left out.
    """
    top = directed(bonds).groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.max("bond_order").alias("top"))
    j = atoms.join(top.hint("merge"), ["mol_id", "atom_id"], "left")
    element, charge = F.col("element"), F.col("formal_charge")
    ring, double = flag(atoms, "aromatic"), F.coalesce(F.col("top") >= 2, F.lit(False))
    by_charge = 1 - charge  # carbon
    anion = F.when(charge == -1, 2).otherwise(1)
    # (condition, reason, electrons, confidence)
    rules = [
        (count_of(atoms, "radical_electrons") != 0, "open_shell", None, "unsupported"),
        (F.col("top") >= 3, "triple_bond", None, "unsupported"),
        (~element.isin("C", "N", "O", "S"), "unsupported_element", None, "unsupported"),
        ((ring | double) & (F.abs(charge) > 1), "charge_out_of_range", None, "unsupported"),
        (ring & (element == "C"), "aromatic_carbon", by_charge, "high"),
        (ring & (element == "N") & (F.col("total_hcount") > 0), "pyrrole_like", F.lit(2), "high"),
        (ring & (element == "N") & (charge == -1), "anionic_nitrogen", F.lit(2), "medium"),
        (ring & (element == "N"), "pyridine_like", F.lit(1), "high"),
        (ring, "aromatic_donor", F.lit(2), "medium"),
        (double & (element == "C"), "double_bond_carbon", by_charge, "high"),
        (double, "double_bond_hetero", anion, "medium"),
    ]
    pick = lambda k: F.coalesce(*(F.when(rule[0], F.lit(rule[k])) for rule in rules))
    electrons = F.lit(None).cast("int")
    for condition, _, value, _ in reversed(rules):
        electrons = F.when(condition, F.lit(None).cast("int") if value is None else value.cast("int")).otherwise(electrons)
    return j.select("mol_id", "atom_id", electrons.isNotNull().alias("included"), electrons.alias("electrons"), F.coalesce(pick(1), F.lit("none")).alias("reason"), F.coalesce(pick(3), F.lit("high")).alias("confidence"))


def coupled(pi: DataFrame, bonds: DataFrame) -> DataFrame:
    """The bonds that couple two included atoms: aromatic, conjugated, or of order 2 at least."""
    on = pi.where("included").select("mol_id", "atom_id")
    near = bonds.where(flag(bonds, "bond_aromatic") | flag(bonds, "conjugated") | (F.col("bond_order") >= 2))
    return near.join(on.select("mol_id", F.col("atom_id").alias("a")).hint("merge"), ["mol_id", "a"], "left_semi").join(on.select("mol_id", F.col("atom_id").alias("b")).hint("merge"), ["mol_id", "b"], "left_semi")


def pi_systems(pi: DataFrame, bonds: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(mol_id, system, sites, electrons): components of the included atoms over coupling bonds.

    sizes: molecule_sizes() of what pi was made from, so that pi is not made once more to be counted.
    """
    on = pi.where("included").select("mol_id", "atom_id", "electrons")
    found = graph_components(on, coupled(pi, bonds), keep=("electrons",), sizes=sizes)
    return found.groupBy("mol_id", F.col("comp").alias("system")).agg(F.count("*").alias("sites"), F.sum("electrons").alias("electrons"))


def pi_matrix(pi: DataFrame, atoms: DataFrame, bonds: DataFrame, alpha: dict[str, float], beta: dict[float, float]) -> DataFrame:
    """(mol_id, system, i, j, value): the diagonal by element, both off-diagonal entries by bond order; a system is named by its
    least atom. An element or a bond order without a parameter is an error."""
    on = pi.where("included").select("mol_id", "atom_id")
    inside = coupled(pi, bonds)
    systems = checkpointed(graph_components(on, inside).select("mol_id", "atom_id", F.col("comp").alias("system")))

    def pick(column: Column, table: dict, what: str) -> Column:
        unknown = F.raise_error(F.concat(F.lit(f"no parameter for {what} "), F.coalesce(column.cast("string"), F.lit("null")))).cast("double")
        return F.coalesce(*(F.when(column == k, F.lit(float(v))) for k, v in table.items()), unknown)

    own = atoms.select("mol_id", "atom_id", "element").join(systems.hint("merge"), ["mol_id", "atom_id"]).select("mol_id", "system", F.col("atom_id").alias("i"), F.col("atom_id").alias("j"), pick(F.col("element"), alpha, "element").alias("value"))
    off = directed(inside).join(systems.select("mol_id", F.col("atom_id").alias("a"), "system").hint("merge"), ["mol_id", "a"])
    return own.unionByName(off.select("mol_id", "system", F.col("a").alias("i"), F.col("b").alias("j"), pick(F.col("bond_order"), beta, "bond order").alias("value")))


def spectral_moments(matrix: DataFrame, sizes: DataFrame | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Per molecule the traces of the second, third and fourth power of each system's matrix over the system's size, summed over its systems.

    A molecule of up to `most` entries is one row; larger ones are joined. sizes: (mol_id, n), bounds of the number of entries that are
    cheaper than counting them.
    """
    sizes = matrix.groupBy("mol_id").agg(F.count("*").alias("n")) if sizes is None else sizes
    large = checkpointed(sizes.where(F.col("n") > most).select("mol_id"))
    if not large.limit(1).count():
        return _packed_moments(matrix)
    cut = lambda how: matrix.join(large.hint("merge"), "mol_id", how)
    return _packed_moments(cut("left_anti")).unionByName(_joined_moments(cut("left_semi")))


def _packed_moments(matrix: DataFrame) -> DataFrame:
    """spectral_moments(), a row a molecule."""
    rows = matrix.groupBy("mol_id").agg(F.collect_list(F.struct("system", "i", "j", "value")).alias("x")).select("mol_id", *(F.col(f"x.{c}").alias(c) for c in ("system", "i", "j", "value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_traces(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in found], pa.float64()) for k in range(3))], names=["mol_id", "m2", "m3", "m4"])

    return rows.mapInArrow(run, StructType([matrix.schema["mol_id"], *(StructField(m, DoubleType()) for m in ("m2", "m3", "m4"))]))


def _traces(system: list, i: list, j: list, value: list) -> tuple[float, float, float]:
    """The moments of one molecule from the entries of its systems' matrices; entries of one place add up."""
    held: dict = {}
    for s, x, y, v in zip(system, i, j, value, strict=True):
        row = held.setdefault(s, {}).setdefault(x, {})
        row[y] = row.get(y, 0.0) + v
    second = third = fourth = 0.0
    for rows in held.values():
        square: dict = {}
        for x, row in rows.items():
            out = square[x] = {}
            for y, v in row.items():
                for z, w in rows.get(y, {}).items():
                    out[z] = out.get(z, 0.0) + v * w
        n = len(rows)
        second += sum(out.get(x, 0.0) for x, out in square.items()) / n
        third += sum(s * rows.get(z, {}).get(x, 0.0) for x, out in square.items() for z, s in out.items()) / n
        fourth += sum(s * square.get(z, {}).get(x, 0.0) for x, out in square.items() for z, s in out.items()) / n
    return second, third, fourth


def _joined_moments(matrix: DataFrame) -> DataFrame:
    """spectral_moments() by joins of entries."""
    keys = ["mol_id", "system"]
    matrix = checkpointed(matrix)
    right = matrix.select(*keys, F.col("i").alias("j"), F.col("j").alias("k"), F.col("value").alias("w"))
    square = matrix.join(right.hint("merge"), [*keys, "j"]).groupBy(*keys, "i", "k").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    size = matrix.groupBy(*keys).agg(F.countDistinct("i").alias("size"))
    second = square.where("i = k").groupBy(*keys).agg(F.sum("s").alias("m2"))
    third = square.join(matrix.select(*keys, F.col("j").alias("i"), F.col("i").alias("k"), "value").hint("merge"), [*keys, "i", "k"]).groupBy(*keys).agg(F.sum(F.col("s") * F.col("value")).alias("m3"))
    fourth = square.join(square.select(*keys, F.col("i").alias("k"), F.col("k").alias("i"), F.col("s").alias("t")).hint("merge"), [*keys, "i", "k"]).groupBy(*keys).agg(F.sum(F.col("s") * F.col("t")).alias("m4"))
    joined = size.join(second.hint("merge"), keys, "left").join(third.hint("merge"), keys, "left").join(fourth.hint("merge"), keys, "left")
    return joined.groupBy("mol_id").agg(*(F.sum(F.coalesce(m, F.lit(0.0)) / F.col("size")).alias(m) for m in ("m2", "m3", "m4")))


def charge_topology(atoms: DataFrame, distances: DataFrame, most: int = 4) -> DataFrame:
    """Per molecule and distance 1 to `most`: sums of the difference and of the product of partial charges."""
    q = lambda c: atoms.select("mol_id", F.col("atom_id").alias(c), F.col("partial_charge").alias(f"q_{c}"))
    j = distances.where(F.col("d") <= most).join(q("a").hint("merge"), ["mol_id", "a"]).join(q("b").hint("merge"), ["mol_id", "b"])
    return j.groupBy("mol_id", "d").agg(F.sum(F.abs(F.col("q_a") - F.col("q_b"))).alias("difference"), F.sum(F.col("q_a") * F.col("q_b")).alias("product"))


def charge_decay(atoms: DataFrame, bonds: DataFrame, distances: DataFrame) -> DataFrame:
    """Per molecule: over all pairs that a path joins, sums of the difference and of the product of partial charges, each times 2^-d;
    the differences between a donor and an acceptor 2, 3 and 4 bonds apart; bonds whose ends have charges of unlike sign.

    atoms need boolean columns donor and acceptor. A pair with a null charge counts nowhere; a molecule without pairs has zeros.
    """
    at = lambda c: atoms.select("mol_id", F.col("atom_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("partial_charge", "donor", "acceptor"))).hint("merge")
    ends = lambda df: df.join(at("a"), ["mol_id", "a"]).join(at("b"), ["mol_id", "b"])
    qa, qb = F.col("partial_charge_a"), F.col("partial_charge_b")
    difference, product, weight = F.abs(qa - qb), qa * qb, F.pow(F.lit(2.0), -F.col("d"))
    bridge = (F.col("donor_a") & F.col("acceptor_b")) | (F.col("donor_b") & F.col("acceptor_a"))
    apart = [F.sum(F.when(bridge & (F.col("d") == k), difference)).alias(f"bridge_{k}") for k in (2, 3, 4)]
    pairs = ends(distances).groupBy("mol_id").agg(F.sum(weight * difference).alias("decay_difference"), F.sum(weight * product).alias("decay_product"), *apart)
    unlike = (product < 0) & (F.abs(qa) > 1e-12) & (F.abs(qb) > 1e-12)
    signs = ends(bonds.select("mol_id", "a", "b")).groupBy("mol_id").agg(F.sum(F.when(unlike, 1).otherwise(0)).alias("sign_changes"))
    joined = atoms.select("mol_id").distinct().join(pairs.hint("merge"), "mol_id", "left").join(signs.hint("merge"), "mol_id", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("decay_difference", "decay_product", "bridge_2", "bridge_3", "bridge_4")]
    return joined.select("mol_id", *zero, F.coalesce("sign_changes", F.lit(0)).alias("sign_changes"))


def formal_charge_terms(atoms: DataFrame, distances: DataFrame, hardness: dict[str, float] | None = None) -> DataFrame:
    """Per molecule: sum of |q|, of the element's hardness times q^2, of q*q/d over charged pairs, of |q*q|/d over pairs of like and
    of unlike sign."""
    table = F.coalesce(*(F.when(F.col("element") == k, F.lit(float(v))) for k, v in (hardness or {}).items()), F.lit(0.0))
    square = F.col("formal_charge") * F.col("formal_charge")
    own = atoms.groupBy("mol_id").agg(F.sum(F.abs("formal_charge")).alias("magnitude"), F.sum(table * square).alias("hardness"))
    c = lambda x: atoms.where("formal_charge <> 0").select("mol_id", F.col("atom_id").alias(x), F.col("formal_charge").alias(f"q_{x}"))
    j = distances.join(c("a").hint("merge"), ["mol_id", "a"]).join(c("b").hint("merge"), ["mol_id", "b"])
    near = F.col("q_a") * F.col("q_b")
    pairs = j.groupBy("mol_id").agg(F.sum(near / F.col("d")).alias("coulomb"), F.sum(F.when(near > 0, near / F.col("d")).otherwise(0.0)).alias("like"), F.sum(F.when(near < 0, -near / F.col("d")).otherwise(0.0)).alias("unlike"))
    return own.join(pairs.hint("merge"), "mol_id", "left").select("mol_id", "magnitude", "hardness", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("coulomb", "like", "unlike")))


def steric_terms(atoms: DataFrame, bonds: DataFrame, radius: dict[str, float]) -> DataFrame:
    """Per molecule: 1-3 crowding by radius product, tertiary and quaternary atoms, adjacent branching."""
    r = F.coalesce(*(F.when(F.col("element") == k, F.lit(v)) for k, v in radius.items()), F.lit(1.0))
    size = atoms.select("mol_id", "atom_id", r.alias("r"))
    step = directed(bonds).select("mol_id", "a", "b").join(size.select("mol_id", F.col("atom_id").alias("b"), "r").hint("merge"), ["mol_id", "b"])
    other = step.select("mol_id", "a", F.col("b").alias("c"), F.col("r").alias("s"))
    crowd = step.join(other.hint("merge"), ["mol_id", "a"]).where("b < c").groupBy("mol_id").agg(F.sum(F.col("r") * F.col("s")).alias("crowding"), F.count("*").alias("neighbour_pairs"))
    d = degrees(bonds)
    branch = d.groupBy("mol_id").agg(F.sum((F.col("degree") == 3).cast("int")).alias("tertiary"), F.sum((F.col("degree") >= 4).cast("int")).alias("quaternary"))
    ends = bonds.join(d.select("mol_id", F.col("atom_id").alias("a"), F.col("degree").alias("da")).hint("merge"), ["mol_id", "a"]).join(d.select("mol_id", F.col("atom_id").alias("b"), F.col("degree").alias("db")).hint("merge"), ["mol_id", "b"])
    beside = ends.groupBy("mol_id").agg(F.sum(((F.col("da") >= 3) & (F.col("db") >= 3)).cast("int")).alias("adjacent_branches"))
    return branch.join(beside.hint("merge"), "mol_id").join(crowd.hint("merge"), "mol_id", "left").select("mol_id", "tertiary", "quaternary", "adjacent_branches", F.coalesce("crowding", F.lit(0.0)).alias("crowding"), F.coalesce("neighbour_pairs", F.lit(0)).alias("neighbour_pairs"))


def bond_energy(atoms: DataFrame, bonds: DataFrame, table: dict[tuple[str, str, float], float], hydrogen: dict[str, float], fallback: float) -> DataFrame:
    """Per molecule: minus the tabulated energies of its bonds and of its hydrogens.

    A missing (element, element, order) falls back to order 1, then to a constant.
    """
    spark = atoms.sparkSession
    listed = spark.createDataFrame([(*sorted(k[:2]), float(k[2]), float(v)) for k, v in table.items()], "x string, y string, o double, e double")
    element = lambda c: atoms.select("mol_id", F.col("atom_id").alias(c), F.col("element").alias(f"e_{c}"))
    j = bonds.join(element("a").hint("merge"), ["mol_id", "a"]).join(element("b").hint("merge"), ["mol_id", "b"]).select("mol_id", F.least("e_a", "e_b").alias("x"), F.greatest("e_a", "e_b").alias("y"), F.col("bond_order").alias("o"))
    single = listed.where("o = 1").select("x", "y", F.col("e").alias("e1"))
    found = j.join(F.broadcast(listed), ["x", "y", "o"], "left").join(F.broadcast(single), ["x", "y"], "left")
    lines = found.select("mol_id", F.coalesce("e", "e1", F.lit(fallback)).alias("e"))
    h = F.coalesce(*(F.when(F.col("element") == k, F.lit(v)) for k, v in hydrogen.items()), F.lit(fallback))
    return lines.unionByName(atoms.select("mol_id", (h * F.col("total_hcount")).alias("e"))).groupBy("mol_id").agg((-F.sum("e")).alias("energy"))


def rings_of_closures(bonds: DataFrame) -> DataFrame:
    """(mol_id, ring, atom_id, pos): the four-rings (i, i+1, i+2, i+3) whose four bonds are all there."""
    chain = bonds.where("b = a + 1").select("mol_id", "a")
    at = lambda k: chain.select("mol_id", (F.col("a") - k).alias("a")).hint("merge")
    rings = bonds.where("b = a + 3").select("mol_id", "a").join(at(0), ["mol_id", "a"], "left_semi").join(at(1), ["mol_id", "a"], "left_semi").join(at(2), ["mol_id", "a"], "left_semi")
    return rings.select("mol_id", F.col("a").alias("ring"), F.posexplode(F.sequence("a", F.col("a") + 3)).alias("pos", "atom_id"))


def ring_terms(rings: DataFrame) -> DataFrame:
    """Per molecule: rings, junction atoms, pairs of rings with one atom in common, with the two ends of a side of both, and
    with other two or more atoms; sides of two rings or more, each once."""
    many = rings.groupBy("mol_id").agg(F.countDistinct("ring").alias("rings"))
    junction = rings.groupBy("mol_id", "atom_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("mol_id").agg(F.count("*").alias("junctions"))
    other = rings.select("mol_id", "atom_id", F.col("ring").alias("other"))
    shared = rings.join(other.hint("merge"), ["mol_id", "atom_id"]).where("ring < other").groupBy("mol_id", "ring", "other").agg(F.count("*").alias("n"))
    sides = ring_edges(rings)
    both = sides.join(sides.withColumnRenamed("ring", "other").hint("merge"), ["mol_id", "a", "b"]).where("ring < other").groupBy("mol_id", "ring", "other").agg(F.count("*").alias("sides"))
    shared = shared.join(both.hint("merge"), ["mol_id", "ring", "other"], "left").withColumn("sides", F.coalesce("sides", F.lit(0)))
    fused = (F.col("n") == 2) & (F.col("sides") > 0)
    pairs = shared.groupBy("mol_id").agg(F.sum((F.col("n") == 1).cast("int")).alias("spiro"), F.sum(fused.cast("int")).alias("fused"), F.sum(((F.col("n") >= 2) & ~fused).cast("int")).alias("bridged"))
    common = sides.groupBy("mol_id", "a", "b").agg(F.count("*").alias("n")).where("n > 1").groupBy("mol_id").agg(F.count("*").alias("shared_sides"))
    out = many.join(junction.hint("merge"), "mol_id", "left").join(pairs.hint("merge"), "mol_id", "left").join(common.hint("merge"), "mol_id", "left")
    return out.select("mol_id", "rings", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("junctions", "spiro", "fused", "bridged", "shared_sides")))


def small_ring_terms(rings: DataFrame, bonds: DataFrame, small: tuple[int, int] = (3, 4), medium: tuple[int, int] = (8, 11)) -> DataFrame:
    """Per molecule: small rings with single sides only, and with other ones; medium rings; bridgeheads, atoms of three rings or more;
    the sum of the sizes' squared distances from six, and the variance of the sizes."""
    size = rings.groupBy("mol_id", "ring").agg(F.count("*").alias("size"))
    rich = bonds.where(bond_class(F.col("bond_order"), flag(bonds, "bond_aromatic")) != "single").select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    inside = ring_edges(rings).join(rich.hint("merge"), ["mol_id", "a", "b"]).groupBy("mol_id", "ring").agg(F.count("*").alias("rich"))
    j = size.join(inside.hint("merge"), ["mol_id", "ring"], "left")
    little = F.col("size").between(*small)
    heads = rings.groupBy("mol_id", "atom_id").agg(F.count("*").alias("n")).where("n >= 3").groupBy("mol_id").agg(F.count("*").alias("bridgeheads"))
    count = lambda c: F.sum(c.cast("int"))
    out = j.groupBy("mol_id").agg(count(little & F.col("rich").isNull()).alias("saturated_small"), count(little & F.col("rich").isNotNull()).alias("unsaturated_small"), count(F.col("size").between(*medium)).alias("medium"), F.sum((F.col("size") - 6) * (F.col("size") - 6)).cast("double").alias("size_deviation"), F.var_pop("size").alias("size_variance"))
    return out.join(heads.hint("merge"), "mol_id", "left").withColumn("bridgeheads", F.coalesce("bridgeheads", F.lit(0)))


def ring_strain(rings: DataFrame, by_size: dict[int, float], fused: float, large: float = 0.0) -> DataFrame:
    """Per molecule: tabulated strain of each ring's size (`large` for sizes out of the table), and an increment for each further ring
    that an atom is in."""
    size = rings.groupBy("mol_id", "ring").agg(F.count("*").alias("size"))
    value = F.coalesce(*(F.when(F.col("size") == k, F.lit(float(v))) for k, v in by_size.items()), F.lit(float(large)))
    own = size.groupBy("mol_id").agg(F.sum(value).alias("own"))
    extra = rings.groupBy("mol_id", "atom_id").agg((F.count("*") - 1).alias("n")).groupBy("mol_id").agg(F.sum("n").alias("extra"))
    return own.join(extra.hint("merge"), "mol_id").select("mol_id", (F.col("own") + F.col("extra") * F.lit(float(fused))).alias("strain"))


def ring_edges(rings: DataFrame) -> DataFrame:
    """(mol_id, ring, a, b), a < b: the sides of each ring, from rings(mol_id, ring, atom_id, pos)."""
    order = Window.partitionBy("mol_id", "ring").orderBy("pos")
    first = F.first("atom_id").over(order)
    side = rings.select("mol_id", "ring", "atom_id", F.coalesce(F.lead("atom_id").over(order), first).alias("next"))
    return side.select("mol_id", "ring", F.least("atom_id", "next").alias("a"), F.greatest("atom_id", "next").alias("b")).where("a < b")


def pi_ring_parity(rings: DataFrame, pi: DataFrame, bonds: DataFrame, penalty: float) -> DataFrame:
    """Per molecule: penalty times size for each ring of included atoms, all of whose sides couple, whose electrons are a
    multiple of four above 0."""
    j = rings.join(pi.select("mol_id", "atom_id", "included", "electrons").hint("merge"), ["mol_id", "atom_id"]).groupBy("mol_id", "ring").agg(F.count("*").alias("size"), F.bool_and("included").alias("whole"), F.sum("electrons").alias("electrons"))
    ends = coupled(pi, bonds).select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = ring_edges(rings).join(ends.hint("merge"), ["mol_id", "a", "b"]).groupBy("mol_id", "ring").agg(F.count("*").alias("sides"))
    j = j.join(sides.hint("merge"), ["mol_id", "ring"], "left")
    wrong = F.col("whole") & (F.coalesce("sides", F.lit(0)) == F.col("size")) & (F.col("electrons") > 0) & (F.col("electrons") % 4 == 0)
    return j.groupBy("mol_id").agg(F.sum(F.when(wrong, F.col("size") * F.lit(penalty)).otherwise(0.0)).alias("penalty"))


def ring_names(rings: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, name, n): rings by size, aromatic atoms, unsaturated bonds inside the ring, and sorted elements."""
    own = rings.join(atoms.select("mol_id", "atom_id", "element", "aromatic").hint("merge"), ["mol_id", "atom_id"])
    per = own.groupBy("mol_id", "ring").agg(F.count("*").alias("size"), F.sum(F.col("aromatic").cast("int")).alias("arom"), F.array_join(F.sort_array(F.collect_list("element")), ",").alias("elements"))  # as many as a ring has
    rich = bonds.where(bond_class(F.col("bond_order"), flag(bonds, "bond_aromatic")) != "single").select("mol_id", "a", "b")
    at = lambda c: rings.select("mol_id", "ring", F.col("atom_id").alias(c)).hint("merge")
    inside = rich.join(at("a"), ["mol_id", "a"]).join(at("b"), ["mol_id", "ring", "b"]).groupBy("mol_id", "ring").agg(F.count("*").alias("unsat"))
    j = per.join(inside.hint("merge"), ["mol_id", "ring"], "left")
    name = F.format_string("ring[size=%d;arom_atoms=%d;unsat_edges=%d;elements=%s]", "size", "arom", F.coalesce("unsat", F.lit(0).cast("long")), "elements")
    return j.groupBy("mol_id", name.alias("name")).agg(F.count("*").alias("n"))


def exocyclic_bonds(rings: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, exocyclic): double and triple bonds of which one end lies in a ring."""
    inside = rings.select("mol_id", "atom_id").distinct()
    at = lambda c: inside.select("mol_id", F.col("atom_id").alias(c), F.lit(1).alias(f"r{c}")).hint("merge")
    rich = bonds.where(bond_class(F.col("bond_order"), flag(bonds, "bond_aromatic")).isin("double", "triple")).select("mol_id", "a", "b")
    j = rich.join(at("a"), ["mol_id", "a"], "left").join(at("b"), ["mol_id", "b"], "left")
    return j.groupBy("mol_id").agg(F.sum((F.col("ra").isNull() != F.col("rb").isNull()).cast("int")).alias("exocyclic"))


def composition_reference(atoms: DataFrame, values: dict[str, float]) -> DataFrame:
    """(mol_id, status, score): sum of element values; an element without one makes the score null."""
    value = F.coalesce(*(F.when(F.col("element") == k, F.lit(v)) for k, v in values.items()))
    per = atoms.groupBy("mol_id").agg(F.bool_or(value.isNull()).alias("unknown"), F.sum(value).alias("score"))
    return per.select("mol_id", F.when(F.col("unknown"), "unsupported").otherwise("success").alias("status"), F.when(~F.col("unknown"), F.col("score")).alias("score"))


def local_ledger(atoms: DataFrame, bonds: DataFrame, baseline: float = 1.0) -> DataFrame:
    """(mol_id, term, value): an atom baseline, minus the bond orders, a quarter of the absolute charges."""
    own = atoms.groupBy("mol_id").agg((F.count("*") * F.lit(baseline)).alias("atoms"), (F.sum(F.abs("formal_charge")) * 0.25).alias("charge"))
    lines = bonds.groupBy("mol_id").agg((-F.sum("bond_order")).alias("bonds"))
    terms = own.join(lines.hint("merge"), "mol_id", "left").select("mol_id", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias("value")) for t in ("atoms", "charge", "bonds")))).alias("t"))
    return terms.select("mol_id", "t.term", "t.value")


def ledger_score(terms: DataFrame, exclude: tuple[str, ...] = (), override: dict[str, float] | None = None) -> DataFrame:
    """(mol_id, score): named terms summed, some left out or given another value."""
    value = F.col("value")
    for name, other in (override or {}).items():
        value = F.when(F.col("term") == name, F.lit(float(other))).otherwise(value)
    return terms.groupBy("mol_id").agg(F.sum(F.when(F.col("term").isin(*exclude), 0.0).otherwise(value) if exclude else value).alias("score"))


def pair_distance_terms(coords: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per molecule over non-bonded pairs of coords(mol_id, atom_id, q, x, y, z): q*q/r and exp(-r), r being 1/2 at least."""
    one = coords.select("mol_id", F.col("atom_id").alias("a"), *(F.col(c).alias(f"{c}1") for c in "qxyz"))
    two = coords.select("mol_id", F.col("atom_id").alias("b"), *(F.col(c).alias(f"{c}2") for c in "qxyz"))
    far = one.join(two.hint("merge"), "mol_id").where("a < b").join(bonds.select("mol_id", "a", "b").hint("merge"), ["mol_id", "a", "b"], "left_anti")
    r = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
    return far.withColumn("r", F.greatest(r, F.lit(0.5))).groupBy("mol_id").agg(F.sum(F.col("q1") * F.col("q2") / F.col("r")).alias("coulomb"), F.sum(F.exp(-F.col("r"))).alias("overlap"))


def rotatable(bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """(mol_id, rotatable): single bonds whose ends are no ring neighbours and have further bonds."""
    d = degrees(bonds).where("degree > 1")
    ring_atoms = rings.select("mol_id", "atom_id").distinct()
    s = bonds.where("bond_order = 1").join(d.select("mol_id", F.col("atom_id").alias("a")).hint("merge"), ["mol_id", "a"], "left_semi").join(d.select("mol_id", F.col("atom_id").alias("b")).hint("merge"), ["mol_id", "b"], "left_semi")
    inside = ring_atoms.select("mol_id", F.col("atom_id").alias("a"))
    free = s.join(inside.hint("merge"), ["mol_id", "a"], "left_anti").join(ring_atoms.select("mol_id", F.col("atom_id").alias("b")).hint("merge"), ["mol_id", "b"], "left_anti")
    return free.groupBy("mol_id").agg(F.count("*").alias("rotatable"))


def resonance_terms(atoms: DataFrame, bonds: DataFrame, most: int = MOST_PACKED) -> DataFrame:
    """Per molecule: components, sites and the largest component of the resonance graph, branch centres (three neighbours),
    cross-conjugated ones (not aromatic), and simple paths of two, three and four bonds, each once.

    Sites are aromatic, SP or SP2, or N, O or S without a positive charge and with a lone pair; links are aromatic, conjugated
    or of order 1.5 at least. Molecules of up to `most` atoms and bonds are worked on whole, inside tasks; larger ones are joined.
    """
    hybrid = F.col("hybridization").isin("SP", "SP2") if "hybridization" in atoms.columns else F.lit(False)
    donor = F.col("element").isin("N", "O", "S") & (F.col("formal_charge") <= 0) & (count_of(atoms, "lone_pairs") > 0)
    sites = atoms.where((F.col("element") != "H") & (flag(atoms, "aromatic") | hybrid | donor)).select("mol_id", "atom_id", flag(atoms, "aromatic").alias("aromatic"))
    links = bonds.where(flag(bonds, "bond_aromatic") | flag(bonds, "conjugated") | (F.col("bond_order") >= 1.5)).select("mol_id", "a", "b", "bond_order")
    return _both_ways(sites, links, resonance_rows, _joined_resonance, most, molecule_sizes(atoms, bonds))


def _joined_resonance(sites: DataFrame, links: DataFrame) -> DataFrame:
    """resonance_terms() by joins."""
    at = lambda c: sites.select("mol_id", F.col("atom_id").alias(c)).hint("merge")
    links = checkpointed(links.join(at("a"), ["mol_id", "a"], "left_semi").join(at("b"), ["mol_id", "b"], "left_semi"))
    step = directed(links).select("mol_id", "a", "b").distinct()
    parts = graph_components(sites, links).groupBy("mol_id", "comp").agg(F.count("*").alias("n"))
    out = parts.groupBy("mol_id").agg(F.count("*").alias("components"), F.sum("n").alias("sites"), F.max("n").alias("largest"))
    branch = step.groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.count("*").alias("degree")).where("degree >= 3").join(sites.hint("merge"), ["mol_id", "atom_id"])
    out = out.join(branch.groupBy("mol_id").agg(F.count("*").alias("branch_centres"), F.sum((~F.col("aromatic")).cast("int")).alias("cross_conjugated")).hint("merge"), "mol_id", "left")
    walk = step.select("mol_id", F.array("a", "b").alias("path"), "b")
    for length in (2, 3, 4):
        walk = walk.select("mol_id", "path", F.col("b").alias("a")).join(step.hint("merge"), ["mol_id", "a"]).where(~F.array_contains("path", F.col("b"))).select("mol_id", F.concat("path", F.array("b")).alias("path"), "b")
        once = walk.where(F.element_at("path", 1) < F.col("b")).groupBy("mol_id").agg(F.count("*").alias(f"paths_{length}"))
        out = out.join(once.hint("merge"), "mol_id", "left")
    names = ("branch_centres", "cross_conjugated", "paths_2", "paths_3", "paths_4")
    return out.select("mol_id", "components", "sites", "largest", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def localized_bonds(pi: DataFrame, atoms: DataFrame, bonds: DataFrame, alpha: dict[str, float], beta: float, increments: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """Per molecule: over coupling bonds of order 1.5 at least the two-orbital gain against separate orbitals, and an
    increment for each such bond of unlike elements that is not aromatic."""
    pick = F.coalesce(*(F.when(F.col("element") == k, F.lit(float(v))) for k, v in alpha.items()), F.lit(0.0))
    own = atoms.select("mol_id", "atom_id", "element", pick.alias("alpha"))
    end = lambda c, e, x: own.select("mol_id", F.col("atom_id").alias(c), F.col("element").alias(e), F.col("alpha").alias(x)).hint("merge")
    j = coupled(pi, bonds).where("bond_order >= 1.5").join(end("a", "e1", "x"), ["mol_id", "a"]).join(end("b", "e2", "y"), ["mol_id", "b"])
    half = (F.col("x") - F.col("y")) / 2
    more = F.coalesce(*(F.when((F.least("e1", "e2") == min(k)) & (F.greatest("e1", "e2") == max(k)), F.lit(float(v))) for k, v in (increments or {}).items()), F.lit(0.0))
    return j.groupBy("mol_id").agg(F.sum(-2 * F.sqrt(half * half + F.lit(beta * beta))).alias("localized"), F.sum(F.when(flag(bonds, "bond_aromatic"), 0.0).otherwise(more)).alias("increment"))


def local_signatures(atoms: DataFrame, bonds: DataFrame, distances: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(mol_id, kind, signature): of atoms with their neighbours, of bonds with their ends, and of atom pairs `least` to `most` bonds apart."""
    own, lines = _seeds(atoms), _kinds(bonds)
    both = lines.unionByName(lines.select("mol_id", F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    at = lambda c, *keep: own.select("mol_id", F.col("atom_id").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in keep)).hint("merge")
    near = both.join(at("b", "brief"), ["mol_id", "b"]).groupBy("mol_id", F.col("a").alias("atom_id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", "brief_b"))), ",").alias("near"), F.count("*").alias("degree"))
    single = own.join(near.hint("merge"), ["mol_id", "atom_id"], "left").select("mol_id", F.lit("atom").alias("kind"), F.concat_ws("|", "seed", F.coalesce("degree", F.lit(0)).cast("string"), F.coalesce("near", F.lit(""))).alias("signature"))
    ends = lambda df: df.join(at("a", "seed"), ["mol_id", "a"]).join(at("b", "seed"), ["mol_id", "b"])
    pair = lambda head: F.concat_ws("~", head, F.least("seed_a", "seed_b"), F.greatest("seed_a", "seed_b"))
    bond = ends(lines).select("mol_id", F.lit("bond").alias("kind"), pair(F.col("kind")).alias("signature"))
    far = ends(distances.where(F.col("d").between(least, most))).select("mol_id", F.lit("atom_pair").alias("kind"), pair(F.col("d").cast("string")).alias("signature"))
    return single.unionByName(bond).unionByName(far)


def signature_bins(atoms: DataFrame, bonds: DataFrame, least: int = 2, most: int = 4, bins: int = 128, size: int = MOST_PACKED) -> DataFrame:
    """hashed_signatures() of local_signatures(); molecules of up to `size` atoms and bonds are worked on whole, inside tasks."""

    def packed(a: DataFrame, b: DataFrame) -> DataFrame:
        return signature_rows(_seeds(a), _kinds(b), least, most, bins)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return hashed_signatures(local_signatures(a, b, graph_distances(b, most), least, most), bins)

    return _both_ways(atoms, bonds, packed, joined, size)


def _seeds(atoms: DataFrame) -> DataFrame:
    """(mol_id, atom_id, seed, brief): the texts of an atom, and of an atom as a neighbour."""
    seed = F.concat_ws("|", "element", F.col("aromatic").cast("int").cast("string"), F.col("formal_charge").cast("string"), F.col("total_hcount").cast("string"))
    return atoms.select("mol_id", "atom_id", seed.alias("seed"), F.concat_ws(":", "element", F.col("formal_charge").cast("string"), F.col("aromatic").cast("int").cast("string")).alias("brief"))


def _kinds(bonds: DataFrame) -> DataFrame:
    return bonds.select("mol_id", "a", "b", bond_class(F.col("bond_order"), flag(bonds, "bond_aromatic")).alias("kind"))


def hashed_signatures(signatures: DataFrame, bins: int = 128) -> DataFrame:
    """(mol_id, name, value): signatures of each kind counted into signed bins."""
    place, sign = signed_bin(F.col("signature"), bins)
    found = signatures.select("mol_id", F.concat("kind", F.lit("_"), F.lpad(place.cast("string"), 3, "0")).alias("name"), sign.alias("sign"))
    return found.groupBy("mol_id", "name").agg(F.sum("sign").alias("value")).where("value <> 0")
