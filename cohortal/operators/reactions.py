"""Reactive pairs of atoms, bond differences, mapped reactions, screening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.scalars import finite, pair_gap
from cohortal.operators.graph import count_of
from cohortal.operators.ordering import running

#: The most bonds of an element that a proposed bond may bring it to.
MAX_VALENCE = {"H": 1, "B": 4, "C": 4, "N": 4, "O": 3, "F": 1, "Si": 4, "P": 5, "S": 6, "Cl": 1, "Br": 1, "I": 1}
#: Weights of the terms of a pair's score.
PAIR_WEIGHTS = {"fmo": 1.0, "hsab": 0.25, "charge": 0.05, "accessibility": 0.1}


def bond_changes(left: DataFrame, right: DataFrame, keys: list[str], keep_unchanged: bool = False) -> DataFrame:
    """(*keys, left_order, right_order, kind): bonds formed, broken, of another order (or unchanged)."""
    l, r = left.select(*keys, F.col("bond_order").alias("left_order")), right.select(*keys, F.col("bond_order").alias("right_order"))  # noqa: E741
    kind = F.when(F.col("left_order").isNull(), "formed").when(F.col("right_order").isNull(), "broken").when(F.col("left_order") != F.col("right_order"), "order_changed").otherwise("unchanged")
    out = l.join(r, keys, "full_outer").withColumn("kind", kind)
    return out if keep_unchanged else out.where("kind <> 'unchanged'")


def edit_terms(changes: DataFrame, *by: str) -> DataFrame:
    """Sums of the absolute change of order by kind."""
    size = F.abs(F.coalesce("right_order", F.lit(0.0)) - F.coalesce("left_order", F.lit(0.0)))
    return changes.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.sum(size).alias("change"))


def check_mapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(reaction, status, code) of two tables (reaction, map, element, charge): complete, unique, equal, balanced."""
    side = lambda df, name: df.groupBy("reaction").agg(F.count("*").alias(f"{name}_n"), F.countDistinct("map").alias(f"{name}_k"), F.bool_or(F.col("map").isNull()).alias(f"{name}_gap"), F.sum("charge").alias(f"{name}_q"))
    l, r = side(left, "l"), side(right, "r")  # noqa: E741
    match = left.where("map is not null").select("reaction", "map", F.col("element").alias("le")).join(right.where("map is not null").select("reaction", "map", F.col("element").alias("re")), ["reaction", "map"], "full_outer")
    bad = match.groupBy("reaction").agg(F.bool_or(~F.coalesce(F.col("le") == F.col("re"), F.lit(False))).alias("unlike"))
    j = l.join(r, "reaction", "full_outer").join(bad, "reaction", "left")
    missing = F.coalesce(F.col("l_gap"), F.lit(True)) | F.coalesce(F.col("r_gap"), F.lit(True)) | (F.col("l_n") != F.col("l_k")) | (F.col("r_n") != F.col("r_k"))
    unlike = F.coalesce("unlike", F.lit(True)) | (F.col("l_n") != F.col("r_n")) | (F.col("l_q") != F.col("r_q"))
    code = F.when(missing, "REACTION_MAPPING_MISSING").when(unlike, "REACTION_NOT_BALANCED")
    return j.select("reaction", F.when(code.isNull(), "success").otherwise("unsupported").alias("status"), code.alias("code"))


def reaction_delta(sides: DataFrame, values: DataFrame) -> DataFrame:
    """(reaction, status, delta) of sides(reaction, side, component): products less reactants; an unknown value gives null."""
    j = sides.join(values, "component", "left")
    sign = F.when(F.col("side") == "product", 1.0).otherwise(-1.0)
    return j.groupBy("reaction").agg(F.bool_or(F.col("value").isNull()).alias("gap"), F.sum(sign * F.col("value")).alias("d")).select("reaction", F.when(F.col("gap"), "missing_value").otherwise("success").alias("status"), F.when(~F.col("gap"), F.col("d")).alias("delta"))


def candidate_pairs(atoms: DataFrame) -> DataFrame:
    """(mol_id, a, b): atoms of different components of one molecule, by the order of the components. atoms(mol_id, atom_id, comp)"""
    right = atoms.select("mol_id", F.col("atom_id").alias("b"), F.col("comp").alias("comp_b"))
    return atoms.select("mol_id", F.col("atom_id").alias("a"), F.col("comp").alias("comp_a")).join(right, "mol_id").where("comp_a < comp_b")


def valence_allowed(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, atom_id, allowed): whether one more single bond fits the element's most; never at an open-shell atom or an unknown element."""
    both = bonds.select("mol_id", F.col("a").alias("atom_id"), "bond_order").union(bonds.select("mol_id", "b", "bond_order"))
    used = both.groupBy("mol_id", "atom_id").agg(F.sum("bond_order").alias("used"))
    most = F.coalesce(*(F.when(F.col("element") == k, F.lit(v)) for k, v in MAX_VALENCE.items()))
    fits = (count_of(atoms, "radical_electrons") == 0) & (F.coalesce("used", F.lit(0.0)) + F.col("total_hcount") + 1 <= most)
    return atoms.join(used.hint("merge"), ["mol_id", "atom_id"], "left").select("mol_id", "atom_id", F.coalesce(fits, F.lit(False)).alias("allowed"))


def merge_frontiers(systems: DataFrame) -> DataFrame:
    """(mol_id, comp, homo, lumo, atom_id, homo_density, lumo_density): densities come only from systems that attain the ends."""
    part = Window.partitionBy("mol_id", "comp")
    j = systems.withColumn("top", F.max("homo").over(part)).withColumn("low", F.min("lumo").over(part))
    return j.groupBy("mol_id", "comp", "atom_id").agg(F.max("top").alias("homo"), F.min("low").alias("lumo"), F.sum(F.when(F.col("homo") == F.col("top"), F.col("homo_density")).otherwise(0.0)).alias("homo_density"), F.sum(F.when(F.col("lumo") == F.col("low"), F.col("lumo_density")).otherwise(0.0)).alias("lumo_density"))


def hsab(homo: Column, lumo: Column, floor: float = 0.05) -> dict[str, Column]:
    """Electronegativity, hardness and softness of a component; the softness is that of a hardness of `floor` at least."""
    hardness = (lumo - homo) / 2
    return {"electronegativity": -(homo + lumo) / 2, "hardness": hardness, "softness": 1 / F.greatest(hardness, F.lit(floor))}


def accessibility(pi: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, atom_id, accessibility): one over one more than the neighbours outside the pi systems."""
    both = bonds.select("mol_id", F.col("a").alias("atom_id"), F.col("b").alias("other")).union(bonds.select("mol_id", "b", "a"))
    outside = both.join(pi.where("included").select("mol_id", F.col("atom_id").alias("other")).hint("merge"), ["mol_id", "other"], "left_anti")
    many = outside.groupBy("mol_id", "atom_id").agg(F.count("*").alias("n"))
    return pi.select("mol_id", "atom_id").join(many.hint("merge"), ["mol_id", "atom_id"], "left").select("mol_id", "atom_id", (1.0 / (1 + F.coalesce("n", F.lit(0)))).alias("accessibility"))


def score_pairs(pairs: DataFrame, floor: float = 0.05, weights: dict[str, float] = PAIR_WEIGHTS) -> DataFrame:
    """pairs(..., homo_a, lumo_a, hd_a, ld_a, q_a, acc_a and the same of b) with the terms of the score, and the score.

    fmo_a_to_b and fmo_b_to_a: density products over the directional gaps, both of which count; hsab: local softness
    products of both directions; charge: minus the product of the partial charges, a missing one being the formal charge (charge_a,
    charge_b); accessibility: the sum of both ends'. direction
    names the stronger of the two, or mixed; codes are those of either direction.
    """
    _, forward, code_ab = pair_gap(F.col("homo_a"), F.col("lumo_b"), F.col("hd_a") * F.col("ld_b"), floor)
    _, backward, code_ba = pair_gap(F.col("homo_b"), F.col("lumo_a"), F.col("hd_b") * F.col("ld_a"), floor)
    soft = [F.coalesce(hsab(F.col(f"homo_{c}"), F.col(f"lumo_{c}"), floor)["softness"], F.lit(0.0)) for c in "ab"]
    charge = {c: F.coalesce(F.col(f"q_{c}"), F.col(f"charge_{c}").cast("double") if f"charge_{c}" in pairs.columns else F.lit(None).cast("double")) for c in "ab"}
    terms = {
        "fmo_a_to_b": forward,
        "fmo_b_to_a": backward,
        "hsab": soft[0] * soft[1] * (F.col("hd_a") * F.col("ld_b") + F.col("hd_b") * F.col("ld_a")),
        "charge": -charge["a"] * charge["b"],
        "accessibility": F.col("acc_a") + F.col("acc_b"),
    }
    scored = pairs.select("*", *(c.alias(n) for n, c in terms.items()), F.array_compact(F.array(code_ab, code_ba)).alias("codes"))
    score = weights["fmo"] * (F.col("fmo_a_to_b") + F.col("fmo_b_to_a")) + sum((weights[n] * F.col(n) for n in ("hsab", "charge", "accessibility")), F.lit(0.0))
    direction = F.when(F.col("fmo_a_to_b") > F.col("fmo_b_to_a"), "A_to_B").when(F.col("fmo_b_to_a") > F.col("fmo_a_to_b"), "B_to_A").otherwise("mixed")
    return scored.withColumn("score", score).withColumn("direction", direction)


def rank_pairs(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("mol_id").orderBy(F.col("score").desc(), "a", "b")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_equivalent_pairs(scored: DataFrame) -> DataFrame:
    """(mol_id, a, b, score, n, pairs): pairs whose ends are alike as one, with the first pair, its score, and the list.

    Alike are ends of equal element, formal charge, densities (to ten digits) and accessibility; scored has them as
    element_, charge_, hd_, ld_ and acc_ of a and b.
    """
    alike = [F.round(f"{c}_{x}", 10) if c in ("hd", "ld") else F.col(f"{c}_{x}") for x in "ab" for c in ("element", "charge", "hd", "ld", "acc")]
    keys = [c.alias(f"_k{k}") for k, c in enumerate(alike)]
    listed = F.array_sort(F.collect_list(F.struct("a", "b")))  # the pairs of one molecule
    found = scored.groupBy("mol_id", *keys).agg(F.min(F.struct("a", "b", "score")).alias("p"), F.count("*").alias("n"), listed.alias("pairs"))
    return found.select("mol_id", "p.a", "p.b", "p.score", "n", "pairs")


def formed_pairs(scored: DataFrame, changes: DataFrame) -> DataFrame:
    """Per molecule with formed bonds: sums of the terms over the scored pairs that become bonds, and whether one has no row.

    changes(mol_id, a, b, kind); a pair is the same in either order.
    """
    order = lambda df: df.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    formed = order(changes.where("kind = 'formed'")).select("mol_id", "lo", "hi").distinct()
    terms = order(scored).select("mol_id", "lo", "hi", (F.col("fmo_a_to_b") + F.col("fmo_b_to_a")).alias("fmo"), "hsab", "charge")
    j = formed.join(terms.hint("merge"), ["mol_id", "lo", "hi"], "left")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("fmo", "hsab", "charge")]
    warning = F.when(F.bool_or(F.col("fmo").isNull()), "FORMED_BOND_NOT_PAIR_SCORABLE")
    return j.groupBy("mol_id").agg(F.count("*").alias("formed"), *sums, warning.alias("warning"))


def score_its(delta: DataFrame, terms: DataFrame, weights: dict[str, float], status: DataFrame, formed: DataFrame | None = None) -> DataFrame:
    """(reaction, status, score): the state's delta plus weighted edit terms, less the stabilization of formed(reaction,
    stabilization) bonds; null where the mapping is unsupported."""
    w = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in weights.items()), F.lit(0.0))
    penalty = terms.groupBy("reaction").agg(F.sum(F.col("change") * w).alias("penalty"))
    j = status.join(delta.select("reaction", "delta").hint("merge"), "reaction", "left").join(penalty.hint("merge"), "reaction", "left")
    j = j.join(formed.select("reaction", "stabilization").hint("merge"), "reaction", "left") if formed is not None else j.withColumn("stabilization", F.lit(0.0))
    good = F.col("status") == "success"
    return j.select("reaction", "status", F.when(good, F.col("delta") + F.coalesce("penalty", F.lit(0.0)) - F.coalesce("stabilization", F.lit(0.0))).alias("score"))


#: The families of scorers by name: functions from reactions(reaction, delta, edits) and constants to a column `score`.
SCORERS: dict[str, Callable[[DataFrame, dict[str, float]], DataFrame]] = {
    "GRAPH": lambda df, _: df.withColumn("score", F.col("delta")),
    "ITS": lambda df, constants: df.withColumn("score", F.col("delta") + F.lit(constants.get("edit", 0.0)) * F.col("edits")),
}


def score_with(name: str, reactions: DataFrame, constants: dict[str, float] | None = None) -> DataFrame:
    """reactions with the score of the scorer of that name; a null delta gives a null score."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; known are {', '.join(sorted(SCORERS))}")
    return SCORERS[name](reactions, constants or {})


def lowest_per_item(candidates: DataFrame) -> DataFrame:
    """(item, candidate, energy): the candidate of least energy, ties to the smaller one; null and non-finite energies have
    failed, and an item with no other is an error."""
    good = F.when(finite(F.col("energy")), F.struct("energy", "candidate"))
    per = candidates.groupBy("item").agg(F.min(good).alias("p"))
    none = F.raise_error(F.concat(F.lit("no candidate with an energy for item "), F.col("item").cast("string")))
    return per.select("item", F.coalesce(F.col("p.candidate"), none.cast(candidates.schema["candidate"].dataType)).alias("candidate"), "p.energy")


def sort_reactions(df: DataFrame, keep_order: bool = False) -> DataFrame:
    """By score, failures last, ties in the input's order; or as given."""
    return df.orderBy("ix") if keep_order else df.orderBy(F.col("score").asc_nulls_last(), "ix")


def placed(df: DataFrame) -> DataFrame:
    """df with its place from 1 in the order of sort_reactions(); ix tells rows apart."""
    rows = df.withColumn("_failed", F.col("score").isNull().cast("int")).withColumn("_one", F.lit(1))
    out = running(rows, [], ["_failed", "score", "ix"], {"_before": "_one"})
    return out.withColumn("place", F.col("_before") + 1).drop("_failed", "_one", "_before")


def screen(df: DataFrame, k: int, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df(item, score) with `final` and `status`: the k lowest scores go to `evaluate` once each, the others pass.

    evaluate takes (item) rows, all different, and returns (item, value).
    """
    chosen = df.where("score is not null").orderBy("score", "item").limit(k).select("item").distinct()
    values = evaluate(chosen).withColumn("_seen", F.lit(True))
    j = df.join(values.hint("merge"), "item", "left")
    status = F.when(F.col("score").isNull(), "failed").when(F.col("_seen") & F.col("value").isNull(), "evaluation_failed").when(F.col("_seen"), "evaluated").otherwise("screened")
    return j.select(*df.columns, F.coalesce("value", "score").alias("final"), status.alias("status"))
