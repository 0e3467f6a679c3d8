"""Column expressions over strings, compositions, labels and bonds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The elements that items may hold.
SUPPORTED = ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Br", "I")
#: Feature names that begin with these have too many different values.
HIGH_CARDINALITY = ("path_1_3[", "path_1_4[", "benson_nn[", "inactive_empirical[")
#: The beginning of a feature's name and its family, the first that fits.
FAMILIES = (
    ("atom_state[", "atom_state"),
    ("bond_environment[", "bond_environment"),
    ("ring[", "ring_topology"),
    ("ring_", "ring_topology"),
    ("fukui_", "huckel_fukui"),
    ("huckel_", "huckel_fukui"),
    ("first_order_v1[", "first_order_v1"),
    ("inactive_empirical[", "inactive_empirical"),
    ("estate_", "electrotopological_state"),
    ("gasteiger_", "gasteiger_charge"),
    ("rdkit_", "named_chemical_graph_descriptor"),
)


def first_field(line: Column) -> Column:
    return F.element_at(F.split(F.trim(line), "\\s+"), 1)


def reaction_components(text: Column) -> Column:
    """array<struct<side, position, component>> of a three-part arrow string; empty for any other shape."""
    parts = F.split(first_field(text), ">")

    def of(side: str, part: Column) -> Column:
        names = F.filter(F.transform(F.split(part, "\\."), lambda c: F.trim(c)), lambda c: c != "")
        return F.transform(names, lambda c, i: F.struct(F.lit(side).alias("side"), i.alias("position"), c.alias("component")))

    sides = [of(side, F.get(parts, F.lit(k))) for k, side in enumerate(("reactant", "reagent", "product"))]
    empty = F.array().cast("array<struct<side:string,position:int,component:string>>")
    return F.when(F.size(parts) == 3, F.concat(*sides)).otherwise(empty)


def reaction_sides(text: Column) -> Column:
    """struct<left, right> of the dot-separated parts around '>>'; null if a side is missing or empty."""
    parts = F.split(F.trim(text), ">>")
    good = (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != "")
    return F.when(good, F.struct(F.split(F.trim(parts[0]), "\\.").alias("left"), F.split(F.trim(parts[1]), "\\.").alias("right")))


def formula_parts(formula: Column) -> Column:
    """array<struct<element, n>> of a formula text, in its order; a missing count is 1. Elements may repeat."""
    names = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), 1)
    counts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), 2)
    return F.zip_with(names, counts, lambda e, n: F.struct(e.alias("element"), F.when(n == "", 1).otherwise(F.expr("1") * F.try_to_number(n, F.lit("999999")).cast("int")).alias("n")))


def formula_leftover(formula: Column) -> Column:
    """What of a formula text is no element with a count; empty if it parses whole."""
    return F.regexp_replace(formula, "[A-Z][a-z]?\\d*", "")


def hill_order(element: Column, has_carbon: Column, hydrogen_first: bool = False) -> Column:
    """The sorting rank of an element: carbon, hydrogen, the others; without carbon all alike, or hydrogen first."""
    hydrogen = F.lit(1) if hydrogen_first else F.when(has_carbon, 1).otherwise(2)
    return F.when(has_carbon & (element == "C"), 0).when(element == "H", hydrogen).otherwise(2)


def hill_formula(counts: Column, hydrogen_first: bool = False) -> Column:
    """The Hill formula of array<struct<element, n>>; '-' if nothing has a positive count."""
    held = F.filter(counts, lambda c: c["n"] > 0)
    carbon = F.exists(held, lambda c: c["element"] == "C")
    ranked = F.array_sort(F.transform(held, lambda c: F.struct(hill_order(c["element"], carbon, hydrogen_first).alias("rank"), c["element"].alias("element"), c["n"].alias("n"))))
    text = F.array_join(F.transform(ranked, lambda c: F.concat(c["element"], F.when(c["n"] == 1, "").otherwise(c["n"].cast("string")))), "")
    return F.when(text == "", "-").otherwise(text)


def reasons(*rules: tuple[Column, str]) -> Column:
    """array<string> of the reasons whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in rules)))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first reason whose condition holds; else null."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for condition, name in rules))


def elements_supported(elements: Column, supported=SUPPORTED) -> Column:
    return F.size(F.array_except(elements, F.array(*map(F.lit, supported)))) == 0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_label(*aliases: Column) -> tuple[Column, Column]:
    """(value, reason): the first non-empty alias as a double; reason is missing or nonfinite where it is not one."""
    text = F.coalesce(*(F.when(F.trim(a.cast("string")) != "", F.trim(a.cast("string"))) for a in aliases))
    value = text.try_cast("double")
    reason = F.when(text.isNull() | value.isNull(), "missing_label").when(~finite(value), "nonfinite_label")
    return F.when(finite(value), value), reason


def clean_value(x: Column) -> Column:
    """Non-finite and missing values count as 0."""
    return F.when(finite(x), x).otherwise(0.0)


def feature_family(name: Column) -> Column:
    """A family by the beginning of a feature's name, then by what it holds; see FAMILIES."""
    by_start = [F.when(name.startswith(start), F.lit(family)) for start, family in FAMILIES]
    return F.coalesce(*by_start, F.when(name.contains("charge"), "formal_charge_topology").when(name.startswith("graph_"), "classical_graph_index").otherwise("other_named_term"))


def merged_family(name: Column, manifest: dict[str, str]) -> Column:
    """feature_family(), but for the names that a manifest gives a family."""
    own = [F.when(name == k, F.lit(v)) for k, v in sorted(manifest.items())]
    return F.coalesce(*own, feature_family(name))


def feature_block(name: Column, manifest: list[str]) -> Column:
    return F.when(name.isin(manifest), "fixed").when(name.startswith("first_order_v1["), "first_order").otherwise("named")


def is_compact(name: Column, dropped=HIGH_CARDINALITY) -> Column:
    out = F.lit(True)
    for prefix in dropped:
        out = out & ~name.startswith(prefix)
    return out


def renamed(name: Column, old: str, new: str) -> Column:
    """The name with a leading `old` replaced."""
    return F.when(name.startswith(old), F.concat(F.lit(new), F.substr(name, F.lit(len(old) + 1)))).otherwise(name)


def rename_record(text: Column, old: str, new: str) -> Column:
    """JSON text whose keys and string values, at any depth, begin with `new` where they began with `old`."""
    return F.replace(text, F.lit(f'"{old}'), F.lit(f'"{new}'))


def canonical_path(labels: Column) -> Column:
    """The lesser of the joined sequence and its reverse."""
    return F.least(F.array_join(labels, "|"), F.array_join(F.reverse(labels), "|"))


def bond_class(order: Column, aromatic: Column) -> Column:
    return F.when(aromatic, "aromatic").when(order >= 2.5, "triple").when(order >= 1.5, "double").otherwise("single")


def applicability(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def pair_gap(homo: Column, lumo: Column, density: Column, floor: float) -> tuple[Column, Column, Column]:
    """(gap, score, code) of a directional pair: density over the gap, which has a floor; 0 where there is none."""
    gap = lumo - homo
    code = F.when(gap.isNull(), "FRONTIER_UNAVAILABLE").when(gap <= 0, "INVALID_DIRECTIONAL_GAP").when(gap < floor, "FRONTIER_GAP_REGULARIZED")
    used = F.when(gap > 0, F.greatest(gap, F.lit(floor)))
    return used, F.coalesce(density / used, F.lit(0.0)), code
