"""Harvesting, deduplication, quarantine and audits of structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortal.functions.scalars import first_reason, reaction_components
from cohortal.operators.graph import count_of
from cohortal.operators.loops import with_small


def split_reactions(raw: DataFrame, text: str = "s", location: str = "location") -> DataFrame:
    """(component, side, position, location): the parts of three-part arrow strings."""
    parts = raw.select(F.explode(reaction_components(F.col(text))).alias("c"), F.col(location).alias("location"))
    return parts.select("c.component", "c.side", "c.position", "location")


def flatten_reactions(reactions: DataFrame) -> DataFrame:
    """(component, reaction_id, location) from nested records: input components, outcome products, and the arrow string.

    reactions(reaction_id, inputs map<name, array<string>>, outcomes array<array<string>>, identifier string)
    """
    inputs = reactions.select("reaction_id", F.explode("inputs").alias("name", "list")).select("reaction_id", "name", F.posexplode("list").alias("i", "component")).select("component", "reaction_id", F.concat_ws(":", F.lit("input"), "name", F.col("i").cast("string")).alias("location"))
    outcomes = reactions.select("reaction_id", F.posexplode("outcomes").alias("o", "list")).select("reaction_id", "o", F.posexplode("list").alias("p", "component")).select("component", "reaction_id", F.concat_ws(":", F.lit("outcome"), F.col("o").cast("string"), F.lit("product"), F.col("p").cast("string")).alias("location"))
    arrows = reactions.select("reaction_id", F.explode(reaction_components(F.col("identifier"))).alias("c")).select("c.component", "reaction_id", F.concat(F.lit("reaction_smiles_"), "c.side").alias("location"))
    return inputs.unionByName(outcomes).unionByName(arrows)


def harvest(df: DataFrame, text: str, order: str, *example: str) -> DataFrame:
    """Trimmed non-empty strings with their number of occurrences and the first example by `order`."""
    kept = df.withColumn("value", F.trim(text)).where("value <> ''")
    return kept.groupBy("value").agg(F.count("*").alias("occurrences"), F.min_by(F.struct(*example), F.struct(order, *example)).alias("example"))


def merge_counts(*shards: DataFrame) -> DataFrame:
    """Harvests of several shards as one: counts add up, the least example stays."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.groupBy("value").agg(F.sum("occurrences").alias("occurrences"), F.min("example").alias("example"))


def merge_audits(audits: DataFrame) -> DataFrame:
    """(counter, n): the sums of a map column `counters` over all rows."""
    return audits.select(F.explode("counters").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))


def connectivity_variants(df: DataFrame, key: str, eligible: str, reason: str = "ambiguous_identity") -> DataFrame:
    """The number of rows of each key, and a reason where an eligible row is not the only one."""
    many = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("variants", many).withColumn("variant_reason", F.when(F.col(eligible) & (F.col("variants") > 1), F.lit(reason)))


def group_inventory(df: DataFrame, keys: list[str], identity: str, eligible: Column, least: int = 3) -> DataFrame:
    """Per group: rows, distinct identities, eligible rows, and whether it can be ranked."""
    return df.groupBy(*keys).agg(F.count("*").alias("members"), F.countDistinct(identity).alias("identities"), F.sum(F.when(eligible, 1).otherwise(0)).alias("eligible")).withColumn("rankable", F.col("eligible") >= least)


def size_distribution(df: DataFrame, *keys: str) -> DataFrame:
    """(size, groups): how many groups have each size."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def totals(df: DataFrame, keys: list[str], identity: str, eligible: Column, least: int = 3) -> DataFrame:
    """One row: rows, distinct identities, eligible rows, groups of `least` rows and the rows in them."""
    per = group_inventory(df, keys, identity, eligible, least)
    big = F.col("members") >= least
    return per.agg(F.sum("members").alias("rows"), F.sum("eligible").alias("eligible"), F.count("*").alias("groups"), F.sum(F.when(big, 1).otherwise(0)).alias("large_groups"), F.sum(F.when(big, F.col("members")).otherwise(0)).alias("rows_in_large")).crossJoin(F.broadcast(df.agg(F.countDistinct(identity).alias("identities"))))


def clean_labels(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """df with `reason`: the first rule that a row fails, null for rows that stay."""
    return df.withColumn("reason", first_reason(*rules))


def split_failures(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """(reason, n) of a ';'-joined list column, and the number of rows that have any as `total_excluded`."""
    each = df.select(F.explode(F.filter(F.split(reasons, ";"), lambda r: r != "")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    any_ = df.where(F.coalesce(F.col(reasons), F.lit("")) != "").agg(F.count("*").alias("n")).select(F.lit("total_excluded").alias("reason"), "n")
    return each.unionByName(any_)


def drop_ambiguous(df: DataFrame, *keys: str) -> DataFrame:
    """Only rows whose key no other row has: every row of a repeated key goes."""
    many = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return many.where("_n = 1").drop("_n")


def rankable_groups(df: DataFrame, least: int = 3, labels: int = 2) -> DataFrame:
    """The rows of groups (grp) of enough rows and enough different labels."""
    # two labels differ if the least is not the greatest, so that no label is shuffled
    enough = F.min("label") < F.max("label") if labels == 2 else F.countDistinct("label") >= labels
    good = df.groupBy("grp").agg(F.count("*").alias("n"), enough.alias("k")).where((F.col("n") >= least) & F.col("k"))
    return with_small(df, good.select("grp"), "grp", "left_semi")


def group_ceiling(df: DataFrame, column: str, most: float) -> DataFrame:
    """The rows of groups in which no row is above the ceiling."""
    over = df.groupBy("grp").agg(F.max(column).alias("top")).where(F.col("top") > most).select("grp")
    return df.join(over, "grp", "left_anti")


def drop_unseen(evaluation: DataFrame, training: DataFrame, elements: str = "elements") -> DataFrame:
    """Evaluation rows of groups that hold no element which training lacks."""
    known = training.select(F.explode(elements).alias("e")).distinct()
    strange = evaluation.select("grp", F.explode(elements).alias("e"))
    strange = with_small(strange, known, "e", "left_anti").select("grp").distinct()
    return evaluation.join(strange.hint("merge"), "grp", "left_anti")


def apply_firewall(evaluation: DataFrame, training: DataFrame, identity: str, by_group_first: bool = False) -> DataFrame:
    """Evaluation rows that share nothing with training.

    by_group_first: rows of a known group or identity go at once. Else rows of a known identity go, groups are
    tested for rankability again, and then known groups go.
    """
    ids, groups = training.select(identity).distinct(), training.select("grp").distinct()
    if by_group_first:
        return evaluation.join(groups, "grp", "left_anti").join(ids, identity, "left_anti")
    return rankable_groups(evaluation.join(ids, identity, "left_anti")).join(groups, "grp", "left_anti")


def scaffold_unseen(evaluation: DataFrame, training: DataFrame, scaffold: str) -> DataFrame:
    """Per row whether its non-empty scaffold is new, and whether its group has scaffolds and none that is known."""
    known = training.where(F.col(scaffold) != "").select(F.col(scaffold).alias("_s")).distinct()
    j = evaluation.join(known, evaluation[scaffold] == known["_s"], "left").withColumn("unseen", (F.col(scaffold) != "") & F.col("_s").isNull())
    group = Window.partitionBy("grp")
    return j.withColumn("group_unseen", F.bool_or(F.col(scaffold) != "").over(group) & ~F.bool_or(F.col("_s").isNotNull()).over(group)).drop("_s")


def pending_rows(manifest: DataFrame, finished: DataFrame, keys: list[str], retry: bool = False) -> DataFrame:
    """Manifest rows without a result, or, to retry, without a successful one."""
    done = finished.where("status = 'success'") if retry else finished
    return manifest.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; partial maxima meet in the shuffle, so that a key of very many rows is no burden."""
    rest = F.xxhash64(*sorted(c for c in table.columns if c not in keys))  # a tie goes by the rest of the row
    row = F.struct(*(c for c in table.columns if c not in keys))
    return table.groupBy(*keys).agg(F.max_by(row, F.struct(order, rest)).alias("_row")).select(*(c if c in keys else F.col("_row")[c].alias(c) for c in table.columns))


def validate_domain(atoms: DataFrame, components: DataFrame, supported: tuple[str, ...], strict: bool = False, molecules: DataFrame | None = None, charges: tuple[int, ...] = (0,)) -> DataFrame:
    """(mol_id, reason): the first of empty, disconnected, isotope, unsupported_element, charged and radical; null where a
    molecule passes. molecules(mol_id) tells of those without atoms; strict raises at the first reason."""
    per = atoms.groupBy("mol_id").agg(
        F.bool_or(count_of(atoms, "isotope") != 0).alias("isotope"),
        F.bool_or(~F.coalesce(F.col("element").isin(*supported), F.lit(False))).alias("strange"),
        F.sum("formal_charge").alias("charge"),
        F.sum(count_of(atoms, "radical_electrons")).alias("radicals"),
    )
    parts = components.groupBy("mol_id").agg(F.countDistinct("comp").alias("parts"))
    known = per.join(parts.hint("merge"), "mol_id", "left").withColumn("held", F.lit(True))
    every = known if molecules is None else molecules.select("mol_id").distinct().join(known.hint("merge"), "mol_id", "left")
    rules = [
        (F.col("held").isNull(), "empty"),
        (F.col("parts") > 1, "disconnected"),
        (F.col("isotope"), "isotope"),
        (F.col("strange"), "unsupported_element"),
        (~F.col("charge").isin(*charges), "charged"),
        (F.col("radicals") != 0, "radical"),
    ]
    out = every.select("mol_id", first_reason(*rules).alias("reason"))
    if strict:
        out = out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("not in the domain:"), F.col("mol_id").cast("string"), "reason")).cast("string")))
    return out
