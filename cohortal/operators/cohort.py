"""Label-blind cohorts: stable splits, hash samples, greedy diverse samples, similarity, leakage checks."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortal.functions.hashing import hash_bucket, hash_fraction, keyed_hash, stable_hash
from cohortal.operators.loops import checkpointed, settle, with_small
from cohortal.operators.nearest import block_pairs, nearest_similarity  # noqa: F401  stands beside the other similarities
from cohortal.operators.ordering import quantiles, running

PAIR_BLOCK = 512  # items of a block whose pairs are made together
WORD_BLOCK = 2048  # items of a block, where sets are words
WORDS = 16  # words of 64 bits, at most, that a set is kept as
MEETINGS = 4096  # tasks, at most, in which blocks meet
RUN = 65_536  # components of one size and split that are listed in one row


def split_of(key: Column, namespace: str = "split", external: float = 0.2, validation: float = 0.1) -> Column:
    """external, validation or training by the hash fraction of a group's key."""
    x = hash_fraction(stable_hash(namespace, key))
    return F.when(x < external, "external").when(x < external + validation, "validation").otherwise("training")


def fold_of(key: Column, folds: int = 5, outer: int | None = None) -> Column:
    return hash_bucket("outer-fold" if outer is None else f"inner-fold-{outer}", key, folds)


def sample_group(df: DataFrame, namespace: str, k: int = 10) -> DataFrame:
    """At most k rows of each group, in the order of a hash of group and item."""
    order = Window.partitionBy("grp").orderBy(keyed_hash(namespace, F.col("grp"), F.col("item")), "item")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def limit_groups(df: DataFrame, namespace: str, n: int) -> DataFrame:
    """The rows of the first n groups in the order of a hash."""
    first = df.select("grp").distinct().orderBy(stable_hash(namespace, F.col("grp")), "grp").limit(n)
    return df.join(first, "grp", "left_semi")


def bit_counts(bits: DataFrame) -> DataFrame:
    return bits.groupBy("item").agg(F.count("*").alias("n"))


def tanimoto_pairs(bits: DataFrame, block: int | None = None, digits: int | None = None, most: int = WORDS) -> DataFrame:
    """(grp, item_a, item_b, similarity) of pairs of a group with a bit in common, item_a < item_b; rounded half up where digits are given.

    The items of a group are dealt into blocks of about `block` by hash, and any two blocks meet in a task, so that what is shuffled is
    each set once a block of its group, and no row is a pair until it is given out. Where all bits lie within `most` words of
    64, sets are words, whose common bits columns count; else blocks meet as matrix products. bits(item, grp, bit), each row once.
    """
    known = bits.where("grp is not null and bit is not null").select("grp", "item", F.col("bit").cast("long").alias("bit"))
    lo, hi = known.agg(F.min("bit"), F.max("bit")).first()
    many = 1 if lo is None else (hi - lo) // 64 + 1
    if many > most:
        return _pairs_of_packs(known, bit_counts(bits), {f.name: f.dataType for f in bits.schema.fields}, block or PAIR_BLOCK, digits)
    place = F.col("bit") - F.lit(lo or 0)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    names = [f"w{k}" for k in range(many)]
    sets = known.groupBy("grp", "item").agg(*(F.coalesce(F.bit_or(F.when(F.floor(place / 64) == k, one)), F.lit(0).cast("long")).alias(w) for k, w in enumerate(names)))
    dealt, tasks = _dealt(sets.join(bit_counts(bits).hint("merge"), "item"), block or WORD_BLOCK)
    own = ["item", "n", *names]
    # a join of items, not of packs: what codegen gives out for one row at a time is a block, not a block's square
    pairs = _met(dealt, own, tasks)
    common = reduce(lambda x, y: x + y, (F.bit_count(F.col(w).bitwiseAND(F.col(f"_{w}"))) for w in names))
    pairs = pairs.where((common > 0) & (~F.col("own") | (F.col("item") < F.col("_item")))).withColumn("k", common)
    similarity = _share(F.col("k"), F.col("n") + F.col("_n") - F.col("k"), digits)
    return pairs.select("grp", F.least("item", "_item").alias("item_a"), F.greatest("item", "_item").alias("item_b"), similarity.alias("similarity"))


def _share(part: Column, whole: Column, digits: int | None) -> Column:
    """part / whole of whole numbers; they are small enough for the rounding to be that of the fraction itself."""
    return part / whole if digits is None else F.floor(part * F.lit(10.0**digits) / whole + 0.5) / F.lit(10.0**digits)


def _pairs_of_packs(known: DataFrame, counts: DataFrame, kinds: dict, block: int, digits: int | None) -> DataFrame:
    """tanimoto_pairs() by matrix products of blocks, each of which is a row of arrays."""
    sets = known.groupBy("grp", "item").agg(F.collect_list("bit").alias("bits"))  # at most as many as there are bits
    dealt, tasks = _dealt(sets.join(counts.hint("merge"), "item"), block)
    packs = checkpointed(dealt.groupBy("grp", "_own", "_blocks").agg(F.collect_list(F.struct("item", "bits", "n")).alias("pack")))
    met = _met(packs, ["pack"], tasks)
    columns = [F.col(f"pack.{c}").alias("items" if c == "item" else f"item_{c}") for c in ("item", "bits", "n")] + [F.col(f"_pack.{c}").alias(c) for c in ("item", "bits", "n")]
    schema = StructType([StructField("grp", kinds["grp"]), StructField("item_a", kinds["item"]), StructField("item_b", kinds["item"]), StructField("similarity", DoubleType())])
    return met.select("grp", "own", *columns).mapInArrow(partial(block_pairs, digits=digits), schema)


def _dealt(sets: DataFrame, block: int) -> tuple[DataFrame, int]:
    """sets with their block _own of the _blocks of their group, and how many tasks the meetings of blocks are for."""
    sets = checkpointed(sets)
    size = checkpointed(sets.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")))
    meetings = size.agg(F.sum(F.col("_blocks").cast("long") * (F.col("_blocks") + 1) / 2)).first()[0] or 1
    return with_small(sets, size, "grp").withColumn("_own", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")), int(min(meetings, MEETINGS))


def _met(rows: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """(grp, own, *columns, and columns of the other row with _ before): rows of any two blocks of a group, and of each with itself (own).

    Two blocks are a key of their own, so that a large group is spread over all tasks.
    """
    at = ["grp", "_a", "_b"]
    left = rows.select("grp", F.col("_own").alias("_a"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_b"), *columns)
    right = rows.select("grp", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_a"), F.col("_own").alias("_b"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = left.repartition(tasks, *at).join(right.repartition(tasks, *at).hint("merge"), at)
    return both.select("grp", (F.col("_a") == F.col("_b")).alias("own"), *columns, *(f"_{c}" for c in columns))


def similarity_strata(nearest: DataFrame, groups: DataFrame, far: float = 0.5, near: float = 0.7) -> DataFrame:
    """(grp, median, stratum) of the nearest similarities of each group's items."""
    per = quantiles(nearest.join(groups.select("item", "grp").distinct().hint("merge"), "item"), "nearest", {"median": 0.5}, "grp")
    return per.withColumn("stratum", F.when(F.col("median") <= far, "far").when(F.col("median") <= near, "mid").otherwise("near"))


def diverse_sample(bits: DataFrame, k: int = 10, namespace: str = "diverse") -> DataFrame:
    """(grp, item, rank): greedy max-min picks; all groups advance together, one pick a round.

    The first pick has the least hash; each next one is farthest from those picked, ties by hash. Groups of at most k items
    pass whole, in the order of the hash.
    """
    hashed = keyed_hash(namespace, F.col("grp"), F.col("item"))
    sets = bits.groupBy("grp", "item").agg(F.collect_set("bit").alias("bits"))  # at most as many as there are bits
    group = Window.partitionBy("grp")
    sets = checkpointed(sets.withColumn("h", hashed).withColumn("size", F.count("*").over(group)).withColumn("place", F.row_number().over(group.orderBy("h", "item"))))
    small = sets.where(F.col("size") <= k).select("grp", "item", F.col("place").alias("rank"))
    rest = sets.where(F.col("size") > k).withColumn("far", F.lit(2.0)).drop("place")
    picked = None
    for rank in range(1, k + 1):
        best = rest.groupBy("grp").agg(F.max_by(F.struct("item", "bits"), F.struct("far", F.translate("h", "0123456789abcdef", "fedcba9876543210"), -F.col("item"))).alias("p")).select("grp", F.col("p.item").alias("p_item"), F.col("p.bits").alias("p_bits"))
        now = best.select("grp", F.col("p_item").alias("item"), F.lit(rank).alias("rank"))
        picked = now if picked is None else picked.unionByName(now)
        if rank == k:
            break
        both = F.size(F.array_intersect("bits", "p_bits"))
        distance = 1 - both / (F.size("bits") + F.size("p_bits") - both)
        rest = rest.join(best, "grp").where("item <> p_item").select("grp", "item", "bits", "h", "size", F.least("far", distance).alias("far"))
        rest = checkpointed(rest)
        picked = checkpointed(picked)
    return small.unionByName(picked)


def link_components(edges: DataFrame) -> DataFrame:
    """(grp, comp): groups joined when they share a link, transitively; comp is the least group."""
    ends = edges.where(F.col("link").isNotNull()).select("grp", "link").distinct()
    nodes = ends.select(F.concat(F.lit("g"), F.lpad(F.col("grp").cast("string"), 20, "0")).alias("node")).union(ends.select(F.concat(F.lit("l"), F.col("link").cast("string")))).distinct()
    g, x = F.concat(F.lit("g"), F.lpad(F.col("grp").cast("string"), 20, "0")), F.concat(F.lit("l"), F.col("link").cast("string"))
    steps = ends.select(g.alias("a"), x.alias("b")).union(ends.select(x, g))
    found = settle(nodes, steps, [])
    return found.where(F.col("node").startswith("g")).select(F.substr("node", F.lit(2)).cast("long").alias("grp"), F.substr("comp", F.lit(2)).cast("long").alias("comp"))


def assign_components(components: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(comp, size, split): components by size and hash, each to the split whose squared miss of its target grows least.

    That is the split which lies lowest against its target. So, among components of one size, the choices are the least of a
    few arithmetic series, one a split: the driver only counts, for each different size, how many each split gets;
    components and choices are then put in order and meet by their place.
    """
    spark = components.sparkSession
    sizes = checkpointed(components.groupBy("comp").agg(F.count("*").alias("size")))
    counts = sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.col("size").desc()).collect()  # a row a different size
    total, names = sum(r["size"] * r["n"] for r in counts), list(shares)
    lies = [-total * shares[n] for n in names]  # what a split has, less its target
    series = []
    for r in counts:
        for k, n in enumerate(_picks(lies, r["size"], r["n"])):
            if n:
                series.append((r["size"], k, lies[k], n))
            lies[k] += r["size"] * n
    # a long series is made in runs, so that no task makes all of it
    parts = [(size, k, start, first, min(n, first + RUN) - 1) for size, k, start, n in series for first in range(0, n, RUN)]
    runs = spark.createDataFrame(parts, "size long, k int, start double, first long, last long").repartition(max(1, min(len(parts), 1024)))
    value = F.col("start") + F.col("j") * F.col("size")
    choices = runs.select("size", "k", "start", F.explode(F.sequence("first", "last")).alias("j")).select((-F.col("size")).alias("o"), value.alias("v"), "k", F.lit(1).alias("_one"))
    choices = running(choices, [], ["o", "v", "k"], {"place": "_one"}).select("place", "k")
    ordered = sizes.select("comp", "size", (-F.col("size")).alias("o"), stable_hash("component", F.col("comp")).alias("h"), F.lit(1).alias("_one"))
    ordered = running(ordered, [], ["o", "h", "comp"], {"place": "_one"})
    name = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return ordered.join(choices.hint("merge"), "place").select("comp", "size", name.alias("split"))


def _picks(lies: list[float], size: int, n: int) -> list[int]:
    """How many of n components of one size each split gets, the lowest taking each in turn, the first of equals."""
    heap = [(v, k) for k, v in enumerate(lies)]
    out = [0] * len(lies)
    # all rise evenly once they lie within one size of each other; whole turns are taken at once
    while n > 0:
        heap.sort()
        low, k = heap[0]
        above = [v for v, _ in heap[1:]]
        if above and above[-1] - low < size and n >= len(heap):
            turns = n // len(heap)
            for i, (v, j) in enumerate(heap):
                out[j] += turns
                heap[i] = (v + turns * size, j)
            n -= turns * len(heap)
            continue
        step = max(1, min(n, int((above[0] - low) // size))) if above else n
        out[k] += step
        heap[0] = (low + step * size, k)
        n -= step
    return out


def leakage_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, left_split, right_split, shared): how many values of each key two splits have in common."""
    out = None
    for key in keys:
        per = df.select(F.col(key).cast("string").alias("value"), "split").where("value is not null and value <> ''").distinct()
        right = per.select("value", F.col("split").alias("right_split"))
        now = per.join(right, "value").where("split < right_split").groupBy(F.col("split").alias("left_split"), "right_split").agg(F.count("*").alias("shared")).select(F.lit(key).alias("key"), "left_split", "right_split", "shared")
        out = now if out is None else out.unionByName(now)
    return out


def split_summary(df: DataFrame, identity: str) -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("items"), F.countDistinct(identity).alias("identities"))


def stable_support(selected: DataFrame, folds: int) -> DataFrame:
    """(name): the terms that every fold selected."""
    return selected.groupBy("name").agg(F.countDistinct("fold").alias("n")).where(F.col("n") == folds).select("name")


def compare_support(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change): retained, dropped or new."""
    o, n = old.select("name").distinct().withColumn("o", F.lit(1)), new.select("name").distinct().withColumn("n", F.lit(1))
    return o.join(n, "name", "full_outer").select("name", F.when(F.col("n").isNull(), "dropped").when(F.col("o").isNull(), "new").otherwise("retained").alias("change"))


def select_cohorts(molecules: DataFrame, most_atoms: int = 9, groups: int = 60, k: int = 10) -> DataFrame:
    """The manifest: rankable groups under the ceiling, a hash budget of groups, splits, at most k items each."""
    from cohortal.operators.prep import group_ceiling, rankable_groups

    rows = limit_groups(group_ceiling(rankable_groups(molecules), "n_atoms", most_atoms), "budget", groups)
    size = Window.partitionBy("grp")
    rows = rows.withColumn("group_size_available", F.count("*").over(size)).withColumn("split", split_of(F.col("grp")))
    return sample_group(rows, "cohort", k).select("split", "grp", "item", F.col("place").alias("selection_rank"), "group_size_available")
