"""Operator 5, mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt into blocks by a hash. A source's target is some whole passes over it and a
part of one more: the part is a number of blocks in a permuted order and a cut in the block after them. So a source
has an exact quota of blocks: all of them for each whole pass, and those of the part. A binary tree over the
output shards splits the quotas, at each node by one multivariate-hypergeometric draw, so that every shard's share is
what drawing blocks blindly would give and the shares add up to the quotas. Shards then take disjoint runs of the
blocks of all passes, each pass permuted on its own, and rows are shuffled inside their shard. The tree is
over sources and shards, never over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.scratch import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 5
SHARDS = 8
BLOCK_WORDS = 20_000
MOST_BLOCKS = 65_536  # blocks of all sources together are about this many at most; beyond it they grow
MOST_SOURCES = 20_000  # whose totals and quotas the driver holds; more is an error
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> dict:
    """The words that each source gives: by weight, none above `most` times its size.

    Sources, by code point and null last, weigh `weights`, repeating. What a source can't give goes to the
    others by weight, again and again, until none is above its most. Sources of size 0 give 0.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in order if s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) block quotas: recursive halving of the shards, a hypergeometric draw at each node."""
    draw = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def part(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        left = draw.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        part(left, lo, mid)
        part(have - left, mid, hi)

    if quotas:
        part(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def _decided(docs: DataFrame, keep: list[str], scratch: Scratch, shards: int, seed: int) -> DataFrame:
    """One row per row of docs(doc_id, text, source): row (a struct of the columns `keep`), key, size, source_size,
    target, passes, part, and shards, the shard of each whole copy and of the part.

    The decision about a row hangs on its block, except in the block that a source's quota cuts.
    """
    spark = scratch.spark
    # the order within a source: a hash of the row, so that it does not depend on partitions
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.xxhash64("text"))
    held = docs.select(F.struct(*keep).alias("row"), F.col("source").alias("of"), size_of(F.col("text")).alias("size"), key.alias("key"))
    rows = scratch.table(held.select("of", "size", "key"), "rows")
    totals = {r["of"]: int(r["w"]) for r in rows.groupBy("of").agg(F.sum("size").alias("w")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    want = targets(totals)
    per_block = max(BLOCK_WORDS, -(-sum(totals.values()) // MOST_BLOCKS))
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    listed = []
    for k, s in enumerate(order):
        whole = round(want[s])
        passes = whole // totals[s] if totals[s] else 0
        listed.append((s, k, totals[s], want[s], passes, whole - passes * totals[s], max(1, -(-totals[s] // per_block))))
    sources = F.broadcast(spark.createDataFrame(listed, "source string, k int, source_size long, target double, passes int, rest long, blocks long"))

    def dealt(df: DataFrame) -> DataFrame:
        found = df.join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("of", "source")
        return found.withColumn("block", F.pmod(F.shiftright("key", 13), F.col("blocks"))).drop("blocks")

    # blocks in the permuted order of the part, as a running sum of words; their number is bounded, see MOST_BLOCKS
    sums = dealt(rows).groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    by_block = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), "k", "block"), "block")
    before = F.coalesce(F.sum("words").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = scratch.table(sums.select("k", "block", "words", "passes", (F.col("rest") - before).alias("left")), "blocks")
    return _placed(held, dealt, blocks, scratch, len(order), shards, seed)


def _placed(held: DataFrame, dealt, blocks: DataFrame, scratch: Scratch, sources: int, shards: int, seed: int) -> DataFrame:
    spark = scratch.spark
    passes = F.col("passes") + (F.col("left") > 0).cast("int")
    each = blocks.where(passes > 0).select("k", "block", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    in_order = Window.partitionBy("k").orderBy("pass", F.xxhash64(F.lit(seed), "k", "pass", "block"), "block")
    units = scratch.table(each.withColumn("unit", F.row_number().over(in_order) - 1), "units")
    quotas = {r["k"]: r["n"] for r in units.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a row a source
    share = split_quotas([quotas.get(k, 0) for k in range(sources)], shards, seed)
    last = share.cumsum(axis=0)
    runs = [(k, j, int(last[j, k] - share[j, k]), int(last[j, k])) for k in range(sources) for j in range(shards) if share[j, k]]
    runs = F.broadcast(spark.createDataFrame(runs, "q int, shard int, first long, last long"))
    inside = (F.col("k") == F.col("q")) & (F.col("unit") >= F.col("first")) & (F.col("unit") < F.col("last"))
    of_block = units.join(runs, inside).groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("s"))  # as many as passes
    of_block = of_block.select("k", "block", F.transform("s", lambda x: x["shard"]).alias("shards"))
    marks = blocks.select("k", "block", "words", "left").join(of_block.hint("merge"), ["k", "block"], "left")
    marks = scratch.table(marks.select("k", "block", "words", "left", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "marks")
    found = dealt(held).join(F.broadcast(marks), ["k", "block"])
    cut = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    others = found.where(~cut).withColumn("part", F.when(F.col("left") >= F.col("words"), F.col("size")).otherwise(F.lit(0)))
    # the block at the end of a source's quota: a running sum over different keys; equal rows are numbered
    in_cut = scratch.numbered(found.where(cut), ["k", "key"], "cut", "copy")
    sums = in_cut.groupBy("k", "key", "size").agg(F.count("*").alias("many"))
    earlier = F.sum(F.col("many") * F.col("size")).over(Window.partitionBy("k").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("k", "key", "size", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    left = F.col("left") - F.col("earlier") - F.col("copy") * F.col("size")
    in_cut = in_cut.join(sums.hint("merge"), ["k", "key", "size"]).withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    columns = ["row", "key", "size", "source_size", "target", "passes", F.col("part").cast("long").alias("part"), F.slice("shards", 1, F.col("passes") + (F.col("part") > 0).cast("int")).alias("shards")]
    return in_cut.select(*columns).unionByName(others.select(*columns))


def plan(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text, source): what the mix takes of it.

    doc_id, source, size, source_size, target, taken (words, repeats counted), passes (whole copies), part
    (words of a further, cut copy), shards (of each copy, the part last). Null text has size 0; a null
    source is a source, the last; rows of a null doc_id are hashed like any; repeated rows are mixed as
    rows of their own; an empty table gives an empty one; texts of any length count whole. Other columns are not
    read. Each source's taken words are its target, rounded to a word, and no row gives more than twice its size.
    """
    found = _decided(docs, ["doc_id", "source"], scratch, shards, seed)
    taken = F.col("passes") * F.col("size") + F.col("part")
    return found.select("row.doc_id", "row.source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "part", "shards")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; a cut copy has its first words only,
    joined by one space.

    The columns of docs, whatever their names; n_chars, if it is one, follows the text. Rows that give nothing go; rows
    alike are rows of their own. Rows are dealt to `shards` shards by the splitting tree and lie in a shuffled
    order there. Nulls, long texts and an empty table are as in plan().
    """
    found = _decided(docs, docs.columns, Scratch(docs.sparkSession, "mix"), shards, seed)
    copies = F.concat(F.array_repeat(F.col("size"), F.col("passes")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    found = found.where((F.col("passes") > 0) | (F.col("part") > 0)).where("size > 0").select("row", "key", "size", "shards", F.posexplode(copies).alias("copy", "take"))
    words = F.filter(F.split("row.text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " ")
    text = F.when(F.col("take") < F.col("size"), first).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    found = found.select(row.alias("row"), "key", "copy", F.get("shards", F.col("copy")).alias("shard"), F.pmod(F.xxhash64("key", "copy"), F.lit(16)).alias("spread"))
    dealt = found.hint("rebalance", "shard", "spread")  # a partition of very many rows is split, and small ones are joined
    return dealt.sortWithinPartitions("shard", F.xxhash64("key", "copy")).select("row.*")


def mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan(docs, Scratch(spark, "mix")).drop("source")
