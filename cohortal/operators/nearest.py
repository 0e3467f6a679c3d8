"""The nearest reference of each bit set, meeting only those blocks of references that can still hold a nearer one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.operators.loops import checkpointed, with_small
from cohortal.operators.ordering import quantiles, running

BLOCK = 1024  # items of a block
PIVOTS = 256  # references, at most, around which blocks are made
PAGE = 512  # blocks, about, whose bounds are looked at together
WIDE = 4096  # bits that one matrix product takes


def nearest_similarity(queries: DataFrame, references: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item, nearest): the highest Tanimoto similarity of each query's bits to any reference; 0 without a common bit.

    Bits are whole numbers; repeated rows count once, an item without bits is no row here, and an item is no neighbour of itself.
    """
    return search(queries, references, block)[0]


def search(queries: DataFrame, references: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None, int]:
    """nearest_similarity, (qb, rb, queries) of the blocks that met and for how many queries, and the number of reference blocks.

    Items lie in blocks with those of the same nearest pivot (at most PIVOTS references, one for each block's worth of rows), in the
    order of the number of their bits. A block is known by its least and greatest number of bits, the bits that some item
    has and the bits that all have. These bound what a query can reach there, so pivots choose only what is skipped. Each
    query first meets the block of the highest bound; later it meets the blocks whose bound is above what it has found.
    Blocks meet as matrix products; no pair of items is a row.
    """
    q, r = checkpointed(_sets(queries)), checkpointed(_sets(references))
    many = r.count()
    if not many:
        return q.select("item", F.lit(0.0).alias("nearest")), None, 0
    pivots = [p["bits"] for p in r.select("item", "bits").orderBy(F.xxhash64("item"), "item").limit(min(PIVOTS, -(-many // block))).collect()]
    q, r = _dealt(q, pivots, "qb", block), _dealt(r, pivots, "rb", block)
    nr = r.select("rb").distinct().count()
    n_pages = -(-nr // PAGE)
    own, blocks, pages = checkpointed(_packed(q, "qb", ["item", "bits"])), checkpointed(_packed(r, "rb", ["item", "bits"])), _pages(r, n_pages)

    def looked_at(packs: DataFrame) -> DataFrame:
        wide = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page"))
        return _in_lanes(wide, pages, "page", n_pages)

    def met(wanted: DataFrame) -> DataFrame:
        mine = wanted.join(own.withColumnsRenamed({"item": "items", "bits": "item_bits"}).hint("merge"), "qb")
        pairs = _in_lanes(mine, blocks, "rb", nr).select("chosen", "items", "item_bits", "item", "bits")
        return pairs.mapInArrow(_meet, "item long, nearest double").groupBy("item").agg(F.max("nearest").alias("nearest"))

    bounds = looked_at(own).mapInArrow(_highest, "item long, qb long, rb long, bound double")
    first = checkpointed(bounds.groupBy("item", "qb").agg(F.max_by("rb", F.struct("bound", -F.col("rb"))).alias("first")))
    wanted = first.groupBy("qb", F.col("first").alias("rb")).agg(F.collect_list("item").alias("chosen"))  # at most a block
    found = checkpointed(q.select("item", "qb", "bits").join(first.select("item", "first").hint("merge"), "item").join(met(wanted).hint("merge"), "item"))
    rest = checkpointed(looked_at(_packed(found, "qb", ["item", "bits", "first", "nearest"])).mapInArrow(_open, "qb long, rb long, chosen array<long>"))
    later = met(rest).withColumnRenamed("nearest", "later")
    best = found.join(later.hint("merge"), "item", "left").select("item", F.greatest("nearest", F.coalesce("later", F.lit(0.0))).alias("nearest"))
    pairs = wanted.unionByName(rest).groupBy("qb", "rb").agg(F.sum(F.size("chosen")).alias("queries"))
    return best, pairs, nr


def _sets(bits: DataFrame) -> DataFrame:
    """(item, bits, n): each item's bits in order, and their number."""
    one = bits.where("bit IS NOT NULL").select(F.col("item").cast("long").alias("item"), F.col("bit").cast("long").alias("bit")).distinct()
    return one.groupBy("item").agg(F.sort_array(F.collect_list("bit")).alias("bits"), F.count("*").alias("n"))


def _dealt(sets: DataFrame, pivots: list[list[int]], name: str, block: int) -> DataFrame:
    """(item, bits, n, name): sets with their block, of about `block` items; items of one pivot and size are spread by hash."""
    heads = pa.array(pivots, pa.list_(pa.int64()))

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = _common(batch.column("bits"), heads)
                share = both / (_sizes(batch.column("bits"))[:, None] + _sizes(heads)[None, :] - both)
                yield batch.append_column("pivot", pa.array(share.argmax(axis=1).astype(np.int64)))

    near = checkpointed(sets.mapInArrow(nearest_pivot, "item long, bits array<long>, n long, pivot long"))
    cells = near.groupBy("pivot", "n").agg(F.count("*").alias("many"))
    placed = with_small(near, checkpointed(running(cells, ["pivot"], ["n"], {"before": "many"})), ["pivot", "n"])
    place = F.col("before") + F.pmod(F.xxhash64("item"), F.col("many"))
    return checkpointed(placed.select("item", "bits", "n", (F.floor(place / block) * PIVOTS + F.col("pivot")).alias(name)))


def _packed(dealt: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """A row a block, with the columns of its items as arrays in one order."""
    packs = dealt.groupBy(name).agg(F.collect_list(F.struct(*columns)).alias("pack"))
    return packs.select(name, *(F.col(f"pack.{c}").alias(c) for c in columns))


def _pages(dealt: DataFrame, n: int) -> DataFrame:
    """(page, rbs, lo, hi, some, every): bounds of the blocks of each of n pages, as arrays."""
    size = dealt.groupBy("rb").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("items"))
    per = dealt.select("rb", F.explode("bits").alias("bit")).groupBy("rb", "bit").agg(F.count("*").alias("have"))
    known = per.join(size.hint("merge"), "rb").groupBy("rb", "lo", "hi").agg(F.collect_list("bit").alias("some"), F.collect_list(F.when(F.col("have") == F.col("items"), F.col("bit"))).alias("every"))
    page = F.pmod(F.xxhash64("rb"), F.lit(n)).cast("int")
    return checkpointed(_packed(known.withColumn("page", page), "page", ["rb", "lo", "hi", "some", "every"]).withColumnRenamed("rb", "rbs"))


def _in_lanes(left: DataFrame, right: DataFrame, key: str, n: int) -> DataFrame:
    """left joined with the n rows of right; where these are fewer than the tasks of a shuffle, each stands in several lanes."""
    lanes = -(-int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    lane = F.pmod(F.xxhash64("qb"), F.lit(lanes)).cast("int")
    copies = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    return left.withColumn("_lane", lane).join(copies.hint("shuffle_hash"), [key, "_lane"]).drop("_lane")


def _sizes(bits: pa.ListArray) -> np.ndarray:
    return np.diff(bits.offsets.to_numpy()).astype(np.float64)


def _common(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many values each list of left has in common with each of right; whole numbers, exact."""

    def dense(bits: pa.ListArray, names: np.ndarray) -> np.ndarray:
        values, rows = bits.flatten().to_numpy(), np.repeat(np.arange(len(bits)), np.diff(bits.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        hit = names[at] == values
        out = np.zeros((len(bits), len(names)), dtype=np.float32)
        out[rows[hit], at[hit]] = 1
        return out

    names = np.intersect1d(left.flatten().to_numpy(), right.flatten().to_numpy())
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for k in range(0, len(names), WIDE):
        part = names[k : k + WIDE]
        out += dense(left, part) @ dense(right, part).T
    return out


def _bounds(bits: pa.ListArray, lo: np.ndarray, hi: np.ndarray, some: pa.ListArray, every: pa.ListArray) -> np.ndarray:
    """The most that each bit set can reach with any item of each block.

    An item of s bits has `lost` bits that the query lacks, and at most `most` in common with it. The similarity
    grows with s up to most + lost and falls beyond.
    """
    most = _common(bits, some)
    lost = _sizes(every)[None, :] - _common(bits, every)
    s = np.clip(most + lost, lo[None, :], hi[None, :])
    both = np.minimum(most, s - lost)
    return both / (_sizes(bits)[:, None] + s - both)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each row, with lists as Arrow arrays and other values as they are."""
    for batch in batches:
        for k in range(batch.num_rows):
            cells = {n: batch.column(n)[k] for n in batch.schema.names}
            yield {n: c.values if isinstance(c, pa.ListScalar) else c.as_py() for n, c in cells.items()}


def _of_page(row: dict) -> np.ndarray:
    return _bounds(row["bits"], row["lo"].to_numpy(), row["hi"].to_numpy(), row["some"], row["every"])


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, qb, rb, bound): for each query of a block the block of the page with the highest bound."""
    for row in _rows(batches):
        bound = _of_page(row)
        at = bound.argmax(axis=1)
        rb = row["rbs"].to_numpy()[at]
        yield pa.RecordBatch.from_arrays([row["item"], pa.array(np.full(len(rb), row["qb"])), pa.array(rb), pa.array(bound[np.arange(len(at)), at])], names=["item", "qb", "rb", "bound"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qb, rb, chosen): blocks of the page that can hold something nearer than what is found, and for which queries."""
    for row in _rows(batches):
        rbs, items = row["rbs"].to_numpy(), row["item"].to_numpy()
        left = (_of_page(row) > row["nearest"].to_numpy()[:, None]) & (row["first"].to_numpy()[:, None] != rbs[None, :])
        at = np.flatnonzero(left.any(axis=0))
        chosen = pa.array([items[left[:, k]] for k in at], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["qb"])), pa.array(rbs[at]), chosen], names=["qb", "rb", "chosen"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, nearest): the highest similarity of each chosen query to the items of a block."""
    for row in _rows(batches):
        mine = np.isin(row["items"].to_numpy(), row["chosen"].to_numpy())
        items, bits = row["items"].filter(pa.array(mine)), row["item_bits"].filter(pa.array(mine))
        both = _common(bits, row["bits"])
        score = both / (_sizes(bits)[:, None] + _sizes(row["bits"])[None, :] - both)
        score[items.to_numpy()[:, None] == row["item"].to_numpy()[None, :]] = 0  # an item is no neighbour of itself
        yield pa.RecordBatch.from_arrays([items, pa.array(score.max(axis=1))], names=["item", "nearest"])


def block_pairs(batches: Iterator[pa.RecordBatch], digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """(grp, item_a, item_b, similarity): pairs of the items of two blocks, or of one with itself, that have a bit in common."""
    for batch in batches:
        groups, kind = batch.column("grp"), batch.column("item").type.value_type
        for k, row in enumerate(_rows([batch])):
            both = _common(row["item_bits"], row["bits"])
            items, others = row["items"].to_numpy(), row["item"].to_numpy()
            open_ = both > 0
            if row["own"]:
                open_ &= items[:, None] < others[None, :]
            a, b = np.nonzero(open_)
            common = both[a, b]
            union = row["item_n"].to_numpy()[a] + row["n"].to_numpy()[b] - common
            score = common / union if digits is None else np.floor(common * 10.0**digits / union + 0.5) / 10.0**digits
            x, y = items[a], others[b]
            grp = groups.take(pa.array(np.full(len(a), k)))
            yield pa.RecordBatch.from_arrays([grp, pa.array(np.minimum(x, y), kind), pa.array(np.maximum(x, y), kind), pa.array(score)], names=["grp", "item_a", "item_b", "similarity"])


def group_nearest(nearest: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, minimum, median, maximum) of the nearest similarities of each group's items."""
    joined = nearest.join(groups.select("item", "grp").distinct().hint("merge"), "item")
    return quantiles(joined, "nearest", {"minimum": 0.0, "median": 0.5, "maximum": 1.0}, "grp")
