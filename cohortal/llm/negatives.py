"""Operator 12, hard-negative mining by a vertical scan over columns (BOND).

Rows are dealt into blocks of bounded size, by label bucket and a hash, and stored by dimension: a block holds one
array a dimension and each dimension's least and greatest value. An anchor reads a block's dimensions in
descending order of its own magnitudes, most of them before the first test. What the unread dimensions can still add lies between two sums over
their extremes, so that each candidate's score has two bounds; a candidate that can't be among the first k of any window
of scores leaves the bitmap, and the rest are read on until all dimensions are in and their scores are exact.

The first pass has one window without ends, over rows of the anchor's label: its first rows are the positives. The second
pass has a window for each positive, over rows of other labels. Each pass meets one block of every bucket first; the k-th
scores found there are floors with which the anchors meet the other blocks, so that what those return is few rows. Anchors
are the query set and meet the rows in blocks; no pair of rows leaves a task but the first ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy
from cohortal.llm.scratch import Scratch

SCALE = 256
EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score, between which a negative's lies
BUCKETS = 64  # that labels are dealt to, at most
BLOCK, MOST_BLOCK = 4096, 16_384  # rows of a block on average; larger for more rows
GROUP = 256  # anchors that meet a block together
PAIRS_AT_ONCE = 8
EXACT, NARROW = 2.0**53, 2.0**24  # sums below them are exact in double and in single precision
FIRST, STEP = 0.65, 6  # the share of dimensions read before the first test, and how many between tests
ROW = "key long, found_id long, score long"


def taking_part(table: DataFrame, label: Column) -> DataFrame:
    """(key, vec_id, label, v): rows that take part, with whole-number components, each different row once; key tells them apart."""
    held = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), label.cast("long").alias("label"))
    fine = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    rows = held.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    rows = rows.select("vec_id", "label", F.transform("x", lambda a: F.floor(F.lit(SCALE) * a)).alias("v")).distinct()
    return rows.select(F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", "v")


class Reading:
    """What some anchors (rows of q) have read of a block: for each, its order of dimensions, partial scores and what is left to come.

    columns holds an array a dimension. The first dimensions of every anchor are read in one product, in which the
    others count as zeros.
    """

    def __init__(self, q: np.ndarray, columns: np.ndarray):
        self.q, self.columns = q, columns
        self.order = np.argsort(-np.abs(q), axis=1, kind="stable")
        extremes = [np.take_along_axis(q.astype(np.float64) * x.astype(np.float64)[None, :], self.order, axis=1) for x in (columns.min(axis=1), columns.max(axis=1))]
        self.below, self.above = (np.pad(np.cumsum(x[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1))) for x in (np.minimum(*extremes), np.maximum(*extremes)))
        self.read = max(1, int(q.shape[1] * FIRST))
        first = np.zeros_like(q)
        at = self.order[:, : self.read]
        np.put_along_axis(first, at, np.take_along_axis(q, at, axis=1), axis=1)
        self.partial = first @ columns

    def resolve(self, a: int, able: np.ndarray, low: list[float], high: list[float], floor: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the block's rows that are among the first k of a window of anchor a, ties to the smaller place.

        able marks the places that may answer. A window is the scores from low to high; answers below its
        floor aren't wanted.
        """
        q, order, columns = self.q[a], self.order[a], self.columns
        end, n, partial = self.read, len(q), self.partial[a]
        wanted = [max(x) for x in zip(low, floor, strict=True)]
        below, above = float(self.below[a, end]), float(self.above[a, end])
        places = np.flatnonzero(able & (partial >= min(wanted) - above) & (partial <= max(high) - below))
        partial = partial[places]
        while len(places):
            keep = np.zeros(len(places), dtype=bool)
            for w, (lo, hi) in enumerate(zip(low, high, strict=True)):
                if lo - below <= hi - above:
                    sure = partial[(partial >= lo - below) & (partial <= hi - above)]  # inside whatever the rest adds
                    if len(sure) >= k:
                        wanted[w] = max(wanted[w], float(np.partition(sure, len(sure) - k)[len(sure) - k]) + below)
                keep |= (partial >= wanted[w] - above) & (partial <= hi - below)
            places, partial = places[keep], partial[keep]
            if end == n:
                break
            start, end = end, min(n, end + STEP)
            dims = order[start:end]
            partial = partial + q[dims] @ columns[dims[:, None], places[None, :]]
            below, above = float(self.below[a, end]), float(self.above[a, end])
        by_score = np.argsort(-partial, kind="stable")
        places, partial = places[by_score], partial[by_score]
        taken = np.zeros(len(places), dtype=bool)
        for lo, hi in zip(wanted, high, strict=True):
            taken[np.flatnonzero((partial >= lo) & (partial <= hi))[:k]] = True
        return places[taken], partial[taken].astype(np.int64)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _row(names: list[str], numbers: list[int], arrays: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_arrays([*(pa.array([k], pa.int32()) for k in numbers), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=names)


class Columns:
    """Blocks of rows by dimension, as a scratch table, and the rows with the label bucket of each."""

    def __init__(self, rows: DataFrame, scratch: Scratch, block: int | None = None):
        self.scratch = scratch
        rows = scratch.table(rows, "different")
        n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.n, width = n, max(1, width or 0)
        reach = width * float(top or 0) ** 2
        if reach >= EXACT:
            raise ValueError("components are so large that sums of products would not be exact")
        self.kind = np.float32 if reach < NARROW else np.float64
        block = block or min(MOST_BLOCK, max(BLOCK, n // 4096))
        buckets = max(1, min(BUCKETS, n // block))
        # shorter vectors are filled up with zeros, which add nothing to a score
        filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
        placed = rows.select("key", "vec_id", "label", filled.alias("v"), F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int").alias("bucket"))
        self.rows = scratch.table(placed, "rows")
        scratch.drop("different")
        counts = {r["bucket"]: r["n"] for r in self.rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket
        self.parts = [-(-counts.get(k, 0) // block) for k in range(buckets)]
        dealt = self.rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), self.of_bucket(self.parts)).cast("int"))

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            order = np.argsort(_numbers(table.column("vec_id")), kind="stable")
            columns = np.ascontiguousarray(_matrix(table.column("v"))[order].T, dtype=np.int64)
            return _row(["bucket", "part", "ids", "labels", "columns"], [k.as_py() for k in key], [_numbers(table.column("vec_id"))[order], _numbers(table.column("label"))[order], columns])

        packed = dealt.groupBy("bucket", "part").applyInArrow(pack, "bucket int, part int, ids binary, labels binary, columns binary")
        self.blocks = scratch.table(packed, "blocks")

    @staticmethod
    def of_bucket(numbers: list[int]) -> Column:
        return F.get(F.array(*(F.lit(max(1, x)).cast("long") for x in numbers)), F.col("bucket"))

    def anchors(self, every: int) -> DataFrame:
        """The rows whose id `every` divides, with a group of about GROUP anchors of a bucket."""
        rows = self.rows.where(F.col("vec_id") % every == 0)
        counts = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        groups = [-(-counts.get(k, 0) // GROUP) for k in range(len(self.parts))]
        return rows.withColumn("group", F.pmod(F.xxhash64("key", F.lit(2)), self.of_bucket(groups)).cast("int"))

    def meet(self, anchors: DataFrame, same: bool, first: bool, k: int, name: str) -> DataFrame:
        """ROW: rows of the anchor's label (same) or of others that are among the first k of one of its windows in their block.

        anchors(key, vec_id, label, v, bucket, group, windows). first: the blocks numbered 0; else all others.
        """
        kind = self.kind

        def pack(key: tuple, table: pa.Table) -> pa.Table:
            windows = table.column("windows").to_pylist()
            flat = [[w[c] for row in windows for w in row] for c in ("low", "high", "floor")]
            arrays = [_numbers(table.column("key")), _numbers(table.column("vec_id")), _numbers(table.column("label")), _matrix(table.column("v")), np.array([len(w) for w in windows], dtype=np.int64), *(np.array(x, dtype=np.float64) for x in flat)]
            return _row(["bucket", "group", "keys", "asked", "own", "q", "sizes", "low", "high", "floor"], [x.as_py() for x in key], arrays)

        fields = ["keys", "asked", "own", "q", "sizes", "low", "high", "floor"]
        packed = anchors.groupBy("bucket", "group").applyInArrow(pack, f"bucket int, group int, {', '.join(f'{f} binary' for f in fields)}")
        packed = self.scratch.table(packed, f"{name}-anchors")
        listed = [F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts")) for b, n in enumerate(self.parts) if n]
        to = F.filter(F.array(*listed), lambda x: x["bucket"] == F.col("bucket")) if same else F.array(*listed)
        wanted = packed.select(*fields, F.explode(to).alias("to"))
        numbers = F.sequence(F.lit(0), F.lit(0)) if first else F.sequence(F.lit(1), F.col("to.parts") - 1)
        wanted = wanted.where(F.lit(first) | (F.col("to.parts") > 1)).select(F.col("to.bucket").alias("bucket"), F.explode(numbers).alias("part"), *fields)

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    keys, asked, own, q, sizes, low, high, floor, ids, labels, columns = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.float64 if 5 <= c <= 7 else np.int64) for c in range(11))
                    columns = columns.reshape(-1, len(ids)).astype(kind)
                    q = q.reshape(len(keys), -1).astype(kind)
                    reading = Reading(q, columns)
                    ends = np.cumsum(sizes)
                    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for a, end in enumerate(ends.tolist()):
                        w = slice(end - int(sizes[a]), end)
                        able = ((labels == own[a]) == same) & (ids != asked[a])
                        places, scores = reading.resolve(a, able, low[w].tolist(), high[w].tolist(), floor[w].tolist(), k)
                        out.append((np.full(len(places), keys[a]), ids[places], scores))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["key", "found_id", "score"])

        joined = wanted.join(self.blocks.hint("shuffle_hash"), ["bucket", "part"]).select(*fields, "ids", "labels", "columns").mapInArrow(run, ROW)
        with self.scratch.batches(PAIRS_AT_ONCE):
            found = self.scratch.table(joined, name)
        self.scratch.drop(f"{name}-anchors")
        return found


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of found(*keys, found_id, score) of highest score of each key, with place, from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _window(low: Column, high: Column, floor: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.coalesce(floor.cast("double"), F.lit(float("-inf"))).alias("floor"))


def positives(columns: Columns, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(key, found_id, score, place): the k rows of highest score of each anchor's label."""
    ends = F.lit(float("-inf")), F.lit(float("inf"))
    found = _first(columns.meet(anchors.withColumn("windows", F.array(_window(*ends, F.lit(None)))), True, True, k, "near"), ["key"], k)
    if max(columns.parts) > 1:
        floors = found.where(F.col("place") == k).select("key", F.col("score").alias("floor"))
        known = anchors.join(floors.hint("merge"), "key", "left").withColumn("windows", F.array(_window(*ends, F.col("floor")))).drop("floor")
        found = _first(columns.meet(known, True, False, k, "nearer").unionByName(found.drop("place")), ["key"], k)
    return found


def _inside(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, at, found_id, score): the windows(key, at, low, high) of an anchor that each found row lies in."""
    held = found.join(windows.select("key", "at", "low", "high").hint("merge"), "key")
    return held.where((F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high"))).select("key", "at", "found_id", "score")


def mine(table: DataFrame, label: str | Column = "label", every: int = EVERY, near: int = POSITIVES, hard: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for table(vec_id, embedding, a label).

    Anchors are rows whose id `every` divides. An anchor's positives are the `near` rows of other ids and its label of
    highest score; for each, the `hard` rows of another label of highest score between `low` and `high` per cent of the
    positive's are its negatives. Ties go to the smaller vec_id; fewer rows give all; a positive score of 0 or less has
    a window of 0 or none. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows
    alike in id, label and vector are one row; rows that share an id but differ are rows of their own. Vectors of unlike
    length count as filled up with zeros, an empty one as zero. An empty table gives an empty one; other columns are not
    read. Components whose sums of products might pass 2**53 raise a ValueError.
    """
    scratch = Scratch(table.sparkSession, "negatives")
    columns = Columns(taking_part(table, F.col(label) if isinstance(label, str) else label), scratch, block)
    if not columns.n:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = scratch.table(columns.anchors(every), "anchors")
    floored = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    chosen = positives(columns, anchors, near).select("key", F.col("place").alias("at"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = chosen.withColumn("low", -floored(F.col("positive_score") * -low)).withColumn("high", floored(F.col("positive_score") * high))
    chosen = scratch.table(chosen.where("low <= high"), "windows")
    scratch.drop("near", "nearer")

    def asking(windows: DataFrame) -> DataFrame:
        held = windows.groupBy("key").agg(F.array_sort(F.collect_list(_window(F.col("low"), F.col("high"), F.col("floor")))).alias("windows"))  # `near` windows at most
        return anchors.join(held.hint("merge"), "key")

    met = columns.meet(asking(chosen.withColumn("floor", F.lit(None).cast("long"))), False, True, hard, "hard")
    found = _first(_inside(met, chosen), ["key", "at"], hard)
    if max(columns.parts) > 1:
        floors = found.where(F.col("place") == hard).select("key", "at", F.col("score").alias("floor"))
        met = columns.meet(asking(chosen.join(floors.hint("merge"), ["key", "at"], "left")), False, False, hard, "harder")
        found = _first(_inside(met, chosen).unionByName(found.drop("place")), ["key", "at"], hard)
    named = chosen.join(anchors.select("key", F.col("vec_id").alias("anchor_id")).hint("merge"), "key")
    out = found.join(named.hint("merge"), ["key", "at"])
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(table, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
  WHERE place <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
