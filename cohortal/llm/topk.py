"""Operator 3, exact top-k by inner product over a pivot-distance index.

Inner products become distances: a vector x is lengthened by sqrt(M^2 - |x|^2), M being the largest norm, and a
query by 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest pivot and their distance from
it, cut into annuli; a cell (pivot, annulus) of many vectors is dealt by hash into blocks of bounded size, which
is what the index holds. A query block first meets the blocks of its own cells, which gives each query a
bound; then the remaining cells in the order of their least possible distance, in two expansions, each with the bound
of the one before. A cell is left out when the triangle inequality puts all of it beyond the bound.
Blocks meet blocks; pairs of vectors exist only inside a task, as one matrix product.

Equal rows (vec_id, v) are one row of the index with the number of its copies, so that the k best rows of a block hold its
k best with repeats; the last step gives each copy its own rank, as the SQL does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.llm.scratch import Scratch

K = 5
SCALE = 256
PIVOTS, MOST_PIVOTS = 32, 1024  # a root of the number of vectors between them
ANNULI = 16
BLOCK, MOST_BLOCK = 2048, 16_384  # vectors in a block of the index, on average; larger for more vectors, as queries go to each block
QUERY_BLOCK = 256
PAIRS_AT_ONCE = 16  # block pairs that a task has in memory
EXACT = 2.0**53  # below it products of vectors are exact in floating point, whatever the order of addition
LARGEST = 2.0**62  # squared norm; beyond it scores would leave 64 bits
SLACK = 1e-6  # relative; distances are floating point, a cell at the bound is kept
OUT = "query_id long, vec_id long, score long, copies long"


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x); rows with a null id or vector, or a null or non-finite x, go."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(F.lit(scale) * a)).alias("v"))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length, one at least."""
    flat = column.flatten().to_numpy().astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; exact: norms allow floating point without an error."""
    if exact:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _distances(rows: np.ndarray, tail: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each lengthened row from each (lengthened) pivot."""
    own = (rows**2).sum(axis=1) + tail**2
    cross = rows @ pivots[:, :-1].T + np.outer(tail, pivots[:, -1])
    return np.sqrt(np.maximum(0.0, own[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * cross))


class Index:
    """The pivots, the annuli, and the blocks as a scratch table."""

    def __init__(self, vectors: DataFrame, scratch: Scratch, pivots: int | None = None, annuli: int = ANNULI, block: int | None = None):
        self.scratch, spark = scratch, scratch.spark
        rows = scratch.table(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "distinct")
        square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
        top, width, n = rows.agg(F.max(square), F.max(F.size("v")), F.count("*")).first()
        self.most = float(top or 0)
        if self.most >= LARGEST:
            raise ValueError("a vector's squared norm reaches 2**62; scores would leave 64 bits")
        self.exact = self.most < EXACT
        pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, round(n**0.5 / 8)))
        block = block or min(MOST_BLOCK, max(BLOCK, n // 4096))
        # shorter vectors are filled up with zeros, which add nothing to a score
        longest = max(1, width or 0)
        filled = F.when(F.size("v") < longest, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v")))).otherwise(F.col("v"))
        rows = scratch.table(rows.withColumn("v", filled), "vectors")
        scratch.drop("distinct")
        # a bounded sample in the order of a hash
        sample = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "vec_id").limit(pivots).select("v").collect()]
        if not sample:
            self.cells, self.blocks = [], None
            return
        found = np.unique(np.array(sample, dtype=np.float64), axis=0)
        self.pivots = np.concatenate((found, np.sqrt(np.maximum(0.0, self.most - (found**2).sum(axis=1)))[:, None]), axis=1)
        self.width = max(1e-9, 2 * float(np.sqrt(self.most)) / annuli)
        keyed = scratch.table(self._keyed(rows), "keyed")
        per = keyed.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()  # pivots x annuli rows at most
        self.cells = sorted((r["pivot"], r["annulus"], r["low"], r["high"], -(-r["n"] // block)) for r in per)
        size = spark.createDataFrame([(p, a, n) for p, a, _, _, n in self.cells], "pivot int, annulus int, parts long")
        dealt = keyed.join(F.broadcast(size), ["pivot", "annulus"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
        packed = dealt.groupBy("pivot", "annulus", "part").applyInArrow(_pack, "pivot int, annulus int, part int, ids binary, vectors binary, times binary")
        self.blocks = scratch.table(packed, "blocks")
        self.queries_from = keyed

    def _keyed(self, rows: DataFrame) -> DataFrame:
        pivots, most, width = self.pivots, self.most, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = _matrix(batch.column(1))
                d = _distances(m, np.sqrt(np.maximum(0.0, most - (m**2).sum(axis=1))), pivots)
                near = d.argmin(axis=1)
                far = d[np.arange(len(m)), near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.floor(far / width).astype(np.int32)), pa.array(far)], names=["vec_id", "v", "copies", "pivot", "annulus", "far"])

        return rows.select("vec_id", "v", "copies").mapInArrow(run, "vec_id long, v array<long>, copies long, pivot int, annulus int, far double")


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").combine_chunks().to_numpy()
    m = _matrix(table.column("v").combine_chunks(), np.int64)
    copies = table.column("copies").combine_chunks().to_numpy()
    order = np.argsort(ids, kind="stable")
    row = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([x[order].astype(np.int64).tobytes()], pa.binary()) for x in (ids, m, copies)]
    return pa.Table.from_arrays(row, names=["pivot", "annulus", "part", "ids", "vectors", "times"])


def _best(qid: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of score (queries x vectors) the k highest, ties to the smaller id; not the query's own id. Ids, scores, and their places."""
    score = np.where(qid[:, None] == ids[None, :], np.int64(-(2**62)), score)
    rows, cols = [], []
    for r in range(len(qid)):
        line = score[r]
        if len(line) > k:
            edge = np.partition(line, len(line) - k)[len(line) - k]
            at = np.flatnonzero(line >= edge)
        else:
            at = np.arange(len(line))
        at = at[line[at] > -(2**62)]
        at = at[np.lexsort((ids[at], -line[at]))][:k]
        rows.append(np.full(len(at), r))
        cols.append(at)
    r, c = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, cols))
    return qid[r], ids[c], score[r, c], r, c


def _join_blocks(wanted: DataFrame, blocks: DataFrame, k: int, exact: bool) -> DataFrame:
    """OUT: the k best of every (query block, index block) pair; one pair is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, q, asked, ids, v, times = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in range(6))
                score = products(q.reshape(len(qid), -1), v.reshape(len(ids), -1), exact)
                *found, r, c = _best(qid, ids, score, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*found, asked[r] * times[c])], names=["query_id", "vec_id", "score", "copies"])

    joined = wanted.join(blocks.hint("shuffle_hash"), ["pivot", "annulus", "part"]).select("qid", "q", "asked", "ids", "vectors", "times")
    return joined.mapInArrow(run, OUT)


def _rank(found: DataFrame, k: int) -> DataFrame:
    """(query_id, before, vec_id, score, copies): the rows that hold the k best of each query; `before` copies rank higher.

    Spark cuts each task's rows of a query to k before it deals them.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("before", before).where(F.col("before") < k).select("query_id", "before", "vec_id", "score", "copies")


def _each(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): a row for each copy, up to rank k."""
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))
    return found.select("query_id", F.explode(ranks.cast("array<int>")).alias("rank"), "vec_id", "score")


def search(queries: DataFrame, index: Index, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of queries(vec_id, v, copies, pivot, annulus)."""
    scratch, spark = index.scratch, index.scratch.spark
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    cells = {(p, a): (low, high, parts) for p, a, low, high, parts in index.cells}
    pivots, most = index.pivots, index.most
    near = queries.select("vec_id", "v", "copies", "pivot", "annulus", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("group"))
    grouped = near.groupBy("group", "pivot").applyInArrow(lambda key, t: _pack_queries(key, t), "group int, pivot int, annulus int, qid binary, q binary, asked binary")
    packed = scratch.table(grouped, "query-blocks")

    def expand(blocks: DataFrame, bounds: bool, first: int, last: int | None):
        """Rows (pivot, annulus, part, qid, q, asked): the cells of ranks first to last by least distance, for the queries that they concern."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = list(cells)
            low, high = (np.array([cells[c][x] for c in listed]) for x in (0, 1))
            of = np.array([c[0] for c in listed])
            for batch in batches:
                for row in range(batch.num_rows):
                    qid, q, asked = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in range(3))
                    m = q.reshape(len(qid), -1)
                    d = _distances(m.astype(np.float64), np.zeros(len(m)), pivots)[:, of]
                    least = np.maximum(0.0, np.maximum(d - high, low - d))
                    rank = least.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    take = (rank >= first) & (rank < (last if last is not None else len(listed)))
                    if bounds:
                        kth = np.frombuffer(batch.column(3)[row].as_py(), dtype=np.float64)
                        reach = (m.astype(np.float64) ** 2).sum(axis=1) + most - 2 * kth  # squared distance of the k-th best
                        take &= least**2 <= (reach + SLACK * (abs(reach) + most + 1))[:, None]
                    for c in np.flatnonzero(take.any(axis=0)):
                        some = take[:, c]
                        (p, a), parts = listed[c], cells[listed[c]][2]
                        yield pa.RecordBatch.from_arrays([pa.array([p] * parts, pa.int32()), pa.array([a] * parts, pa.int32()), pa.array(range(parts), pa.int32()), pa.array([qid[some].tobytes()] * parts, pa.binary()), pa.array([m[some].tobytes()] * parts, pa.binary()), pa.array([asked[some].tobytes()] * parts, pa.binary())], names=["pivot", "annulus", "part", "qid", "q", "asked"])

        return blocks.mapInArrow(run, "pivot int, annulus int, part int, qid binary, q binary, asked binary")

    found, parts, steps = None, packed.select("qid", "q", "asked"), (0, 2, 8, None)
    for step in range(len(steps) - 1):
        wanted = expand(parts, step > 0, steps[step], steps[step + 1])
        more = _join_blocks(wanted, index.blocks, k, index.exact)
        with scratch.batches(PAIRS_AT_ONCE):
            found = scratch.table(_rank(more if found is None else more.unionByName(found.select("query_id", "vec_id", "score", "copies")), k), f"found-{step}")
        kth = found.where(F.col("before") + F.col("copies") >= k).select("query_id", "score")
        parts = _with_bounds(packed, kth)
    return _each(found, k)


def _with_bounds(packed: DataFrame, kth: DataFrame) -> DataFrame:
    """(qid, q, asked, kth binary): the score of each query's k-th best so far, -infinity where there are fewer."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid = np.frombuffer(batch.column(2)[row].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(qid), pa.int32()), pa.array([batch.column(1)[row].as_py()] * len(qid), pa.int32()), pa.array(qid)], names=["group", "pivot", "query_id"])

    listed = packed.select("group", "pivot", "qid").mapInArrow(ids, "group int, pivot int, query_id long")
    scored = listed.join(kth.hint("shuffle_hash"), "query_id", "left").groupBy("group", "pivot").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid = np.frombuffer(batch.column(0)[row].as_py(), dtype=np.int64)
                known = {x["query_id"]: x["score"] for x in batch.column(1)[row].as_py() if x["score"] is not None}
                kth = np.array([known.get(x, -np.inf) for x in qid.tolist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, 1) for c in (0, 2, 3)), pa.array([kth.tobytes()], pa.binary())], names=["qid", "q", "asked", "kth"])

    return packed.join(scored.hint("shuffle_hash"), ["group", "pivot"]).select("qid", "kth", "q", "asked").mapInArrow(run, "qid binary, q binary, asked binary, kth binary")


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").combine_chunks().to_numpy().astype(np.int64)
    m = _matrix(table.column("v").combine_chunks(), np.int64)
    copies = table.column("copies").combine_chunks().to_numpy().astype(np.int64)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, m, copies))], names=["group", "pivot", "annulus", "qid", "q", "asked"])


def top_k(table: DataFrame, every: int = 50, k: int = K, **index) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of table(vec_id, embedding) whose id `every` divides, its k best.

    Candidates are all rows but those of the query's own id; fewer than k give all. Rows with a null id or vector, or
    with a null or non-finite component, take no part. Vectors of unlike length count as filled up with zeros, an empty
    one as zero. Equal scores go by the smaller id; a row that repeats another has a rank of its own, and so has
    each answer to a query that is repeated. An empty table gives an empty one. Other columns, long texts
    among them, are not read. Scores are exact integers; where a squared norm reaches 2**62 a ValueError is raised.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    built = Index(integer_vectors(table), scratch, **index)
    if not built.cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(built.queries_from.where(F.col("vec_id") % every == 0), built, k)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
