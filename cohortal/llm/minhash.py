"""Operator 6, MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

A sketch has SKETCH coordinates. In round i every shingle is hashed to one coordinate and leaves the
value i + fraction there; the least value stays. From round SKETCH on, round i fills the one coordinate i - SKETCH,
so that after twice SKETCH rounds each is full; usually a few rounds do, and estimates concentrate as those of
independent minima. Bands of r coordinates make b bucket keys: two sets of similarity s share none of them with
probability (1 - s^r)^b. banding() takes the longest bands that keep it below 1e-6 at the similarity that is
asked for: 24 of 5 at 0.85, 30 of 4 at 0.80.

Documents with the same shingle set form a class; classes alone are compared. In each bucket all classes are first
verified against the smallest, the pivot; then, of all classes that met one pivot, those outside its main component
are verified against the others, block by block. Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.components import components
from cohortal.llm.memory import tidy
from cohortal.llm.scratch import Scratch
from cohortal.llm.words import mix, window_hashes, word_hashes

SHINGLE = 5
SIMILAR = 85  # percent, of op6's query
BANDS, ROWS = 24, 5
SKETCH = BANDS * ROWS
MISSED = 1e-6  # the chance that a pair just similar enough shares no bucket
_ROUND = np.random.default_rng(41).integers(1, 2**63, 2 * SKETCH, dtype=np.uint64)
_FULL = np.uint64(2**64 - 1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles, A-Z lower-cased; of all words, if they are fewer."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(words, min(SHINGLE, len(words))))


def sketch(found: np.ndarray) -> np.ndarray:
    """The SKETCH coordinates of a non-empty set."""
    out = np.full(SKETCH, _FULL, dtype=np.uint64)
    step = max(1, min(SKETCH, 700 // len(found)))
    for start in range(0, SKETCH, step):
        rounds = np.arange(start, min(SKETCH, start + step), dtype=np.uint64)
        z = mix(found[None, :] ^ _ROUND[start : start + len(rounds), None])
        at = ((z >> np.uint64(32)) * np.uint64(SKETCH)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(32)) | (z & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        if (out != _FULL).all():
            return out
    for k in np.flatnonzero(out == _FULL):
        z = mix(found ^ _ROUND[SKETCH + k])
        out[k] = (np.uint64(SKETCH + k) << np.uint64(32)) | (z & np.uint64(0xFFFFFFFF)).min()
    return out


def banding(percent: int) -> int:
    """Coordinates of a band: as many as divide the sketch and miss a pair of this similarity with less than MISSED."""
    for rows in (ROWS, 4, 3, 2):
        if (1 - (percent / 100) ** rows) ** (SKETCH // rows) < MISSED:
            return rows
    return 1


def band_keys(found: np.ndarray, width: int = ROWS) -> np.ndarray:
    rows = sketch(found).reshape(-1, width)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(width):
        key = mix(key ^ rows[:, k]) + rows[:, k]
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int = ROWS) -> DataFrame:
    """(doc_id, n, print, bands) of docs(doc_id, text): set size, a fingerprint of the set, its bucket keys."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, bands = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                n.append(len(found))
                if len(found):
                    prints.append(f"{int(mix(found).sum()):016x}{int(np.bitwise_xor.reduce(mix(found ^ np.uint64(77)))):016x}")
                    bands.append(band_keys(found, width))
                else:
                    prints.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "print", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print string, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles binary) of docs(doc_id, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sets], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are similar. Spark splits the joins where an id has many pairs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    joined = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(run, "a long, b long")


MEMBERS, MINORS = 192, 64  # sets in a block, on average
MEETINGS = 1 << 19  # tokens in common that are counted at once
TEXTS_AT_ONCE = 2000  # that a task gets from Spark
PAIRS_AT_ONCE = 32  # block pairs that a task has in memory


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    sets = table.column("shingles").to_pylist()
    size = np.array([len(x) for x in sets], dtype=np.int64) // 8
    row = [key[0], key[1], np.asarray(table.column("rep").to_pylist(), dtype=np.int64).tobytes(), np.asarray(table.column("comp").to_pylist(), dtype=np.int64).tobytes(), size.tobytes(), b"".join(sets)]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([v.as_py() if k < 2 else v], kind) for k, (v, kind) in enumerate(zip(row, kinds, strict=True))], names=["pivot", "part", "reps", "comps", "sizes", "shingles"])


def block_links(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], percent: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of two blocks (reps, comps, sizes, shingles) that lie in different components.

    Of a set's links into one component the first is enough. Intersections are counted for many sets at once.
    """
    order = np.argsort(y[3], kind="stable")
    tokens, owner = y[3][order], np.repeat(np.arange(len(y[0]), dtype=np.int32), y[2])[order]
    low, high = np.searchsorted(tokens, x[3], "left"), np.searchsorted(tokens, x[3], "right")
    many = high - low
    both = np.zeros((len(x[0]), len(y[0])), dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(x[2])))  # of the tokens of each set
    met = np.concatenate(([0], np.cumsum(many)))[ends]  # tokens in common before each set
    first = 0
    while first < len(x[0]):  # some sets at a time, as many as have about MEETINGS tokens in common with the block
        last = max(first + 1, int(np.searchsorted(met, met[first] + MEETINGS, "right")) - 1)
        part = slice(ends[first], ends[last])
        n = many[part]
        of_x = np.repeat(np.repeat(np.arange(last - first, dtype=np.int32), x[2][first:last]), n)
        of_y = owner[np.repeat((low[part] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
        both[first:last] = np.bincount(of_x * len(y[0]) + of_y, minlength=(last - first) * len(y[0])).reshape(last - first, len(y[0]))
        first = last
    alike = (100 * both >= percent * (x[2][:, None] + y[2][None, :] - both)) & (x[1][:, None] != y[1][None, :])
    i, j = np.nonzero(alike)
    keep = np.unique(np.stack((i, y[1][j])), axis=1, return_index=True)[1] if len(i) else np.zeros(0, dtype=np.int64)
    return x[0][i[keep]], y[0][j[keep]]


def across_components(open_: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(a, b): links between members of one pivot that still lie in different components.

    open_(pivot, rep, comp, main, all, minor): those outside the pivot's main component are compared with
    all its members, in blocks: pairs exist only inside a task, as one sparse product, and every link that is
    missing joins a set outside the main component to another one.
    """
    held = open_.join(sets.hint("merge"), F.col("rep") == F.col("doc_id")).select("pivot", "rep", "comp", "main", "shingles", "all", "minor")
    part = lambda total, size: F.pmod(F.xxhash64("rep"), F.ceil(F.col(total) / size)).cast("int").alias("part")
    kind = "pivot long, part int, reps binary, comps binary, sizes binary, shingles binary"
    members = held.select("pivot", part("all", MEMBERS), "rep", "comp", "shingles").groupBy("pivot", "part").applyInArrow(_pack, kind)
    minors = held.where("comp <> main").select("pivot", part("minor", MINORS), "rep", "comp", "shingles").groupBy("pivot", "part").applyInArrow(_pack, kind)
    # each block goes to every block of members of its pivot, and each of those is a key of its own
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / MEMBERS).cast("int") - 1))
    wide = open_.select("pivot", "all").distinct().select("pivot", parts.alias("part"))
    minors = minors.select("pivot", *(F.col(c).alias(f"x_{c}") for c in ("reps", "comps", "sizes", "shingles"))).join(wide.hint("merge"), "pivot")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                v = [np.frombuffer(batch.column(c)[k].as_py(), dtype=np.int64) for c in range(8)]
                a, b = block_links(tuple(v[:4]), tuple(v[4:]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    joined = members.join(minors.hint("merge"), ["pivot", "part"]).select("x_reps", "x_comps", "x_sizes", "x_shingles", "reps", "comps", "sizes", "shingles")
    return joined.mapInArrow(run, "a long, b long")


def _size_fits(x, y, percent: int):
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def near_components(docs: DataFrame, scratch: Scratch, percent: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs(doc_id, text).

    Documents are linked whose sets have a Jaccard similarity of `percent` or more.
    component_id is the smallest doc_id that links reach, the document's own included. A null text, or one
    without words, has 0 shingles and is linked with nothing. Rows that repeat a doc_id are one
    document. A row with a null doc_id takes no part: its component_id is null and it is kept. A text of any length counts
    whole. An empty table gives an empty one. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch.batches(TEXTS_AT_ONCE):
        prints = scratch.table(signatures(docs, banding(percent)), "signatures")
    known = prints.where("n > 0 and doc_id is not null")
    classes = scratch.table(known.groupBy("print", "n").agg(F.min(F.struct("doc_id", "bands")).alias("least")).select("print", "n", F.col("least.doc_id").alias("rep"), F.col("least.bands").alias("bands")), "classes")
    buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    least = F.min(F.struct("rep", "n"))
    shared = scratch.table(buckets.groupBy("band", "key").agg(least.alias("least"), F.count("*").alias("many")).where("many > 1").select("band", "key", F.col("least.rep").alias("pivot"), F.col("least.n").alias("pivot_n")), "shared")
    members = scratch.table(buckets.join(shared.hint("merge"), ["band", "key"]), "members")
    first = members.where((F.col("rep") > F.col("pivot")) & _size_fits(F.col("n"), F.col("pivot_n"), percent)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    first = scratch.table(first, "pairs-1")
    # whole texts are read again for the classes that share a bucket with another
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    with scratch.batches(TEXTS_AT_ONCE):
        sets = scratch.table(shingle_sets(docs.join(wanted.hint("merge"), "doc_id", "left_semi")), "sets")
        links = scratch.table(verified(first, sets, percent), "links-1")
    found = components(links, scratch, "cc-1")
    placed = members.where(F.col("rep") >= F.col("pivot")).select("pivot", "rep", "n").distinct()
    placed = scratch.table(placed.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("pivot", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "placed")
    per = placed.groupBy("pivot", "comp").agg(F.count("*").alias("many"))
    split = per.groupBy("pivot").agg(F.count("*").alias("comps"), F.sum("many").alias("all"), F.max("many").alias("most"), F.max_by("comp", F.struct("many", "comp")).alias("main")).where("comps > 1")
    split = scratch.table(split, "split")  # written out, so that Spark can split the join where a pivot has very many rows
    open_ = scratch.table(placed.join(split.hint("merge"), "pivot").select("pivot", "rep", "comp", "main", "all", (F.col("all") - F.col("most")).alias("minor")), "open")
    with scratch.batches(PAIRS_AT_ONCE):
        links = scratch.table(links.union(across_components(open_, sets, percent)), "links-2")
    alike = known.join(classes.select("print", "rep").hint("merge"), "print").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.union(alike), scratch, "cc-2")
    scratch.drop("classes", "shared", "members", "pairs-1", "sets", "links-1", "placed", "split", "open", "links-2")
    own = prints.select("doc_id", F.col("n").alias("n_shingles"))
    out = own.join(final.hint("merge"), own["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, but for the documents that are not the first of their component.

    Rows with a null doc_id, and those without words, stay; so do all rows of a kept doc_id. An empty table stays empty.
    """
    found = near_components(docs, Scratch(docs.sparkSession, "near"), percent)
    gone = found.where("not kept").select(F.col("doc_id").alias("_near_id")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_near_id"], "left_anti")


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "near"))
