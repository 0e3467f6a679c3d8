"""Operator 2, substring dedup: words covered by a window that also stands in an earlier document are removed.

Window lengths double: GRAM words, then twice that and so on, the last doubling cut at the length asked for (4, 8, 13 by
default; 3, 6, 12, 13 gives the same result): a window of a length is looked at only where the windows of the length
before at its two ends repeat, until none is left or the length asked for is reached. At the first length a
document contributes its anchors: of the GRAM-word windows inside each full window the one of least hash. Equal
full windows have equal anchors, so a window can only repeat if its anchor stands in two documents. Only windows
whose anchors repeat are looked at at the next length, and only those that repeat there at the length after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy
from cohortal.llm.scratch import Scratch
from cohortal.llm.words import window_hashes, word_hashes

WINDOW = 13
GRAM = 4
TAG = 0x7FFFFFFF
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def ladder(gram: int, window: int) -> list[int]:
    """The lengths between gram and window by doubling, window itself last."""
    out = []
    while gram * 2 < window:
        gram *= 2
        out.append(gram)
    return [*out, window]


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's place and hash: the least gram hash inside it, the first of equals."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    inside = np.lib.stride_tricks.sliding_window_view(grams := window_hashes(words, gram), window - gram + 1)
    at = inside.argmin(axis=1) + np.arange(len(inside))
    return at, grams[at]


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, owner, place): each anchor of docs(text, owner) once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owners, places = [], [], []
            for text, owner in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, found = anchors(word_hashes(_raw(text)), window, gram)
                at, first = np.unique(at, return_index=True)
                grams.append(found[first])
                places.append(at)
                owners.append(np.full(len(at), owner, dtype=np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "owner", "place"])

    return docs.select("text", "owner").mapInArrow(run, "gram long, owner long, place int")


def repeated(rows: DataFrame, keys: list[str], earlier_only: bool, scratch: Scratch, name: str) -> DataFrame:
    """(owner, places array<int>): where windows of an owner also stand in another (an earlier) one.

    The repeated windows are written out: Spark can then split the join where one window stands in very many rows.
    """
    ends = rows.groupBy(*keys).agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high")
    found = rows.join(scratch.table(ends, name, wait=True).hint("merge"), keys)
    if earlier_only:
        found = found.where("owner > low")
    return found.groupBy("owner").agg(F.collect_set("place").alias("places"))  # bounded by one document's words


def candidate_rows(docs: DataFrame, window: int, gram: int, length: int, by_anchor: bool) -> DataFrame:
    """(h1, h2, owner, place): the windows of `length` words of docs(text, owner, places, tag) that may repeat.
    The upper half of a place is the tag, which tells apart different texts of rows that repeat a doc_id.

    by_anchor: places are anchors that repeat, and windows are those that a full window of such an anchor holds.
    Else they are starts of shorter windows that repeat; a window is taken if the shorter ones at its two
    ends are among them.
    """
    steps = [gram, *ladder(gram, window)]
    shorter = steps[steps.index(length) - 1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for text, owner, places, tag in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = word_hashes(_raw(text))
                n = len(words) - length + 1
                if n <= 0:
                    continue
                hit = np.zeros(len(words) + length, dtype=bool)
                hit[places.values.to_numpy()] = True
                if by_anchor:
                    full = np.flatnonzero(hit[anchors(words, window, gram)[0]])
                    want = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(want, full, 1)
                    np.add.at(want, full + window - length + 1, -1)
                    start = np.flatnonzero(np.cumsum(want)[:n] > 0)
                else:
                    start = np.flatnonzero(hit[:n] & hit[length - shorter : length - shorter + n])
                one, two = window_hashes(words, length), window_hashes(words, length, seed=1)
                for k, v in enumerate((one[start].view(np.int64), two[start].view(np.int64), np.full(len(start), owner, dtype=np.int64), start + (tag << 32))):
                    columns[k].append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["h1", "h2", "owner", "place"])

    return docs.select("text", "owner", "places", "tag").mapInArrow(run, "h1 long, h2 long, owner long, place long")


def remove_rows(docs: DataFrame, window: int) -> DataFrame:
    """The columns of OUT for docs(doc_id, text, places, copy)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = kept = _raw(text).split()
                if copy and len(words) >= window:
                    kept = []
                elif places.is_valid and not copy:
                    at = places.values.to_numpy()
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.select("doc_id", "text", "places", "copy").mapInArrow(run, OUT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns of OUT, one row per row of docs(doc_id, text).

    A text that an earlier document has whole loses all its windows; of each such text only its first document goes
    through the ladder. A null text has no words, and the sha-256 of nothing. Windows of rows with a null
    doc_id are neither removed nor a reason to remove. Rows that repeat a doc_id are no earlier than each
    other: they only lose what an earlier document has. A text of any length is looked at whole; fewer words than
    `window` make no window. An empty table gives an empty one. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = docs.where("doc_id is not null and text is not null")
    texts = scratch.table(some.select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("text_hash")).distinct(), "texts")
    firsts = scratch.table(texts.groupBy("sha", "text_hash").agg(F.min("doc_id").alias("first")), "firsts")  # written out for the same reason
    marks = scratch.table(texts.join(firsts.hint("merge"), ["sha", "text_hash"]).select("doc_id", "text_hash", (F.col("doc_id") > F.col("first")).alias("copy")), "marks")
    # anchors that stand in two different texts; a text is its own owner here, however many documents have it
    rows = scratch.table(anchor_rows(some.select("text", F.xxhash64("text").alias("owner")), window, gram), "anchors")
    found = scratch.table(repeated(rows, ["gram"], False, scratch, "grams"), "places-of-texts", wait=True)
    scratch.drop("anchors", "grams")
    firsts = marks.where("not copy").select("doc_id", F.col("text_hash").alias("owner"))
    places = scratch.table(found.join(firsts.hint("merge"), "owner").select(F.col("doc_id").alias("at_id"), F.col("owner").alias("at_hash"), "places"), "places")
    own = (F.col("doc_id") == F.col("at_id")) & (F.xxhash64("text") == F.col("at_hash"))
    for k, length in enumerate(ladder(gram, window)):
        found = candidate_rows(some.join(places.hint("shuffle_hash"), own).select("text", F.col("doc_id").alias("owner"), "places", F.col("at_hash").bitwiseAND(TAG).alias("tag")), window, gram, length, k == 0)
        rows = scratch.table(found, f"windows-{length}", wait=True)
        del found
        starts = scratch.table(repeated(rows, ["h1", "h2"], length == window, scratch, f"repeats-{length}"), f"starts-{length}", wait=True)
        scratch.drop(f"windows-{length}", f"repeats-{length}")
        hashes = firsts.select(F.col("doc_id").alias("at_id"), F.col("owner").alias("at_hash"))
        of_text = F.filter("places", lambda x: F.shiftright(x, 32) == F.col("at_hash").bitwiseAND(TAG))
        places = starts.join(hashes.hint("merge"), F.col("owner") == F.col("at_id")).select("at_id", "at_hash", F.transform(of_text, lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int")).alias("places"))
    copies = marks.where("copy").select(F.col("doc_id").alias("at_id"), F.col("text_hash").alias("at_hash"), F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("copy"))
    verdicts = scratch.table(places.withColumn("copy", F.lit(False)).unionByName(copies), "verdicts")
    scratch.drop("texts", "firsts", "marks", "places-of-texts", "places", *(f"starts-{length}" for length in ladder(gram, window)))
    return remove_rows(docs.join(verdicts.hint("shuffle_hash"), own, "left").withColumn("copy", F.coalesce("copy", F.lit(False))), window)


def substring_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
