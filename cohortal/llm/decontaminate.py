"""Operator 9, benchmark decontamination: edit matching by the pigeonhole principle.

Item and document are compared with A-Z lower-cased and white space as single spaces. An item with
a budget of e edits is split into e + 1 pieces: if a passage is within e edits of it, one piece stands there
unchanged. An Aho-Corasick automaton over all pieces scans each whole document once; at each hit the passage
that the piece's place allows is verified with Myers' bit-parallel edit distance.

Items are the query set. They are broadcast in blocks of at most BLOCK_CHARS characters, one pass over the
documents each, so that what is sent to tasks is bounded however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy

EDIT_SHARE = 16  # one edit is allowed for so many characters
LEAST_EDITS = 1
LEAST_ITEM = 24  # characters; shorter items would match by chance and are looked up unchanged
BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id long, item_id long, distance int, end long"


def normal(text: str | None) -> str:
    """A-Z lower-cased; white space as single spaces, none at the ends."""
    # bytes know ASCII letters and white space only
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def budget(item: str) -> int:
    return max(LEAST_EDITS, len(item) // EDIT_SHARE) if len(item) >= LEAST_ITEM else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 parts of nearly equal length."""
    n = edits + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(item):
        out[ch] |= 1 << k
    return dict(out)


def myers(mask: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern from a substring of text, and where it ends first."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for k, ch in enumerate(text):
        eq = mask.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def _joined(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a text in order, overlapping ones as one: no character is verified twice."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            if not (known := normal(text)):
                continue
            edits = budget(known)
            for offset, piece in pieces(known, edits):
                at[piece].append((len(self.items), offset))
            self.items.append((item_id, known, edits, masks(known)))
        self.tool = ahocorasick.Automaton()
        for piece, places in at.items():
            self.tool.add_word(piece, (len(piece), places))
        if at:
            self.tool.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the items that a passage of text matches; the closest passage of each."""
        doc = normal(text)
        if not doc or not self.items:
            return []
        windows: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for last, (size, places) in self.tool.iter(doc):
            for k, offset in places:
                _, known, edits, _ = self.items[k]
                start = last + 1 - size - offset
                windows[k].add((max(0, start - edits), min(len(doc), start + len(known) + edits)))
        out = []
        for k, spans in windows.items():
            item_id, known, edits, mask = self.items[k]
            best = (edits + 1, 0)
            for a, b in _joined(spans):
                at = doc.find(known, a, b)
                distance, end = (0, at - a + len(known)) if at >= 0 else myers(mask, len(known), doc[a:b])
                best = min(best, (distance, a + end))
                if not best[0]:
                    break
            if best[0] <= edits:
                out.append((item_id, *best))
        return sorted(out)


_ready: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[int, str]]) -> Matcher:
    key = tuple(items)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Matcher(items)
    return _ready[key]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, text) of at most BLOCK_CHARS characters, streamed from the benchmark table."""
    block, held = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((int(r["item_id"]), r["text"]))
        held += len(r["text"])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end): each item that a passage of a row of docs(doc_id, text) comes from.

    distance is the least edit distance over the passages found, end where the first such one ends in the
    normalized text. A null or empty text or item matches nothing; a text of any length is scanned whole; a null
    doc_id stays null; repeated rows each report; an empty table gives an empty one. Other columns are not read.
    """

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = _matcher(items)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], *hit) for k, text in enumerate(batch.column(1)) for hit in tool.find(text.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "end"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

    out = None
    for block in item_blocks(benchmark):
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay. The decision is made in the scan itself.

    A null or empty text holds no item and stays; repeated rows are judged alike; an empty table stays empty.
    """
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")
    out = docs
    for block in item_blocks(benchmark):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], items=block) -> Iterator[pa.RecordBatch]:
            tool = _matcher(items)
            for batch in batches:
                yield batch.filter(pa.array([not tool.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def leaked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
