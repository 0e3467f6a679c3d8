"""Operator 8, language ID by compression: the language whose dictionary packs a text smallest.

Each language's dictionary is the lower-cased text of a bounded sample of pieces of labelled documents, from
everywhere in them. A text is cut into pieces, so that a dictionary counts all along a long text, and every piece
is compressed with every dictionary; sizes add up over the text. Where the two smallest totals lie close together
the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy

DICTIONARY_BYTES = 256 * 1024  # of a language's dictionary, which bounds the sample
SAMPLE_CHARS = 512  # of a sampled piece of a document
SPARE = 3  # so many times the pieces that fill a dictionary are drawn, as some repeat
LANGUAGES = 200  # at most; more is an error
PIECE = 4096
LEVEL = 6
MARGIN = 0.02  # of the second smallest size; on a split of the training rows 99.5 % of right answers lie above 0.07, most wrong ones below 0.02
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True where the checksum of the id's text is divisible by five; false for a null id."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language of docs(doc_id, text, lang), from rows outside the held-out fold.

    Rows with a null doc_id, text or lang, or an empty text, teach nothing; rows that repeat teach once. All labelled
    texts are cut into pieces of SAMPLE_CHARS characters; those whose hash lies below a threshold, which follows
    from the number of pieces of the language, are the sample: about SPARE dictionaries' worth of bytes, which is all
    that reaches the driver. In the order of the hash, whole pieces fill the dictionary to DICTIONARY_BYTES.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    many = F.ceil(F.length("text") / SAMPLE_CHARS).cast("int")
    counts = {r["lang"]: (r["n"], r["b"]) for r in known.groupBy("lang").agg(F.sum(many).alias("n"), F.sum(F.octet_length("text")).alias("b")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not counts:
        return {}
    share = {lang: min(1.0, SPARE * DICTIONARY_BYTES / total) for lang, (_, total) in counts.items()}
    limit = F.element_at(F.map_from_arrays(F.array(*map(F.lit, share)), F.array(*(F.lit(int(x * 2**31)) for x in share.values()))), F.col("lang"))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), k), F.lit(2**31))
    at = F.filter(F.sequence(F.lit(0), many - 1), lambda k: place(k) < F.col("limit"))
    drawn = known.select("lang", "text", "doc_id", limit.alias("limit")).select("lang", "text", "doc_id", F.explode(at).alias("k"))
    rows = drawn.select("lang", place(F.col("k")).alias("place"), F.substring("text", F.col("k") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)).alias("text")).distinct().collect()
    out: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(rows):
        out.setdefault(lang, []).append(text.lower().encode("utf-8", "replace"))
    return {lang: _filled(parts) for lang, parts in sorted(out.items())}


def _filled(parts: list[bytes]) -> bytes:
    """Different pieces one after the other, as many as fit; one at least."""
    held, size = [], 0
    for part in dict.fromkeys(parts):
        if held and size + len(part) + 1 > DICTIONARY_BYTES:
            break
        held.append(part)
        size += len(part) + 1
    return b"\n".join(held)


_ready: dict[tuple, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = tuple(sorted(dictionaries.items()))
    if key not in _ready:
        _ready.clear()
        made = []
        for lang, raw in sorted(dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _ready[key] = made
    return _ready[key]


def classify(text: str | None, tools: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected). A tie goes to the first language by name, and is rejected."""
    if not tools or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode("utf-8", "replace")
    sizes = [sum(len(tool.compress(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)) for _, tool in tools]
    best = min(range(len(tools)), key=sizes.__getitem__)
    if len(tools) == 1:
        return tools[0][0], 1.0, False
    second = min(s for k, s in enumerate(sizes) if k != best)
    margin = (second - sizes[best]) / second
    return tools[best][0], min(1.0, max(0.0, margin)), margin < MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row per row of docs(doc_id, text): the columns of SCHEMA, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text where nothing
    was learned. A text of any length counts whole. A null doc_id stays null; repeated rows stay; an empty table
    gives an empty one. Other columns are not read.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(dictionaries)
        for batch in batches:
            rows = [classify(t.as_py(), tools) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of docs whose language is known; all columns stay. The decision is made in the scan itself.

    Rows are judged as in predict(); repeated ones alike. An empty table stays empty.
    """
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(dictionaries)
        for batch in batches:
            yield batch.filter(pa.array([not classify(t.as_py(), tools)[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def language_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
