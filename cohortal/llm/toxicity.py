"""Operator 13, toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases a text, maps look-alike letters and digits to one form (so that `1d10t` and a Cyrillic `о` read
as what they stand for) and cuts it into words. A term is a whole word or the beginning of one. Its weight is the
lower confidence bound of the log ratio of its rates in toxic and in other documents; the evidence must come from
different surroundings, so that copies of one document don't make terms of all its words. A document's
weight, the sum over its words of the heaviest term that matches, is set against its length by a logistic curve of
log weight and log length. The curve is fitted on documents scored with the terms of the other half of the sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.memory import tidy
from cohortal.llm.scratch import Scratch

MOST_ROWS = 20_000  # labelled rows of a class that teach; of more, those of the least hashes, about as many
MOST_TERMS = 4096  # of a lexicon
STEM, LONGEST_STEM, SHORTEST_WORD = 4, 8, 3  # letters
LEAST = 3  # toxic documents, and different surroundings, that a term needs
CERTAIN = 1.64  # standard errors taken off a log ratio
LEAST_WEIGHT = 2.0
THRESHOLD = 0.3
FLUSH = 200_000  # terms that a counting task holds
STEPS = (4, 4)  # bins of the logistic curve's inputs, for each unit of log weight and log length
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "circus clown", "pond scum")
#: Cyrillic and Greek letters and the Latin ones that they look like.
LOOK_ALIKES = dict(zip("асеіјорѕухвкмнтԁԛԝһӏгп" + "αβγεηικνορτυχω", "aceijopsyxbkmhtdqwhlrn" + "abyenikvoptuxw", strict=True))
#: Digits for letters; l and 1 read as i, which they look like.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i", "|": "i"}
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
_SIGN = re.compile(r"(?<=\w)[@$](?=\w)")
_GAP = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, score double, n_words long, n_terms long, weight double"


def _table() -> dict[int, str | None]:
    """Every character that folds: letters of other widths and styles by their compatibility form, then look-alikes, then digits."""
    out: dict[int, str | None] = {}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA)):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if len(plain) == 1 and plain.isascii():
            out[code] = plain
    out |= {ord(k): v for k, v in LOOK_ALIKES.items()}
    out = {k: DIGITS.get(v, v) for k, v in out.items()} | {ord(k): v for k, v in DIGITS.items()}
    return out | dict.fromkeys(INVISIBLE)


_FOLD = _table()


def folded(text: str | None) -> str:
    """The words of a text in one form, each with a space before it, and a space at the end."""
    low = (text or "").lower()
    if "@" in low or "$" in low:
        low = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", low)
    return " " + _GAP.sub(" ", low.translate(_FOLD)).strip() + " "


def terms_of(word: str) -> list[str]:
    """The terms that a word can match: ` word ` for the whole word, ` wor` for its beginnings."""
    out = [f" {word} "] if len(word) >= SHORTEST_WORD else []
    return out + [f" {word[:k]}" for k in range(STEM, min(LONGEST_STEM, len(word)) + 1)]


class Matcher:
    """Weighted terms and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        self.tool = ahocorasick.Automaton()
        for phrase in exceptions:
            known = folded(phrase)
            self.tool.add_word(known, (len(known), None))
        for term, weight in weights.items():
            self.tool.add_word(term, (len(term), weight))
        self.any = len(self.tool) > 0
        if self.any:
            self.tool.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, float]:
        """(words, words with a term, weight): the heaviest term counts for a word; words inside an exception phrase count for nothing."""
        known = folded(text)
        words = known.count(" ") - 1 if len(known) > 2 else 0
        if not words or not self.any:
            return words, 0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight) in self.tool.iter(known):
            at = last + 1 - size
            if weight is None:
                spared.append((at, last))
            elif weight > best.get(at, 0.0):
                best[at] = weight
        for first, last in spared:
            # the phrase's last space is the next word's first
            for at in [k for k in best if first <= k < last]:
                del best[at]
        return words, len(best), math.fsum(best.values())


class Model:
    """A lexicon and the curve of its scores; coefficients: intercept, log weight, log length. None: nothing was learned."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] | None):
        self.weights, self.curve = weights, curve

    def score(self, words: int, weight: float) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        z = a + b * math.log1p(weight) + c * math.log1p(words)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True where the checksum of the id's text leaves 2 when divided by four; false for a null id."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(text, toxic, half): texts of labelled documents outside the held-out fold, each text of a class once.

    Of a class of over `most` labels those whose hash lies below a threshold are taken, about `most`; their number is
    counted before they are broadcast, so that documents aren't shuffled.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = lambda k: int(min(1.0, most / max(1, counts.get(k, 0))) * 2**31)
    rows = known.where(place < F.when(F.col("toxic") == 1, limit(1)).otherwise(limit(0)))
    if rows.count() > 4 * most:
        raise ValueError(f"over {4 * most} labelled rows were drawn")
    rows = F.broadcast(rows.withColumn("half", F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(2)).cast("int")))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(rows, "doc_id")
    return found.groupBy("text", "toxic").agg(F.min("half").alias("half"))


def _counted(rows: DataFrame) -> DataFrame:
    """(term, t0, t1, c0, c1, near): toxic and other documents of each half that have a term, and the surroundings of its
    toxic ones as bits of a word. Tasks count what they read before it is shuffled."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])

        def out() -> pa.RecordBatch:
            near = np.array([v[4] for v in held.values()], dtype=np.uint64).view(np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in range(4)), pa.array(near)], names=["term", "t0", "t1", "c0", "c1", "near"])
            held.clear()
            return made

        for batch in batches:
            for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = folded(text.as_py()).split()
                own: dict[str, int] = defaultdict(int)
                for k, word in enumerate(words):
                    bit = 0
                    if toxic:
                        around = f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"
                        bit = 1 << (_checksum(around) & 63)
                    elif word in own:
                        continue
                    own[word] |= bit
                mine: dict[str, int] = defaultdict(int)
                for word, bits in own.items():
                    for term in terms_of(word):
                        mine[term] |= bits
                at = half if toxic else 2 + half
                for term, bits in mine.items():
                    row = held[term]
                    row[at] += 1
                    row[4] |= bits
                if len(held) >= FLUSH:
                    yield out()
        if held:
            yield out()

    partial = rows.select("text", "toxic", "half").mapInArrow(run, "term string, t0 long, t1 long, c0 long, c1 long, near long")
    return partial.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")), F.bit_or("near").alias("near"))


def _checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def log_ratio(toxic: float, clean: float, all_toxic: int, all_clean: int) -> float:
    """The lower bound of the log ratio of a term's rates."""
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1)) - CERTAIN * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon(counts: Iterable[tuple[str, int, int]], all_toxic: int, all_clean: int) -> dict[str, float]:
    """Weights of the terms of (term, toxic, clean) that are heavy enough; a term goes where a beginning of it weighs as much."""
    found = {t: w for t, a, b in counts if a >= LEAST and (w := log_ratio(a, b, all_toxic, all_clean)) >= LEAST_WEIGHT}
    kept = {t: w for t, w in found.items() if not any(found.get(s, -1.0) >= w for s in terms_of(t.strip()) if s != t and len(s) <= len(t))}
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:MOST_TERMS])


def fitted(cells: Iterable[tuple[float, float, int, int]], rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression on bins (log weight, log length, toxic: 0 or 1, rows), with a small penalty on the slopes."""
    rows = sorted(cells)
    x = np.array([[1.0, w, n] for w, n, _, _ in rows])
    y, m = (np.array([r[k] for r in rows], dtype=float) for k in (2, 3))
    b, penalty = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (m * p * (1 - p))[:, None]) + penalty, x.T @ (m * (y - p)) - penalty @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, b))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, exceptions: Iterable[str] = EXCEPTIONS) -> Model:
    """The model of labels(doc_id, toxic) over docs(doc_id, text).

    Labels of the held-out fold, null ones, those other than 0 and 1, those of a null id and those without a document teach
    nothing, nor do null texts; an empty text teaches its length. Repeated labels and texts of a class count once; long texts count whole. At most about
    `most` labels of a class are used. Without a label of each class nothing is learned, and every score is 0.
    What reaches the driver is the terms of the lexicon and the bins of the curve.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.table(sampled(docs, labels, most), "sample")
    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n = {(x, h): sizes.get((x, h), 0) for x in (0, 1) for h in (0, 1)}
    every = [n[x, 0] + n[x, 1] for x in (0, 1)]
    if not min(every):
        scratch.drop("sample")
        return Model({}, None)
    enough = (F.col("t0") + F.col("t1") >= LEAST) & (F.bit_count("near") >= LEAST)
    loose = F.log((F.col("t0") + F.col("t1") + 0.5) / (F.col("c0") + F.col("c1") + 0.5)) - math.log((every[1] + 1) / (every[0] + 1))  # an upper bound of the weight
    counted = _counted(rows).where(enough & (loose >= LEAST_WEIGHT)).orderBy(F.desc(loose - CERTAIN / F.sqrt(F.col("t0") + F.col("t1"))), "term").limit(16 * MOST_TERMS)
    listed = [(r["term"], r["t0"], r["t1"], r["c0"], r["c1"]) for r in counted.collect()]
    whole = lexicon(((t, a + b, c + d) for t, a, b, c, d in listed), every[1], every[0])
    halves = [lexicon(((x[0], x[1 + h], x[3 + h]) for x in listed), n[1, h], n[0, h]) for h in (0, 1)]
    places = [F.floor(F.log1p(F.col(c)) * s).cast("int").alias(c) for c, s in zip(("weight", "n_words"), STEPS, strict=True)]
    bins = _matched(rows.select("toxic", "half", "text"), halves, exceptions).groupBy(*places, "toxic").agg(F.count("*").alias("n"))
    curve = fitted([((r["weight"] + 0.5 * (r["weight"] > 0)) / STEPS[0], (r["n_words"] + 0.5) / STEPS[1], r["toxic"], r["n"]) for r in bins.collect()])
    scratch.drop("sample")
    return Model(whole, curve)


def _matched(rows: DataFrame, halves: list[dict[str, float]], exceptions: Iterable[str]) -> DataFrame:
    """(toxic, n_words, weight) of rows(toxic, half, text), each matched with the terms of the other half."""
    phrases = tuple(exceptions)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [Matcher(w, phrases) for w in halves]
        for batch in batches:
            found = [tools[1 - half].scan(text.as_py()) for half, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["toxic", "n_words", "weight"])

    return rows.mapInArrow(run, "toxic int, n_words long, weight double")


def score(docs: DataFrame, model: Model, exceptions: Iterable[str] = EXCEPTIONS) -> DataFrame:
    """One row per row of docs(doc_id, text): the columns of SCHEMA, from the whole text alone.

    A null text counts as empty; an empty text gets the score of its length, like any; a text of any length counts
    whole; a null doc_id stays null; repeated rows stay; an empty table gives an empty one. Other columns, whatever
    their names, are not read. Every score is 0 where nothing was learned.
    """
    phrases = tuple(exceptions)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Matcher(model.weights, phrases)
        for batch in batches:
            found = [tool.scan(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([model.score(n, w) for n, _, w in found], pa.float64()), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "n_terms", "weight")
