"""Operator 10, secret scans: base patterns, and entropy in a sliding window over candidate strings.

Candidates are runs of token characters. For each character class (hex digits, base-64) a window of fixed width
slides over the candidate; its Shannon entropy is kept by adding the character that enters and removing the one
that leaves. Windows at or above the class's threshold make a span, unless the allow-list knows the candidate.

A window also needs a few digits: letters alone reach the entropy of a key in ordinary joined words, of which
documents have very many, while a random key of 20 characters without a digit is rare (hex) or has one close by (base-64).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # a cheap test for any run that can pass
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class, its characters, window, least entropy in bits, least number of digits in the window.
CLASSES = (("hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0, 3), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 20, 3.9, 2))
#: Shapes of candidates that are no secrets.
ALLOW = (re.compile(r"[a-z]+(?:[-_/][a-z]+)*"), re.compile(r"[A-Z]+(?:[-_/][A-Z]+)*"), re.compile(r"[0-9]+(?:[-_/=][0-9]+)*"), re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), re.compile(r"(.)\1*"), re.compile(r"(?:https?/*|www|ftp).*"))
RECOUNT = 4096  # steps after which the sum is taken anew
KINDS = ("assign", "access", "hex", "entropy")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind, end) of the base patterns; offsets are code points."""
    out = []
    low = text.encode("utf-8", "replace").lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def window_entropies(text: str, width: int) -> list[float]:
    """Shannon entropy, in bits, of each window of `width` characters, by incremental counts."""
    count: dict[str, int] = {}
    total, out = 0.0, []  # total: the sum of c * log2(c) over the window's counts

    def add(ch: str, by: int) -> None:
        nonlocal total
        old = count.get(ch, 0)
        new = old + by
        total += (new * math.log2(new) if new > 1 else 0.0) - (old * math.log2(old) if old > 1 else 0.0)
        count[ch] = new

    for k, ch in enumerate(text):
        add(ch, 1)
        if k >= width:
            add(text[k - width], -1)
        if k >= width - 1:
            out.append(math.log2(width) - total / width)
        if k % RECOUNT == RECOUNT - 1:  # running sums drift over very long candidates
            total = sum(n * math.log2(n) for n in count.values() if n > 1)
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the merged windows that look random, in candidates that the allow-list doesn't know."""
    out = []
    for m in CANDIDATE.finditer(text):
        found = m[0]
        if any(a.fullmatch(found) for a in ALLOW):
            continue
        spans = []
        for _, chars, width, least, digits in CLASSES:
            start = None
            for k in range(len(found) + 1):  # maximal runs of the class's characters
                if k < len(found) and found[k] in chars:
                    start = k if start is None else start
                elif start is not None:
                    if k - start >= width:
                        run = found[start:k]
                        for j, bits in enumerate(window_entropies(run, width)):
                            if bits >= least and sum(map(str.isdigit, run[j : j + width])) >= digits:
                                spans.append((start + j, start + j + width))
                    start = None
        for s, e in sorted(spans):
            if out and s + m.start() <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e + m.start()))
            else:
                out.append((s + m.start(), e + m.start()))
    return out


def scan(text: str | None) -> tuple[list[int], str, str, int]:
    """Counts of the base kinds, the sha-256 of the base spans, all spans, the number of entropy spans."""
    text = text or ""
    base = base_spans(text)
    found = [(s, 3, e) for s, e in entropy_spans(text)]
    join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(k == n for _, k, _ in base) for n in range(3)], hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + found)), len(found)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the columns of SCHEMA.

    A null or empty text has no spans; a text of any length is scanned whole; a null doc_id stays null; repeated rows
    stay; an empty table gives an empty one. Other columns are not read. Rows are independent: Spark deals them, one text is in memory at a time besides its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            n = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
            rest = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.string()), (2, pa.string()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *n, *rest], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def secret_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
