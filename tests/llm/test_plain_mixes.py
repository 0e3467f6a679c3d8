"""Operators 5 and 8 against plain Python written from their contracts, over whole tables."""

import collections
import math
import re
import zlib

import zstandard

from cohortal.llm import language, mixing
from tests.llm.test_operators import SCHEMA, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Weights 3, 1, 2 in the order of code points, null last; 150 % shared, none above twice its size."""
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in over}


def check_mix(rows, got):
    """got: (doc_id, size, source_size, target, taken, source) of each row."""
    sizes = collections.Counter()
    for source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert collections.Counter(r["size"] for r in got) == collections.Counter(len(WORD.findall(t or "")) for _, t in rows)
    # whole passes and one cut: a source's rows are taken equally often but for one pass, and one row alone is cut
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1
        times = {r["taken"] // r["size"] for r in got if r["source"] == source and r["size"]}
        assert not times or max(times) - min(times) <= 1
        cut = [r for r in got if r["source"] == source and r["size"] and r["taken"] % r["size"]]
        assert len(cut) <= 1


def test_op5_query_and_odd_rows_against_plain_python(spark, sf_dir):
    from cohortal.llm.scratch import Scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    got = mixing.mix_documents(spark, sf_dir).collect()
    assert "source" not in got[0].asDict() and len(got) == len(rows)
    check_mix(list(rows.values()), [r.asDict() | {"source": rows[r["doc_id"]][0]} for r in got])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    odd = documents()
    plan = mixing.plan(spark.createDataFrame(odd, SCHEMA).repartition(4), Scratch(spark, "plain")).collect()
    check_mix([(r[3], r[1]) for r in odd], [r.asDict() for r in plan])


def test_op8_dictionaries_and_whole_table_against_plain_python(spark, sf_dir):
    """What learn() takes comes from labelled rows outside the held-out fold alone, and every prediction again by hand."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    fold = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.learn(frame)
    assert set(found) == {r["lang"] for r in docs if r["lang"] is not None and fold(r) and r["text"]}
    for lang, raw in found.items():
        pieces = {r["text"][k : k + language.SAMPLE_CHARS].lower().encode() for r in docs if r["lang"] == lang and fold(r) and r["text"] for k in range(0, len(r["text"]), language.SAMPLE_CHARS)}
        held = raw
        # the dictionary is whole different pieces, one after the other, each of a training text of the language
        taken = 0
        for piece in sorted(pieces, key=len, reverse=True):
            if b"\n" + piece + b"\n" in b"\n" + held + b"\n":
                taken += 1
        assert len(raw) <= language.DICTIONARY_BYTES and taken > 0
        if sum(map(len, pieces)) + len(pieces) <= language.DICTIONARY_BYTES:
            assert taken == len(pieces) and len(raw) == sum(map(len, pieces)) + len(pieces) - 1
    want = {}
    for r in docs:
        text = r["text"]
        if text is None or not any(c.isalpha() for c in text):
            want[r["doc_id"]] = ("und", 0.0, True)
            continue
        raw, sizes = text.lower().encode(), {}
        for lang, known in found.items():
            tool = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(tool.compress(raw[k : k + language.PIECE])) for k in range(0, len(raw), language.PIECE))
        (a, first), (b, _) = sorted((s, lang) for lang, s in sizes.items())[:2]
        want[r["doc_id"]] = (first, (b - a) / b, (b - a) / b < language.MARGIN)
    got = {r["doc_id"]: r for r in language.language_documents(spark, sf_dir).collect()}
    assert set(got) == set(want)
    right = 0
    for r in docs:
        row, (lang, score, rejected) = got[r["doc_id"]], want[r["doc_id"]]
        assert row["held_out"] == (fold(r) == 0)
        # a compressor prepared beforehand may cut a few bytes otherwise than one that is not
        assert abs(row["score"] - score) < 0.02
        right += row["lang_pred"] == lang and row["rejected"] == rejected
    assert right >= 0.97 * len(docs)
