"""The pipeline, stage by stage, against plain Python over what the stage before kept."""

import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

from cohortal.llm import decontaminate, language, mixing, tokens
from tests.llm.test_operators import brute_components, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    from cohortal.llm.scratch import Scratch

    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"s{k}")
        out.append(docs)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage(stages):
    tools = language._compressors(language.learn(stages[0]))
    assert rows(stages[1]) == [r for r in rows(stages[0]) if not language.classify(r[1], tools)[2]]
    assert len(rows(stages[1])) >= 0.95 * len(rows(stages[0]))


def test_near_dedup_stage(stages):
    kept = {r[0] for r in brute_components(rows(stages[1]), 80) if r[3]}
    assert rows(stages[2]) == [r for r in rows(stages[1]) if r[0] in kept]


def test_decontamination_stage(spark, sf_dir, stages):
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r[0] for r in rows(stages[2])} - {r[0] for r in rows(stages[3])}
    for r in rows(stages[2]):
        if any(i in decontaminate.normal(r[1]) for i in items):
            assert r[0] in gone
    masks = [(i, decontaminate.masks(i)) for i in items]
    for r in rows(stages[2]):
        if len(r[1]) < 1500:
            near = any(decontaminate.myers(m, len(i), decontaminate.normal(r[1]))[0] <= decontaminate.budget(i) for i, m in masks)
            assert near == (r[0] in gone)


def test_mixing_stage(stages):
    sizes, taken = {}, {}
    for r in rows(stages[3]):
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    for r in rows(stages[4]):
        taken[r[3]] = taken.get(r[3], 0) + len(WORD.findall(r[1]))
    for s, want in mixing.targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 1
    texts = {r[0]: r[1] for r in rows(stages[3])}
    for r in rows(stages[4]):
        assert r[1] == texts[r[0]] or WORD.findall(texts[r[0]])[: len(r[1].split(" "))] == r[1].split(" ")


def test_token_stage(stages):
    tool = tokens.Encoder(tokens.tokenizer_path())
    want = []
    for r in rows(stages[4]):
        ids = np.array(tool.tool.encode(r[1], add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    found = stages[5].orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(want)
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in found)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]


def test_near_dedup_stage_from_80_percent(spark):
    """Two changed words: of 93 words 79 of 99 shingles are shared (0.798), of 94 words 80 of 100, of 100 words 86 of 106 (0.811)."""
    import corpus_pipeline

    rnd, rows, want = random.Random(4), [], set()
    for k in range(0, 120, 2):
        n = (93, 94, 100)[k // 2 % 3]
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
        rows.append((k, " ".join(words)))
        words[20], words[60] = f"x{k}", f"y{k}"
        rows.append((k + 1, " ".join(words)))
        want |= {k, k + 1} if n == 93 else {k}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == want


def test_near_dedup_stage_on_documents(stages):
    """Against every pair of 0.8 or more."""
    sets = [(r[0], shingles(r[1])) for r in rows(stages[1])]
    least = {d: d for d, _ in sets}
    pairs = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and a is not None and b is not None and 100 * len(s & t) >= 80 * len(s | t)]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    assert rows(stages[2]) == [r for r in rows(stages[1]) if r[0] is None or least[r[0]] == r[0]]
