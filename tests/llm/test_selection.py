"""Operators 11 to 13 against plain Python on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.llm import importance, negatives, toxicity
from tests.llm.test_operators import SCHEMA, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TARGET = ["one two words prose", "ÉTÉ été \x00 Two-words", None, "", "abc abc " * 50]


def plain_resample(rows, target, percent, least, grams, buckets, seed):
    def feats(text):
        w = WORD.findall((text or "").translate(UPPER))
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    have, want = collections.Counter(), collections.Counter()
    found = []
    for doc_id, text in rows:
        w, f = feats(text)
        have.update(f)
        found.append((doc_id, len(w), f))
    for text in target:
        want.update(feats(text)[1])
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log(((want[b] + 1) * float(s_all + buckets)) / ((have[b] + 1) * float(t_all + buckets)))) for b in range(buckets)]
    out, able = [], []
    for k, (doc_id, n_words, f) in enumerate(found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n_words >= least:
                able.append((-score, doc_id, len(f), k))
        out.append([doc_id, len(f), weight, score, None])
    for rank, (*_, k) in enumerate(sorted(able)[: int(percent * len(able) // 100)], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("percent", "least", "grams", "buckets"), [(10, 20, 1, 10_000), (50, 1, 2, 97), (100, 0, 3, 13), (0.5, 20, 1, 10)])
def test_op11_against_plain_python(spark, percent, least, grams, buckets):
    rows = [(r[0], r[1]) for r in documents()]
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(docs, target, percent, least, grams, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resample(rows, TARGET, percent, least, grams, buckets, 2024)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_op11_hot_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(7, text)] * 300 + [(7, text + " w25")] * 40 + [(k, text) for k in range(100, 200)] + [(None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    for percent in (10, 30, 73, 95):
        got = sorted((tuple(r) for r in importance.resample(docs, target, percent).collect()), key=str)
        assert got == plain_resample(rows, ["w1 w2"], percent, 20, 1, 10_000, 2024)
    empty = spark.createDataFrame([], "doc_id long, text string, score string")
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(docs, empty).count() == len(rows)
    kept = importance.draw(docs.withColumn("rank", F.lit("x")), target)
    assert "_rank" in kept.columns and {r["rank"] for r in kept.collect()} == {"x"}


def test_op11_bisection(spark):
    rnd = random.Random(4)
    values = [rnd.choice([-5, 0, 3, 3, 3, 900, 10**12, rnd.randint(-1000, 1000)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for descending in (False, True):
        order = sorted(values, reverse=descending)
        for need in (1, 2, 57, 200, 399, 400):
            cut, before = importance.bisect(df, "x", need, descending)
            assert cut == order[need - 1] and before == order.index(cut)


def plain_negatives(rows, label, every=50, near=5, hard=3):
    good = sorted({(i, label(i, x), tuple(math.floor(256 * float(c)) for c in v)) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, own, a in good:
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=False)), j, x) for j, x, b in good if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == own)[:near]:
            fit = sorted(x for x in scored if x[2] != own and 50 * -s <= 100 * -x[0] <= 95 * -s)[:hard]
            out += [(i, j, k, m, -s, -n) for k, (n, m, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, width, seed, labels=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, width))
    return [(k, [float(np.float32(x)) for x in (centres[k % labels] + rnd.normal(size=width)) / 4], int(rnd.integers(0, labels)) if k % 3 else k % labels) for k in range(n)]


@pytest.mark.parametrize("block", [None, 60])
def test_op12_against_plain_python(spark, block):
    rows = vectors(500, 12, 3)
    rows += [(1000 + k, rows[4][1], k % 3) for k in range(150)]  # one very common vector, ties in score
    rows += [rows[50], rows[50], (50, rows[1][1], 2)]  # copies of an anchor, and another row of its id
    rows += [(1900, None, 1), (1950, [None] * 12, 1), (2000, [float("nan")] * 12, 1), (2050, [float("inf")] + [0.0] * 11, 1), (2100, [0.0] * 12, 1), (2150, rows[3][1], None), (None, rows[3][1], 1), (2200, rows[3][1][:5], 1), (2250, [], 2)]
    df = spark.createDataFrame([(*r, "text", "x") for r in rows], "vec_id long, embedding array<float>, label int, rank string, key string").repartition(3)
    got = sorted(tuple(r) for r in negatives.mine(df, every=50, block=block).collect())
    assert got == plain_negatives(rows, lambda _, x: x) and len(got) > 30


def test_op12_query_labels_and_empty_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    want = plain_negatives(rows, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)
    assert sorted(tuple(r) for r in negatives.mined_embeddings(spark, sf_dir).collect()) == want
    assert negatives.mine(table.limit(0)).count() == 0
    assert negatives.mine(table.where("vec_id % 50 <> 0")).count() == 0
    with pytest.raises(ValueError, match="exact"):
        negatives.mine(table.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e9).cast("float"))))


def test_op12_reading_keeps_every_answer():
    rnd = np.random.default_rng(9)
    for kind in (np.float32, np.float64):
        for trial in range(30):
            width, n = int(rnd.integers(1, 20)), int(rnd.integers(1, 80))
            columns, q = rnd.integers(-40, 40, (width, n)).astype(kind), rnd.integers(-40, 40, (3, width)).astype(kind)
            reading = negatives.Reading(q, columns)
            for a in range(3):
                exact = (q[a].astype(np.int64) @ columns.astype(np.int64)).tolist()
                able = rnd.random(n) < 0.8
                low = [float(x) for x in rnd.integers(-900, 900, 2)]
                high = [x + float(rnd.integers(0, 900)) for x in low]
                floor = [float("-inf"), low[1] + 30]
                places, scores = reading.resolve(a, able, low, high, floor, 3)
                want = set()
                for lo, hi, fl in zip(low, high, floor, strict=True):
                    want |= {p for _, p in sorted((-s, p) for p, s in enumerate(exact) if able[p] and max(lo, fl) <= s <= hi)[:3]}
                assert set(places.tolist()) == want and [exact[p] for p in places] == scores.tolist(), trial


def test_op13_folding_and_terms():
    assert toxicity.folded("1d10t!") == toxicity.folded("IDIOT") == toxicity.folded("іdіоt") == toxicity.folded("ｉｄｉｏｔ") == toxicity.folded("id​iot") == " idiot "
    assert toxicity.folded("l0s3r") == toxicity.folded("1o$er") == toxicity.folded("loser")
    assert toxicity.folded(None) == toxicity.folded(" -- ") == "  "
    assert toxicity.folded("Été_à 5") == " été à s "
    tool = toxicity.Matcher({" idio": 2.0, " idiot ": 5.0, " trash ": 3.0}, ["trash can"])
    assert tool.scan("An idiot, idiotic 1D10T.") == (4, 3, 12.0)
    assert tool.scan("trash can trash cannot") == (4, 1, 3.0)
    assert tool.scan("trash can can trash") == (4, 1, 3.0)
    assert tool.scan("pidiot xtrash") == (2, 0, 0.0) and tool.scan("") == tool.scan(None) == (0, 0, 0.0)
    assert toxicity.Matcher({}, []).scan("a b") == (2, 0, 0.0)
    assert toxicity.terms_of("ab") == [] and toxicity.terms_of("scum") == [" scum ", " scum"]


def labelled(n=900, seed=8):
    rnd = random.Random(seed)
    common = ["".join(rnd.choice("abcdegmnoprstu") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zikruf", "zikruk", "wexol"]
    docs, labels = [], []
    for k in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(3, 60))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "en", "a"]))
        docs.append((k, " ".join(words), "en", "toxic"))
        labels.append((k, toxic, 1))
    copied = " ".join("qx" + "".join(rnd.choice("bcdefghkmnpr") for _ in range(9)) for _ in range(30))
    docs += [(n + k, f"{copied} {k}", "en", "s") for k in range(40)] + [(5000, "", "en", "s"), (5001, None, None, None), (5002, None, None, None), (None, "zikruf", None, None), docs[0], docs[0]]
    labels += [(n + k, 1, 1) for k in range(40)] + [(5000, 0, 1), (5001, 1, 1), (None, 1, 1), (7, None, 1), (8, 3, 1), labels[0], labels[0]]
    return docs, labels


def plain_learn(docs, labels):
    """The whole lexicon again, without Spark: documents that have a term, different surroundings, the bound of the ratio."""
    known = {(i, x) for i, x, _ in labels if i is not None and x in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {(t, x) for i, t, *_ in docs if t is not None for x in (0, 1) if (i, x) in known}
    n = [sum(x == k for _, x in texts) for k in (0, 1)]
    have, near = [collections.Counter(), collections.Counter()], collections.defaultdict(set)
    for t, x in texts:
        w = ["", *toxicity.folded(t).split(), ""]
        have[x].update({term for word in w[1:-1] for term in toxicity.terms_of(word)})
        if x:
            for k in range(1, len(w) - 1):
                for term in toxicity.terms_of(w[k]):
                    near[term].add(zlib.crc32(f"{w[k - 1]} {w[k + 1]}".encode()) % 64)
    weigh = lambda a, b: math.log((a + 0.5) / (n[1] + 1) / ((b + 0.5) / (n[0] + 1))) - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    found = {t: w for t, a in have[1].items() if a >= 3 and len(near[t]) >= 3 and (w := weigh(a, have[0][t])) >= 2}
    return {t: w for t, w in found.items() if not any(s != t and found.get(s, -1) >= w for s in [t[:k] for k in range(5, len(t.rstrip()) + 1)])}


def test_op13_against_plain_python(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(3)
    lf = spark.createDataFrame(labels, "doc_id long, toxic int, quality int").repartition(2)
    model = toxicity.learn(df, lf)
    want = plain_learn(docs, labels)
    assert set(model.weights) == set(want) and all(abs(model.weights[t] - w) < 1e-9 for t, w in want.items())
    assert any(t.startswith(" zikr") for t in want) and sum(t.startswith(" qx") for t in want) <= 1
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs)
    tool = toxicity.Matcher(want)
    at = {r["doc_id"]: r for r in got}
    truth = {i: x for i, x, _ in labels}
    hits = [0, 0, 0]
    for i, text, *_ in docs:
        words, n, weight = tool.scan(text)
        row = at[i]
        assert (row["n_words"], row["n_terms"]) == (words, n) and abs(row["weight"] - weight) < 1e-6
        assert abs(row["score"] - 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(weight) + model.curve[2] * math.log1p(words))))) < 1e-9
        if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2:
            hits[0 if truth[i] != (row["score"] >= 0.3) else 1] += 1
    assert hits[0] <= 0.01 * sum(hits)


def test_op13_curve():
    rnd = np.random.default_rng(2)
    cells = []
    for w in range(0, 12):
        for n in range(1, 12):
            m = int(rnd.integers(20, 60))
            p = 1 / (1 + math.exp(-(-2 + 1.1 * w - 0.6 * n)))
            ones = int(rnd.binomial(m, p))
            cells += [(float(w), float(n), 1, ones), (float(w), float(n), 0, m - ones)]
    b = toxicity.fitted(cells)
    x = np.array([[1.0, c[0], c[1]] for c in cells])
    p = 1 / (1 + np.exp(-x @ np.array(b)))
    slope = x.T @ (np.array([c[3] for c in cells]) * (np.array([c[2] for c in cells]) - p)) - np.array([1e-6, 1e-2, 1e-2]) * np.array(b)
    assert np.abs(slope).max() < 1e-6 and abs(b[1] - 1.1) < 0.2 and abs(b[2] + 0.6) < 0.2
    assert all(math.isfinite(v) for v in toxicity.fitted([(0.0, 1.0, 0, 50), (5.0, 1.0, 1, 50)]))


def test_op13_nothing_to_learn_and_bounded_samples(spark):
    docs, labels = labelled(400)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    lf = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    for some in (lf.limit(0), lf.where("toxic = 1"), lf.where("toxic = 0")):
        scores = {r["score"] for r in toxicity.score(df, toxicity.learn(df, some)).collect()}
        assert scores == {0.0}
    assert toxicity.score(df.limit(0), toxicity.learn(df.limit(0), lf)).count() == 0
    rows = toxicity.sampled(df, lf, 60).groupBy("toxic").count().collect()
    assert all(25 <= r["count"] <= 110 for r in rows) and len(rows) == 2
    assert toxicity.sampled(df, lf).where("text is null").count() == 0


def test_op13_query(spark, sf_dir):
    found = toxicity.toxic_documents(spark, sf_dir)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
