"""Nearest references against brute force, and the blocks that bounds leave out."""

import random

import numpy as np
import pyarrow as pa

from cohortal.operators import nearest


def frame(spark, sets):
    return spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "item long, bit int")


def brute(sets, queries, references):
    return {k: max((len(sets[k] & sets[j]) / len(sets[k] | sets[j]) for j in references if j != k), default=0.0) for k in queries}


def fingerprints(seed, items, families, bits=400):
    """Sparse sets in families that share most of their bits, of sizes from a few bits to many."""
    rnd = random.Random(seed)
    heads = [rnd.sample(range(bits), rnd.choice([6, 15, 40, 90])) for _ in range(families)]
    out = {}
    for k in range(items):
        head = rnd.choice(heads)
        out[k] = set(rnd.sample(head, max(1, int(len(head) * 0.9)))) | set(rnd.sample(range(bits), rnd.randint(0, 2)))
    return out


def test_search_leaves_out_blocks_and_loses_nothing(spark):
    sets = fingerprints(3, 600, 12)
    df = frame(spark, sets)
    got, met, blocks = nearest.search(df.where("item % 5 = 0"), df.where("item % 5 <> 0"), 24)
    want = brute(sets, [k for k in sets if k % 5 == 0], [k for k in sets if k % 5])
    assert {r["item"]: r["nearest"] for r in got.collect()} == want
    met = met.collect()
    query_blocks = len({r["qb"] for r in met})
    assert blocks >= 15 and query_blocks >= 5 and len(met) < 0.6 * blocks * query_blocks
    assert len(set((r["qb"], r["rb"]) for r in met)) == len(met) and sum(r["queries"] for r in met) < 0.5 * 120 * blocks


def test_search_of_a_table_with_itself_and_repeats(spark):
    sets = fingerprints(4, 60, 3)
    sets[60] = set(sets[0])  # a copy
    sets[61] = {9999}  # nothing in common with any
    df = frame(spark, sets)
    got = {r["item"]: r["nearest"] for r in nearest.nearest_similarity(df.union(df), df, 7).collect()}
    assert got == brute(sets, sets, sets) and got[0] == got[60] == 1.0 and got[61] == 0.0


def test_pages_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PAGE", 3)
    sets = fingerprints(5, 120, 4)
    df = frame(spark, sets)
    got = {r["item"]: r["nearest"] for r in nearest.nearest_similarity(df, df, 8).collect()}
    assert got == brute(sets, sets, sets)


def test_empty_sides(spark):
    df, none = frame(spark, {1: {1, 2}}), frame(spark, {1: {1}}).limit(0)
    assert nearest.nearest_similarity(none, df).count() == 0
    assert [tuple(r) for r in nearest.nearest_similarity(df, none).collect()] == [(1, 0.0)]
    assert [tuple(r) for r in nearest.nearest_similarity(df, df).collect()] == [(1, 0.0)]


def test_bounds_hold_for_every_item_of_a_block():
    rnd = np.random.default_rng(6)
    for _ in range(200):
        block = [set(rnd.choice(20, rnd.integers(1, 15), replace=False).tolist()) | {3} for _ in range(4)]
        q = set(rnd.choice(20, rnd.integers(1, 15), replace=False).tolist())
        lists = lambda *s: pa.array([sorted(x) for x in s], pa.list_(pa.int64()))
        sizes = [len(b) for b in block]
        bound = nearest._bounds(lists(q), np.array([min(sizes)]), np.array([max(sizes)]), lists(set.union(*block)), lists(set.intersection(*block)))[0, 0]
        assert bound >= max(len(q & b) / len(q | b) for b in block)


def test_group_nearest(spark):
    near = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.9), (4, 1.0)], "item long, nearest double")
    groups = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b")], "item long, grp string")
    got = {r["grp"]: (r["minimum"], r["median"], r["maximum"]) for r in nearest.group_nearest(near, groups).collect()}
    assert got == {"a": (0.2, 0.4, 0.9), "b": (1.0, 1.0, 1.0)}
