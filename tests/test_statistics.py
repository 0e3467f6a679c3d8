"""Sums of products, resampling, concordance and pair quantiles against plain Python, in tasks and dealt by range."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import gram, linear, margins, metrics, ordering, resampling, studies
from cohortal.plans import bindings as B
from cohortal.plans import queries as Q


def rows_of(seed=1, sizes=(1, 2, 7, 40, 90), ties=True):
    rnd = random.Random(seed)
    out = []
    for g, n in enumerate(sizes):
        for k in range(n):
            y, p = rnd.gauss(0, 1), rnd.gauss(0, 1)
            if ties:
                y, p = round(y * 2) / 2, round((p + y) * 3) / 3
            out.append((f"g{g}", 1000 * g + k, y, p))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "grp string, item long, label double, prediction double").repartition(parts)


def by_group(rows):
    out = {}
    for g, *r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if r[1] is not None and r[2] is not None:
            out.setdefault(g, []).append(r)
    return out


def right(a, b):
    product = (a[1] - b[1]) * (a[2] - b[2])
    return 1.0 if product > 0 else 0.5 if product == 0 else 0.0


@pytest.mark.parametrize("most", [10**6, 0])
def test_rank_metrics_against_pairs(spark, monkeypatch, most):
    """Equal labels count 1/2 and stay among the pairs, in one task a group and dealt by range."""
    monkeypatch.setattr(ordering, "MOST_LOCAL", most)
    rows = rows_of() + [("g3", 9001, None, 1.0), ("g3", 9002, 0.5, None), (None, 1, 1.0, 2.0), (None, 2, 1.0, 1.0), ("same", 1, 3.0, 1.0), ("same", 2, 3.0, 2.0)]
    df = frame(spark, rows)
    want = {g: np.mean([right(a, b) for a, b in itertools.combinations(r, 2)]) if len(r) > 1 else None for g, r in by_group(rows).items()}
    for mode in ("tie_aware", "keep_ties"):
        got = {r["grp"]: r for r in metrics.rank_metrics(df, mode, most).collect()}
        assert set(got) == set(want)
        for g, value in want.items():
            assert (got[g]["concordance"] is None) if value is None else abs(got[g]["concordance"] - value) < 1e-12
        assert got["same"]["concordance"] == 0.5 and got["same"]["pearson"] is None and got[None]["concordance"] == 0.5
        own = by_group(rows)["g4"]
        y, p = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        assert abs(got["g4"]["pearson"] - np.corrcoef(y, p)[0, 1]) < 1e-9
        assert abs(got["g4"]["spearman"] - np.corrcoef(resampling.ranks(y), resampling.ranks(p))[0, 1]) < 1e-9
        first = p == p.min()
        assert abs(got["g4"]["top1"] - (first & (y == y.min())).sum() / first.sum()) < 1e-12
    assert {r["grp"]: r["concordance"] for r in metrics.concordance(df).collect()} == pytest.approx({g: v for g, v in want.items() if v is not None})
    strict = {r["grp"]: r for r in metrics.rank_metrics(df, "drop_undefined", most).collect()}
    assert "same" not in strict and "g0" not in strict and abs(strict["g4"]["concordance"] - want["g4"]) < 1e-12


@pytest.mark.parametrize(("most", "listed", "sample", "ties"), [(10**6, 100_000, 20_000, True), (10**6, 12, 50, True), (0, 300, 200, False), (10**6, 5, 30, False)])
def test_margin_bins_against_pairs(spark, monkeypatch, most, listed, sample, ties):
    monkeypatch.setattr(ordering, "MOST_LOCAL", most)
    monkeypatch.setattr(margins, "LISTED", listed)
    monkeypatch.setattr(margins, "SAMPLE", sample)
    rows = rows_of(5, (1, 3, 30, 60), ties) + [("g2", 7777, None, 0.3)]
    pairs = [(abs(a[2] - b[2]), right(a, b)) for r in by_group(rows).values() for a, b in itertools.combinations(r, 2)]
    edges = np.quantile([m for m, _ in pairs], np.linspace(0, 1, 6))
    want = []
    for k in range(5):
        own = [(m, ok) for m, ok in pairs if m >= edges[k] and (m <= edges[5] if k == 4 else m < edges[k + 1])]
        if own:
            want.append((k, edges[k], edges[k + 1], len(own), np.mean([m for m, _ in own]), np.mean([ok for _, ok in own])))
    got = sorted(tuple(r) for r in margins.margin_bins(frame(spark, rows)).collect())
    assert [g[:1] + g[3:4] for g in got] == [w[:1] + w[3:4] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-9)


def test_margin_bins_of_one_value_and_of_nothing(spark):
    df = frame(spark, [("a", k, float(k), 2.5) for k in range(20)])
    assert [tuple(r) for r in margins.margin_bins(df).collect()] == [(4, 0.0, 0.0, 190, 0.0, 0.5)]
    assert margins.margin_bins(df.limit(1)).count() == margins.margin_bins(df.limit(0)).count() == 0


def test_cutoffs_are_the_least_values_within_a_difference():
    rnd = np.random.default_rng(3)
    values = np.concatenate((rnd.normal(size=200) * 10.0 ** rnd.integers(-8, 8, 200), [0.0, -0.0, 1e300, -1e-300]))
    differences = [0.0, 1e-12, 0.1, 7.0, 1e9]
    x = margins.cutoffs(values, differences)
    for k, t in enumerate(differences):
        assert ((values - x[:, k]) <= t).all() and ((values - np.nextafter(x[:, k], -np.inf)) > t).all()


def test_pairs_of_large_groups(spark):
    rows = rows_of(2, (50, 3, 1))
    got = sorted((r["grp"], r["item_a"], r["item_b"]) for r in metrics.pairs(frame(spark, rows), block=8).collect())
    assert got == sorted((g, a[0], b[0]) for g, r in by_group(rows).items() for a, b in itertools.combinations(r, 2))


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    rows = [(f"g{k:03d}", float(k % 7), float(1 + k % 3), float(k % 5)) for k in range(300)] + [("none", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "grp string, e double, n double, other double")
    for settings in ({}, {"weight": "n"}, {"weight": "n", "root": True}, {"weight": "n", "root": True, "versus": "other"}):
        a, b = (resampling.bootstrap_ci(df.repartition(p), "e", 60, **settings).first() for p in (1, 7))
        assert a == b and a["low"] <= a["estimate"] <= a["high"] and a["replicates"] == 60
    v, n, o = (np.array([r[k] for r in rows[:-1]]) for k in (1, 2, 3))
    assert abs(a["estimate"] - (np.sqrt(v.sum() / n.sum()) - np.sqrt(o.sum() / n.sum()))) < 1e-12
    sums = resampling.bootstrap_sums(df.where("e is not null").withColumn("one", F.lit(1.0)), ["one", "e"], 40, 3, block=50).collect()
    assert {r["one"] for r in sums} == {300.0} and len({r["e"] for r in sums}) > 20
    # the draws of a replicate again: six blocks by hash, one split, then each block's own
    block = {r["grp"]: (r["b"], r["e"]) for r in df.where("e is not null").select("grp", "e", F.pmod(F.xxhash64("grp"), F.lit(6)).alias("b")).collect()}
    sizes = [sum(b == k for b, _ in block.values()) for k in range(6)]
    for r in sums[:5]:
        many = resampling.split_draws(300, sizes, r["rep"], 3)
        want = sum(resampling.block_draws(int(many[k]), sizes[k], k, r["rep"], 3) @ np.array([e for _, (b, e) in sorted(block.items()) if b == k]) for k in range(6))
        assert abs(want - r["e"]) < 1e-9 and many.sum() == 300


def test_permutation_null_in_tasks_and_by_range(spark, monkeypatch):
    rows = rows_of(7, (1, 5, 30, 60)) + [("flat", k, 1.0, float(k)) for k in range(4)] + [("g1", 555, None, 1.0)]
    df = frame(spark, rows)
    h = {r["item"]: r["h"] for r in df.select("item", F.xxhash64(F.lit(11), "item").alias("h")).collect()}
    nulls = {0: [], 1: []}
    for r in by_group(rows).values():
        y, p = np.array([x[1] for x in r]), np.array([x[2] for x in r])
        keys = np.array([h[x[0]] for x in r], dtype=np.int64)
        for k, (a, b) in enumerate(((y, p), (resampling.ranks(y), resampling.ranks(p)))):
            if len(set(a)) > 1 and len(set(b)) > 1:
                orders = [np.argsort(resampling.replicate_hashes(keys, np.array([rep]))[0], kind="stable") for rep in range(25)]
                nulls[k].append([np.corrcoef(a, b)[0, 1], *(np.corrcoef(a[o], b)[0, 1] for o in orders)])
    for whole in (100_000, 20):
        if whole == 20:
            monkeypatch.setattr(ordering, "MOST_LOCAL", 0)
        got = resampling.permutation_null(df, 25, whole=whole).collect()
        assert [r["correlation"] for r in got] == ["pearson", "spearman"]
        for k, r in enumerate(got):
            mean = np.mean(nulls[k], axis=0)
            want = (mean[0], mean[1:].mean(), np.quantile(mean[1:], 0.025), np.quantile(mean[1:], 0.975), mean[1:].max(), ((mean[1:] >= mean[0]).sum() + 1) / 26)
            assert np.allclose(list(r)[1:], want, atol=1e-9)


def test_products_of_sparse_rows():
    rnd = np.random.default_rng(0)
    for width, density, n in ((6, 0.5, 40), (400, 0.01, 300), (50, 0.0, 5)):
        x = np.where(rnd.random((n, width)) < density, rnd.normal(size=(n, width)), 0.0)
        places = [np.flatnonzero(r) for r in x]
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in places])))
        flat = np.concatenate(places).astype(np.int64)
        total = np.zeros((width, width))
        gram.add_products(total, offsets, flat, np.concatenate([r[p] for r, p in zip(x, places, strict=True)]))
        assert np.allclose(total, x.T @ x)
    twice = np.zeros((2, 2))
    gram.add_products(twice, np.array([0, 3]), np.array([0, 0, 1]), np.array([1.0, 2.0, 5.0]))
    assert np.allclose(twice, [[9, 15], [15, 25]])


def test_systems_from_tiles(spark, monkeypatch):
    """Plain and group-centred systems of several folds from small tiles, with items of no feature and repeated names."""
    monkeypatch.setattr(gram, "TILE", 3)
    monkeypatch.setattr(gram, "FAN_IN", 2)
    rnd = np.random.default_rng(4)
    x = np.where(rnd.random((120, 7)) < 0.4, rnd.normal(size=(120, 7)), 0.0)
    x[5] = 0
    y = x @ rnd.normal(size=7) + rnd.normal(size=120)
    grp, fold = np.arange(120) // 5, (np.arange(120) // 5) % 3
    items = spark.createDataFrame([(k, f"g{grp[k]}", int(fold[k]), float(y[k])) for k in range(120)] + [(500, "g0", 0, None)], "item long, grp string, fold int, label double")
    long = [(k, f"n{j}", float(x[k, j]) / 2) for k in range(120) for j in range(7) if x[k, j] for _ in range(2)]
    features = spark.createDataFrame([*long, (900, "n0", 5.0)], "item long, name string, value double").repartition(5)
    plain, centred = (linear.System.by_fold(features, items, "label", c) for c in (False, True))
    means = lambda a: a - np.array([a[grp == g].mean(axis=0) for g in range(24)])[grp]
    for f in range(3):
        own = fold == f
        assert plain[f].n == centred[f].n == 40
        for system, a, b in ((plain[f], x, y), (centred[f], means(x), means(y)), (plain[f].centred(), np.where(own[:, None], x - x[own].mean(0), 0), y - y[own].mean())):
            assert np.allclose(system.matrix, a[own].T @ a[own]) and np.allclose(system.right, a[own].T @ b[own]) and abs(system.square - b[own] @ b[own]) < 1e-8
    w = plain[0].ridge(0.0)
    a, b = x[fold == 0], y[fold == 0]
    assert abs(plain[0].rmse(w) - np.sqrt(np.mean((b - a @ np.array([w[f"n{j}"] for j in range(7)])) ** 2))) < 1e-8
    rest = linear.total(plain).less(plain[1])
    assert np.allclose(rest.matrix, x[fold != 1].T @ x[fold != 1]) and rest.n == 80 and np.allclose(rest.sums, x[fold != 1].sum(0))


def test_no_fit_plan_has_one_task_for_all_rows(spark, monkeypatch):
    """Neither a constant window nor a join of an item with itself."""
    items = spark.createDataFrame([(k, f"g{k % 4}", float(k)) for k in range(40)], "item long, grp string, label double")
    features = spark.createDataFrame([(k, f"g{k % 4}", n, float(k % 5)) for k in range(40) for n in "ab"], "item long, grp string, name string, value double")
    plans = []
    old = gram.tiles
    monkeypatch.setattr(gram, "tiles", lambda rows, width: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or old(rows, width))
    linear.fit_ridge(items, features, 1.0)
    linear.fit_group_ridge(items, features, 1.0)
    assert len(plans) == 2 and not any("SinglePartition" in p or "Window" in p for p in plans)
    assert sum(p.count("SortMergeJoin") for p in plans) <= 2


def test_metrics_of_equal_predictions_in_many_parts(spark):
    """A constant prediction has no correlation, however its parts' deviations round; ties share ranks; nulls take the other way."""
    rows = [(k, float(k * 37 % 101), 0.1 if m == "flat" else float(k % 5), m) for k in range(200) for m in ("flat", "tied")]
    df = spark.createDataFrame(rows, "item long, label double, prediction double, model string").repartition(7)
    got = {r["model"]: r for r in metrics.regression_metrics(df, "model").collect()}
    assert got["flat"]["pearson"] is None and got["flat"]["spearman"] is None
    y, p = np.array([r[1] for r in rows if r[3] == "tied"]), np.array([r[2] for r in rows if r[3] == "tied"])
    want = np.corrcoef(resampling.ranks(y), resampling.ranks(p))[0, 1]
    assert abs(got["tied"]["spearman"] - want) < 1e-12
    none = spark.createDataFrame([(999, None, 1.0, "tied")], df.schema)
    assert abs(metrics.regression_metrics(df.unionByName(none), "model").where("model = 'tied'").first()["n"] - 201) == 0


def test_ladder_of_items_with_equal_values(spark):
    items = spark.createDataFrame([(k, "g", float(k % 6 + 2 * (k % 3))) for k in range(60)], "item long, grp string, label double")
    counts = spark.createDataFrame([(k, e, n) for k in range(60) for e, n in (("C", k % 6 + 1), ("N", k % 3)) if n], "item long, element string, n long")
    features = spark.createDataFrame([(k, "g", "edges", float(k % 3)) for k in range(60) if k % 3], "item long, grp string, name string, value double")
    plans = {r["model"]: r for r in studies.baseline_ladder(items, counts, features, linear.weights_frame(spark, {"edges": 2.0, "doubles": 1.0})).collect()}
    assert set(plans) == {"mean", "composition", "composition_size", "connectivity", "full"}
    assert plans["composition"]["rmse"] < 1e-8 and plans["full"]["rmse"] < 1e-8 and plans["mean"]["pearson"] is None
    assert abs(plans["connectivity"]["mae"] - 2.5) < 1e-12


def test_held_out_ladder_against_plain_fits(spark):
    """Six models on the training rows, the joint ridge among them, scored on rows that no fit has seen; a group with a new element goes."""
    rnd = np.random.default_rng(5)
    splits = ["training", "training", "external", "validation"]
    items = [(k, f"g{k % 12}", splits[k % 4], float(rnd.normal() * 3 + k % 7)) for k in range(240)]
    number = {(k, e): n for k in range(240) for e, n in (("C", int(rnd.integers(1, 6))), ("N", int(rnd.integers(0, 3))), ("H", int(rnd.integers(0, 9))), ("O", 2), ("S", int(k % 12 == 2))) if n}
    value = {(k, t): float(rnd.integers(1, 5)) for k in range(240) for t in ("edges", "doubles", "other") if rnd.random() < 0.7}
    frozen = {"edges": 0.75, "doubles": -1.25, "absent": 2.0}
    frame = spark.createDataFrame([(k, g, s, y) for k, g, s, y in items] + [(900, "g0", "training", None)], "item long, grp string, split string, label double").where("label is not null")
    counts = spark.createDataFrame([(k, e, n) for (k, e), n in number.items()], "item long, element string, n long")
    features = spark.createDataFrame([(k, "", t, v) for (k, t), v in value.items()], "item long, grp string, name string, value double")
    got = {(r["model"], r["split"]): r for r in studies.held_out_ladder(frame, counts, features, linear.weights_frame(spark, frozen), 100.0).collect()}

    elements = ["C", "H", "N", "O"]  # S is in no training row
    of = lambda rows: np.array([[number.get((k, e), 0) for e in elements] for k, *_ in rows], float)
    sizes = lambda x: np.column_stack([x, x.sum(1) ** 2, (x.sum(1) - x[:, 1]) ** 2])
    terms = lambda rows: np.array([[value.get((k, t), 0.0) for t in sorted(frozen)] for k, *_ in rows])
    train = [r for r in items if r[2] == "training"]
    y, x, f, w = np.array([r[3] for r in train]), of(train), terms(train), np.array([frozen[t] for t in sorted(frozen)])

    def linear_fit(a, target, b):
        one = lambda m: np.column_stack([m, np.ones(len(m))])
        return one(b) @ np.linalg.lstsq(one(a), target, rcond=None)[0]

    def ridge_fit(a, target, b):
        mean, scale = a.mean(0), np.where(a.std(0) > 0, a.std(0), 1.0)
        z = (a - mean) / scale
        return target.mean() + (b - mean) / scale @ np.linalg.solve(z.T @ z + 100.0 * np.eye(z.shape[1]), z.T @ (target - target.mean()))

    for split in set(splits):
        rows = [r for r in items if r[2] == split and not (split != "training" and r[1] == "g2")]
        own, a, t = np.array([r[3] for r in rows]), of(rows), terms(rows)
        want = {
            "mean": np.full(len(rows), y.mean()), "composition": linear_fit(x, y, a), "composition_size": linear_fit(sizes(x), y, sizes(a)),
            "connectivity": t @ w + (y - f @ w).mean(), "full": linear_fit(x, y - f @ w, a) + t @ w, "joint_ridge": ridge_fit(np.column_stack([x, f]), y, np.column_stack([a, t])),
        }
        for model, p in want.items():
            r = got.pop((model, split))
            assert r["n"] == len(rows)
            assert np.allclose([r["mae"], r["rmse"], r["median_abs_error"], r["mean_signed_error"]], [abs(p - own).mean(), np.sqrt(((p - own) ** 2).mean()), np.median(abs(p - own)), (p - own).mean()], atol=1e-9)
            assert r["pearson"] is None if model == "mean" else abs(r["pearson"] - np.corrcoef(p, own)[0, 1]) < 1e-9
    assert not got


def test_ladder_query_has_every_model(spark, sf_dir):
    got = Q.QUERIES["baseline_ladder"](spark, sf_dir).collect()
    assert {r["model"] for r in got} == {"mean", "composition", "composition_size", "connectivity", "full", "joint_ridge"}
    assert sum(r["n"] for r in got if r["model"] == "joint_ridge") == B.mol_items(spark, sf_dir).count()  # training has every element
