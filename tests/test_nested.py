"""The nested study against training each split on its own."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from cohortal.operators import metrics, nested
from cohortal.operators.linear import System
from cohortal.operators.ordering import average_ranks
from cohortal.operators.resampling import ranks


def bucket(namespace, key, n):
    return int(hashlib.sha256(f"{namespace}:{key}".encode()).hexdigest()[:8], 16) % n


def centred(x, grp):
    return x - np.array([x[grp == g].mean(axis=0) for g in grp])


def system(x, y, grp, names):
    cx, cy = centred(x, grp), centred(y, grp)
    return System(list(names), cx.T @ cx, cx.T @ cy, len(y), float(cy @ cy))


def composite(y, p, grp):
    pearson, spearman = [], []
    for g in sorted(set(grp)):
        a, b = y[grp == g], p[grp == g]
        if a.std() > 1e-12 and b.std() > 1e-12:
            pearson.append(np.corrcoef(a, b)[0, 1])
            spearman.append(np.corrcoef(ranks(a), ranks(b))[0, 1])
    return (np.mean(pearson) + np.mean(spearman)) / 2


def test_study_equals_split_by_split_training(spark):
    rnd = np.random.default_rng(6)
    names = [f"n{k}" for k in range(5)]
    n = 160
    grp = np.array([f"g{k // 5}" for k in range(n)])
    x = np.where(rnd.random((n, 5)) < 0.7, np.round(rnd.normal(size=(n, 5)), 3), 0.0)
    y = x @ np.array([1.0, -0.8, 0.5, 0.0, 0.0]) + 0.5 * rnd.normal(size=n)
    items = spark.createDataFrame([(k, grp[k], float(y[k])) for k in range(n)] + [(900, "alone", 1.0)], "item long, grp string, label double")
    features = spark.createDataFrame([(k, grp[k], names[j], float(x[k, j])) for k in range(n) for j in range(5) if x[k, j]], "item long, grp string, name string, value double")
    frozen, lassos, ridges, outer, inner = {"n0": 0.7, "n3": 0.1}, [0.02, 0.2], [1.0, 100.0], 3, 2
    study = nested.nested_study(items, features, frozen, lassos, ridges, outer, inner)
    own = np.array([bucket("outer-fold", g, outer) for g in grp])
    weigh = lambda s, keep, r: np.array([s.only(set(keep)).ridge(r).get(m, 0.0) for m in names])
    want = {}
    for o in range(outer):
        at = np.array([bucket(f"inner-fold-{o}", g, inner) for g in grp])
        pool, scores, supports = own != o, {}, {v: [] for v in lassos}
        held = {("fixed", 0.0, r): np.zeros(n) for r in ridges} | {("expanded", v, r): np.zeros(n) for v in lassos for r in ridges}
        for i in range(inner):
            train, rest = pool & (at != i), pool & (at == i)
            s = system(x[train], y[train], grp[train], names)
            for v in lassos:
                supports[v].append(set(s.lasso(v)))
            for kind, v, r in held:
                held[kind, v, r][rest] = x[rest] @ weigh(s, frozen if kind == "fixed" else supports[v][-1], r)
        scores = {c: composite(y[pool], p[pool], grp[pool]) for c, p in held.items()}
        near = lambda v, to: -abs(math.log10(v) - math.log10(to)) if v else 0.0
        best = {kind: max((c for c in held if c[0] == kind), key=lambda c: (round(scores[c], 9), near(c[1], 0.003), near(c[2], 100.0))) for kind in ("fixed", "expanded")}  # noqa: B023
        stable = set.intersection(*supports[best["expanded"][1]])
        s = system(x[pool], y[pool], grp[pool], names)
        for model, w in (("baseline", np.array([frozen.get(m, 0.0) for m in names])), ("fixed", weigh(s, frozen, best["fixed"][2])), ("expanded", weigh(s, stable, best["expanded"][2]))):
            test = own == o
            for k, p in zip(np.flatnonzero(test), centred(x[test] @ w, grp[test]), strict=True):
                want[model, int(k)] = (o, p)
        choice = study.choices[o]
        assert (choice["fixed_alpha"], choice["lasso"], choice["ridge"], set(choice["terms"])) == (best["fixed"][2], *best["expanded"][1:], stable)
        assert abs(choice["composite"] - scores[best["expanded"]]) < 1e-9 and choice["sha256"] == hashlib.sha256("\n".join(sorted(stable)).encode()).hexdigest()
    got = {(r["model"], r["item"]): (r["fold"], r["prediction"]) for r in study.predictions.collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    row = nested.model_deltas(study.predictions, "expanded", "baseline", 50).first()
    assert row["pearson_low"] <= row["pearson_delta"] <= row["pearson_high"] and row["groups"] <= 32
    assert study.choice_frame().count() == outer


def test_cells_equal_items(spark):
    """Items with the same values in a row of sums each: the same systems as from every item, and no row of the study's scoring is an item's."""
    rows = [(k, f"g{k % 3}", float(k * 7 % 11), float(k // 3 % 2)) for k in range(120)]
    items = spark.createDataFrame([r[:3] for r in rows], "item long, grp string, label double")
    features = spark.createDataFrame([(k, g, n, v) for k, g, _, x in rows for n, v in (("a", x), ("b", 2.0 - x)) if v], "item long, grp string, name string, value double")
    copies = nested.inner_copies(items, 3, 2)
    want = System.by_fold(features, copies, "label", True)
    held = items.join(nested.item_rows(nested.numbered(features, ["a", "b"])), "item")
    cells = held.groupBy("grp", "places", "values").agg(F.count("*").alias("n"), F.sum("label").alias("y"), (F.var_pop("label") * F.count("*")).alias("rest"))
    assert cells.count() == 6
    got = System.of_cells(nested.inner_copies(cells, 3, 2), ["a", "b"])
    assert set(got) == set(want)
    for fold, s in want.items():
        assert got[fold].n == s.n and abs(got[fold].square - s.square) < 1e-8
        assert np.allclose(got[fold].matrix, s.matrix) and np.allclose(got[fold].right, s.right)


def test_correlations_of_cells(spark):
    """Weighted cells give the correlations of their rows, ties and constant predictions or labels included."""
    rows = [(g, float((k * 5 + k // 7) % (1 if g == "flat" else 6)), float(0 if g == "one" else k % 4)) for g in ("a", "b", "flat", "one") for k in range(40 if g == "a" else 9)]
    df = spark.createDataFrame([(g, i, y, p) for i, (g, y, p) in enumerate(rows)], "grp string, item long, label double, prediction double")
    want = {r["grp"]: r for r in metrics.rank_metrics(df, "keep_ties").collect()}
    n, mean = df.groupBy("grp").agg(F.count("*").alias("_n"), F.avg("label").alias("_m")), F.col("label") - F.col("_m")
    ranked = average_ranks(df, ["grp"], "label", "_r").join(n, "grp").withColumn("c", mean).withColumn("r", F.col("_r") - (F.col("_n") + 1) / 2)
    cells = ranked.groupBy("grp", "prediction").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("s"))
    got = {r["grp"]: r for r in metrics.cell_correlations(cells, ["grp"]).collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        assert got[g]["size"] == r["size"]
        for c in ("pearson", "spearman"):
            assert (got[g][c] is None) == (r[c] is None) and (r[c] is None or abs(got[g][c] - r[c]) < 1e-12), (g, c)
