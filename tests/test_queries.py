"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cohortal.plans import bindings
from cohortal.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["score_and_rank", "full_prediction", "reaction_components", "harvest_events", "normalize_graphs", "rank_metrics_tie_aware", "margin_quintiles", "fit_ridge", "spectral_moments", "ring_strain", "formal_charge_terms", "bond_changes", "check_mapping", "tanimoto_pairs"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    con = duck.execute(own.SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == columns
    assert found == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in con.fetchall())))


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 100 and df.columns == ["item", "grp", "prediction", "rank", "delta"]


def test_every_sql_has_a_query():
    assert set(own.SQL) <= set(own.QUERIES) and len(own.SQL) >= 90


@pytest.mark.parametrize(("name", "column"), [("bootstrap_interval", "estimate"), ("permutation_null", "observed")])
def test_resampling_takes_whole_groups(spark, sf_dir, name, column):
    """sf0.01 has groups of more than ten customers."""
    d = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    groups = {}
    for r in bindings.scored(spark, d).collect():
        groups.setdefault(r["grp"], []).append((r["label"], r["prediction"]))
    assert max(map(len, groups.values())) > 10 and min(map(len, groups.values())) > 1
    want = np.mean([np.corrcoef(np.array(g).T)[0, 1] for g in groups.values()])
    assert abs(own.QUERIES[name](spark, d).first()[column] - want) < 1e-5
