"""Every query that has SQL against it in DuckDB; the others are compared with brute force in test_patches.py."""

import glob
import os

import duckdb
import pytest

from patchlens.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert mine == want


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_sql_are_the_known_ones():
    assert set(plans.QUERIES) - set(plans.SQL) == {"patch_dry_run", "patch_apply", "patch_merge", "conflict_records_whole"}
