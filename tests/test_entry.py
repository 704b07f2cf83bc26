import importlib

import pytest


def entry_module():
    return importlib.import_module("__spark_entry__")


def test_entry(spark, sf):
    assert entry_module().entry(spark).count() > 0


def test_oracles_belong_to_queries():
    e = entry_module()
    assert set(e.oracle_sql()) <= set(e.queries())


def core_names():
    from quernstone.plans import catalogue

    return sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", core_names())
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("message_events", "candidate_decisions", "task_definitions", "quality_decisions", "review_decisions", "quality_reviews", "replay_results", "pii_hits", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    e = entry_module()
    got = e.queries()[name](spark, sf)
    columns = sorted(got.columns)
    plain = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    cursor = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(columns).collect()), key=repr) == want
