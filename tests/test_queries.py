"""Registered queries against DuckDB on the smallest tables, and the contract of the entry module."""

import datetime

import duckdb
import pytest

import __spark_entry__
from tidemark import plans, registry  # noqa: F401
from tidemark.plans import q_panel, q_strategies
from tidemark.sources.roles import TABLES

SF = "/root/testdata/sf0.001"
def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return float(v) if not isinstance(v, str) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def written_once():
    """The master and the strategies' assignments are written tables: the queries that read them share one of each here."""
    with pytest.MonkeyPatch.context() as m:
        for module, name in ((q_panel, "master"), (q_strategies, "assigned")):
            made, tables = getattr(module, name), {}
            m.setattr(module, name, lambda r, made=made, tables=tables: tables[r.sf_dir] if r.sf_dir in tables else tables.setdefault(r.sf_dir, made(r)))
        yield


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_matches_oracle(spark, duck, key):
    got = registry.QUERIES[key](spark, SF)
    want = duck.sql(registry.ORACLES[key])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
