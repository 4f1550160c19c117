"""Every registered query of the core against its SQL, and contracts of the entry module."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from siftmill.plans.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(cell(v) for v in r) for r in zip(*(table.column(n).to_pylist() for n in names)))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_duckdb(spark, sf_dir, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, sf_dir, name):
    """What SQL cannot say is compared with brute force in test_brute.py; here: rows with a stable schema."""
    got = QUERIES[name][0](spark, sf_dir)
    none = name == "cross_pool_leak"  # no turn of these tables leaks; edited_pool_leak has pairs
    assert (got.count() > 0) != none and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("siftmill.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("siftmill.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    again = importlib.import_module("__spark_entry__")
    assert set(again.queries()) == set(QUERIES)
