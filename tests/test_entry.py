"""The driver's contract."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import branch_rows, catalog, engine_rows, engine_sql, more_rows, more_sql, search_rows

QUERIES = catalog.QUERIES | engine_rows.QUERIES | more_rows.QUERIES | search_rows.QUERIES | branch_rows.QUERIES
ORACLES = catalog.ORACLES | engine_sql.ORACLES | more_sql.ORACLES | search_rows.ORACLES | branch_rows.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_without_the_corpus_operators():
    code = "import sys, importlib.util as u\nf = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith(('tidemark.llm', 'corpus_pipeline')) else f(n, *a)\nimport __spark_entry__ as e\nassert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())\nassert not any('tidemark.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_sql(spark, sql, name):
    frame = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    assert got
    if name in ORACLES:
        found = sql.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
