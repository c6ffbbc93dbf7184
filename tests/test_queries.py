"""Every query with an SQL twin gives its rows over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import layout_queries, object_queries, package_queries  # noqa: F401  they register with the others
from quire.plans import queries as documents

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(row):
    return tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(documents.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = documents.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(documents.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted(plain([r[i] for i in at]) for r in found.fetchall())
    assert sorted(plain(r) for r in df.select(cols).collect()) == want


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(documents.QUERIES) <= set(queries)


def test_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "quire"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quire" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
