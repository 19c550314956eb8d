"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from textwarrant.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return base


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, database, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = database.sql(registry.ORACLES[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted("|".join(shown(r[c]) for c in columns) for r in df.collect()) == sorted("|".join(shown(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, database, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_training_data_subpackage():
    """The driver's three functions work where the subpackage and its tests are gone."""
    script = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'textwarrant.llm' or name.startswith('textwarrant.llm.') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as entry\n"
        "assert entry.queries() and entry.oracle_sql()\n"
        "assert not [n for n in entry.queries() if n.startswith('op') or n == 'pipeline']\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", script], cwd=root, check=True)
