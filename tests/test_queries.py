"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans.catalogue import QUERIES
from tessera.plans.oracle import SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in os.listdir(DATA):
        found.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return found


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr([plain(v) for v in value]) if isinstance(value, list) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA).toArrow()
    rows = sorted("|".join(plain(r[c]) for c in sorted(r)) for r in found.to_pylist())
    if name in SQL:
        table = duck.sql(SQL[name]).to_arrow_table()
        assert sorted(table.column_names) == sorted(found.column_names)
        assert rows == sorted("|".join(plain(r[c]) for c in sorted(r)) for r in table.to_pylist())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The entry module and the library work where the corpus operators are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'claim_verdict' in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
