import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.abspath(entry.__file__))


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100
    assert sum(n.startswith("metric_") for n in queries) >= 44


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"file", "line", "score", "place"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", ["line_ochiai", "feature_def_use", "feature_scalar_pair", "rank_ties", "fault_ranks", "proximity_line"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "documents", "labels"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    found = con.sql(entry.oracle_sql()[name])
    order = [list(found.columns).index(c) for c in sorted(df.columns)]
    want = sorted(tuple(str(r[i]) for i in order) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def test_without_the_text_operators(tmp_path):
    """The rest works where the subpackage and the pipeline are gone."""
    for item in ("__spark_entry__.py", "tracesift"):
        source = os.path.join(HERE, item)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / item)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'line_ochiai' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
