"""Every query of the catalogue runs, and equals its SQL in DuckDB where it has one."""

import duckdb
import pandas as pd
import pytest

from perron import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if pd.isna(v):
        return ""
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    return f"{float(v):.6g}"


def canonical(df):
    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_chain_keeps_rows_and_ranges(spark):
    out = catalog.feature_chain(spark, SF).toPandas()
    assert len(out) == len(set(out.event_id)) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert out.fiabilite_train_historique.between(0, 1).all()


def test_entry_module_works_without_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "perron", tmp_path / "perron", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
