import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidentia.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def rows(frame, columns):
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) or type(v).__name__.startswith("float") else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql_twin(spark, sql, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def test_entry_works_without_the_training_data_package(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_training_data_package():
    repo = Path(__file__).resolve().parent.parent
    for p in (repo / "evidentia").rglob("*.py"):
        if "llm" not in p.relative_to(repo).parts:
            assert not re.search(r"(from|import)[ .\w]*\bllm\b", p.read_text()), p
