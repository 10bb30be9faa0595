"""The driver contract, with and without the training-data package, and SQL twins on the smallest tables."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from candlemill import oracles, queries

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"discover_l3", "discover_l4"}


def test_entry_is_lazy_and_has_rows(spark):
    got = entry.entry(spark)
    assert got.count() == 10 and "pattern_id" in got.columns


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_training_package(tmp_path):
    for part in ("candlemill", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    if (tmp_path / "candlemill/llm").exists():
        shutil.rmtree(tmp_path / "candlemill/llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_outside_imports_the_training_package():
    for path in (ROOT / "candlemill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def rows_of(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v))
    return sorted(text.agg("|".join, axis=1)) if len(text) else []


@pytest.mark.parametrize("name", sorted(set(oracles.oracle_sql()) - SLOW))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(oracles.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(want[c]):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows_of(got) == rows_of(want)
