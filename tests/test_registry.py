"""The registered queries keep their contract; a few run end to end against their oracle."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["manifest", "facet_corpus", "join_robots", "tile_selection", "stream_volume", "x_stylesheet"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = sorted(map(repr, result.fetchall()))
    got = entry_module.queries()[name](spark, SF).select(*columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected


def test_entry_without_the_optional_operators(tmp_path):
    """A copy without the training-data operators still imports and registers all other queries."""
    root = pathlib.Path(__file__).resolve().parents[1]
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", "*.md")
    for name in ("pagelens", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=left_out)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as E; print(len(E.queries()), [n for n in E.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'], set(E.oracle_sql()) <= set(E.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    ours = [n for n in entry_module.queries() if not (n.startswith("op") and n[2].isdigit() or n == "pipeline")]
    assert got.stdout.split("\n")[-2] == f"{len(ours)} [] True"
