import ast
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

ROOT = pathlib.Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_nothing_outside_imports_the_optional_part():
    for path in [*ROOT.glob("tidemark/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert said.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLE))], said.stderr


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["file", "pos_from", "segment_id"] and df.count() >= 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(f"SELECT {', '.join(map('"{}"'.format, df.columns))} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
