"""The driver's contract: every query runs, agrees with its SQL, and the llm subpackage may be missing."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) == len(set(queries))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm(tmp_path):
    """The rest imports and answers without the subpackage."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('p1_') for q in e.queries()); assert 'p5_found' in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})


def test_queries_agree_with_sql(spark):
    """A few queries of each kind on the smallest data; the driver compares all of them."""
    import duckdb

    con = duckdb.connect()
    data = "/root/testdata/sf0.001"
    for file in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    for name in ("bm25f_scores", "p5_report", "symbol_info", "scope_both", "change_detection", "line_calls", "dense_scores"):
        left = entry.queries()[name](spark, data).toPandas()
        right = con.execute(entry.oracle_sql()[name]).df()
        key = lambda f: sorted(map(repr, f.reindex(sorted(f.columns), axis=1).astype(str).itertuples(index=False, name=None)))
        assert key(left) == key(right), name
