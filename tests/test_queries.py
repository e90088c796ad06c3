"""Every registered query of the log engine against its SQL, over whole tables."""

import os

import duckdb
import pytest

from tracewright.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(rows):
    clean = lambda v: "~" if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(clean(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    assert _rows(tuple(r) for r in df.select(*cols).collect()) == _rows(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tracewright"), tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'incidents' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
