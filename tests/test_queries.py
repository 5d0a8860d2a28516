"""Every relational query against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import duck, rows

from lodestone import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    assert rows(q.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(q.ORACLE_SQL[name]).df())


def test_order_by_is_in_order(spark, con):
    got = [r["c_custkey"] for r in q.QUERIES["order_by"](spark, SF).collect()]
    assert got == [r[0] for r in con.sql(q.ORACLE_SQL["order_by"]).fetchall()]


def test_entry_works_without_the_corpus_package(tmp_path):
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
