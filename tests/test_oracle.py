"""Each registered query gives the rows of its SQL on the small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from lexstrata import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def keyed(rows):
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in plans.ORACLE:
        found = con.execute(plans.ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert keyed(rows) == keyed(tuple(r[i] for i in at) for r in found.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_imports_do_not_reach_the_optional_package():
    root = Path(entry_module.__file__).parent
    for p in (root / "lexstrata").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_entry_module_without_the_optional_parts(tmp_path):
    """A copy without the optional folders still imports and has its other queries."""
    import shutil
    import subprocess
    import sys

    root = Path(entry_module.__file__).parent
    shutil.copytree(root / "lexstrata", tmp_path / "lexstrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "lexstrata" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
