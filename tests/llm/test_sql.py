"""The queries with SQL give the rows of that SQL."""

import datetime
from pathlib import Path

import duckdb
import pytest

from lexstrata.llm import registry


def plain(value):
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_rows_of_the_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    expected = sorted(repr([plain(row[i]) for i in order]) for row in found.fetchall())
    df = registry.QUERIES[name](spark, folder)
    assert sorted(df.columns) == columns
    assert sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect()) == expected
