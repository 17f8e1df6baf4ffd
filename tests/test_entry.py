import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in r))


def core():
    return [n for n in entry.queries() if not (n[0] == "p" and n[1:2].isdigit())]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", core())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in entry.oracle_sql():
        wanted = duck.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in wanted.description]
        assert table_of(rows, df.columns) == table_of(wanted.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_sql_is_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
