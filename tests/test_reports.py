"""Every named report against its reference SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracles
from trialspark.reports import decisions, monitoring, replays, tables, tests

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
SQL = oracles.all_sql()
REPORTS = {n: f for m in (tables, tests, monitoring, decisions, replays) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def ordered(names, rows):
    idx = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in idx], sorted((tuple(r[i] for i in idx) for r in rows), key=lambda t: tuple(map(str, t)))


def test_every_report_has_sql():
    assert set(SQL) == set(REPORTS)
    assert set(REPORTS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report(spark, con, name):
    df = REPORTS[name](spark, SF)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    want = ordered([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (a, b)
            else:
                assert x == y, (a, b)
