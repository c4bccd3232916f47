"""Every query with SQL gives DuckDB's rows; the others give rows and columns."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sigmaloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, 0.0, "")
    if isinstance(v, bool) or hasattr(v, "item") and v.dtype == bool:
        return (1, 0.0, str(bool(v)))
    return (2, round(float(v), 4), "") if isinstance(v, (int, float)) or hasattr(v, "as_tuple") or hasattr(v, "item") else (1, 0.0, str(v))


def _same(a, b) -> bool:
    x, y = _key(a), _key(b)
    return x == y or x[0] == y[0] == 2 and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, sf_dir, name):
    got = core.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=lambda r: [_key(v) for v in r])
    assert rows or name == "stepwise"  # no variable may enter
    if name in core.oracle_sql():
        want = duck.execute(core.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=lambda r: [_key(v) for v in r])
        assert len(rows) == len(expected)
        for a, b in zip(rows, expected, strict=True):
            assert all(map(_same, a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
