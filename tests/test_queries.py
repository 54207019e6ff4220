"""Every registered query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataframe.queries import ENTRY, ORACLE_SQL, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLE_SQL:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(map(norm, r)) for r in duck.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()), key=str)
    assert got == want


def test_entry_has_rows(spark):
    assert ENTRY(spark, SF).count() == 1
