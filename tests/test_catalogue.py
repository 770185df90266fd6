"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def cells(rows) -> list:
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted([plain(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = got.select(*columns).collect()
    assert rows, "no rows, so nothing is shown"
    assert cells(rows) == cells([[r[i] for i in order] for r in want.fetchall()])
