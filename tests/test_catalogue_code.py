"""Every query of the third catalogue against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import pytest

from lodestone.plans import catalogue_code

from test_catalogue import cells, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue_code.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):  # noqa: F811
    got = catalogue_code.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(catalogue_code.SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = got.select(*columns).collect()
    assert rows, "no rows, so nothing is shown"
    assert cells(rows) == cells([[r[i] for i in order] for r in want.fetchall()])
