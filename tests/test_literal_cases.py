"""The rules on small literal tables, against the rows written down for them."""

from __future__ import annotations

import duckdb
import pytest
from literal_cases import ORACLE, QUERIES
from test_queries import plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_literal_case(spark, name):
    got, want = QUERIES[name](spark, "").toPandas(), duckdb.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)
