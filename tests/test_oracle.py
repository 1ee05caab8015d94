"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from conftest import SF_SMALL
from oracle_compare import compare


@pytest.mark.parametrize(
    "name",
    __import__("__spark_entry__").oracle_sql().keys(),
)
def test_query_matches_oracle(spark, name):
    rec = compare(spark, SF_SMALL, [name])[name]
    assert rec["columns_match"], rec
    assert rec["spark_rows"] == rec["oracle_rows"], rec
    assert rec["hash_match"], rec
