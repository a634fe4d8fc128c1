import pytest

from barline.plans.catalog import QUERIES, SQL

from .oracle import rows_of, sql_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = rows_of(QUERIES[name](spark, DATA))
    if name in SQL:
        assert got == sql_rows(DATA, SQL[name])
    else:
        assert got[1]
