import duckdb
import pytest

from tests.conftest import SMALL
from trawl.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalogue.SQL:
        assert len(found)
        return
    want = duck.sql(catalogue.SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(found) == rows(want)
