import duckdb
import pytest

import __spark_entry__
from sawmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr([round(float(x), 4) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_like_sql(spark, duck, name):
    out = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(rel.columns)
    assert sorted(out.columns) == cols
    assert plain(map(tuple, out.select(*cols).collect())) == plain(rel.select(*cols).fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"key", "value"}
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
